"""Each stage of the pipeline against a plain version of it, and with odd tables."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("strail.llm.common")

import corpus_pipeline  # noqa: E402
import public_tokenizers as P  # noqa: E402

from strail.llm import decontam, quality, simhash  # noqa: E402
from plain import cut_repeats, edits_in, quality_score  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    import tiktoken

    stages, rows = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r.asDict() for r in rows.collect()}

    model = quality.fit(rows, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {k: quality_score(model, r["text"] or "") for k, r in before.items()}
    assert min(abs(s - 0.3) for s in scores.values()) > 1e-4
    kept = stages["quality_classifier"](spark, rows, SF)
    got = {r["doc_id"]: r.asDict() for r in kept.collect()}
    assert got == {k: r for k, r in before.items() if scores[k] >= 0.3} and 0 < len(got) < len(before)

    fp = {k: simhash.fingerprint(r["text"].encode()) for k, r in got.items()}
    least = {k: k for k in fp}
    for _ in fp:  # the smallest id spreads along the links
        new = {k: min(least[x] for x in fp if (fp[k] ^ fp[x]).bit_count() <= 4) for k in fp}
        if new == least:
            break
        least = new
    once = stages["simhash_near_dedup"](spark, kept, SF)
    seen = {r["doc_id"]: r.asDict() for r in once.collect()}
    assert seen == {k: r for k, r in got.items() if least[k] == k}

    want = cut_repeats({k: r["text"] for k, r in seen.items()}, corpus_pipeline.PASSAGE_BYTES)
    cut = stages["suffix_array_dedup"](spark, once, SF)
    left = {r["doc_id"]: r.asDict() for r in cut.collect()}
    assert left == {k: r | {"text": want[k], "n_chars": len(want[k])} for k, r in seen.items()}

    items = [(r["item_id"], decontam.normalize(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {k for k, r in left.items() if any(edits_in(p, decontam.normalize(r["text"])) <= decontam.allowed(len(p)) for _, p in items)}
    clean = stages["benchmark_decontamination"](spark, cut, SF)
    stay = {r["doc_id"]: r.asDict() for r in clean.collect()}
    assert stay == {k: r for k, r in left.items() if k not in dirty}

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        import base64

        lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    out = {r["doc_id"]: r.asDict() for r in stages["byte_bpe"](spark, clean, SF).collect()}
    for k, r in stay.items():
        ids = lib.encode_ordinary(r["text"])
        assert out[k]["n_tokens"] == len(ids) and out[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[k]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert set(out) == set(stay)


NAMES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], NAMES), SF).count() == 0
    good = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 0").first()["text"]
    texts = [None, None, "", good, good, "x" * 30_000, " ".join(f"w{i}" for i in range(20_000))]
    extra = ["score", "quality_score", "items", "__items", "__id", "own_id", "n", "row", "key", "i", "k", "null", "runs", "cell", "Text_"]
    schema = NAMES + ", " + ", ".join(f"{c} int" for c in extra)
    rows = [(k // 2 if k < 6 else None, t, "en", "s", len(t) if t is not None else None, *range(len(extra))) for k, t in enumerate(texts)]
    made = spark.createDataFrame([*rows, rows[3]], schema)
    out = stage(spark, made, SF)
    got = out.collect()
    if name != "byte_bpe":
        assert out.columns == made.columns and all(r["runs"] == extra.index("runs") for r in got)
    count = {"quality_classifier": None, "simhash_near_dedup": None}.get(name, len(rows) + 1)
    assert count is None or len(got) == count or name == "benchmark_decontamination"
