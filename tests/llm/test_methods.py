"""The methods inside the operators against plain versions, and what they once left out."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("strail.llm.common")

from strail.llm import chat, common, embed_dedup, langid, quality, queries, simhash, toxicity  # noqa: E402
from plain import language, quality_score, toxicity_logit  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_op1_against_a_plain_forward_pass(spark, texts):
    net = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    some = [t for t in texts if t][:25] + ["one", "a_b " * 33, "x" * 70]
    got = toxicity.Scorer(net).score(some)
    for t, s in zip(some, got, strict=True):
        logit = toxicity_logit(net, toxicity.tokens(t), toxicity.WINDOW, toxicity.STRIDE)
        assert abs(1 / (1 + np.exp(-(net.scale[0] * logit + net.scale[1]))) - s) < 2e-3


def test_op2_no_control_string_stands_whole(spark):
    t, rng = chat.Template(), random.Random(4)
    bits = [*t.controls, "\\", "<", "[", "s>", "]", "x"]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        said = t.escaped(text)
        assert t.unescaped(said) == text and not any(c in said for c in t.controls)
        role = "r" + "".join(rng.choice([*bits, "%", "%5D", "end"]) for _ in range(3))
        marks = "".join(t.marks(role))
        assert sum(marks.count(c) for c in t.controls) == 4
        assert t.parse("".join(s for s, _ in t.segments(role, text))) == [(role, text)]


def test_op2_roles_named_as_the_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "end", "c"), (2, 0, "start", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(made)).collect()}
    assert (got[1]["valid"], got[2]["valid"], got[3]["valid"]) == (False, False, True)
    broken = {(r["conv"], r["turn_no"]) for r in chat.format_turns(made).where("broken is not null and segment = 0").collect()}
    assert broken == {(1, 2), (2, 0)}


def test_op2_reads_written_segments(spark):
    made = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").withColumn("conv", chat.F.lit(1)).withColumn("segment", chat.F.lit("x"))
    segments = chat.format_turns(made)
    mixed = common.materialize(segments.repartition(7, "text"), "mixed")
    assert sorted(map(tuple, chat.read_back(mixed).collect())) == sorted(map(tuple, chat.read_back(segments, in_order=True).collect()))


def test_op3_nodes_cells_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 30)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 8))
    x = np.concatenate([x, x + 0.02 * rng.standard_normal(x.shape), 3 * x[:40]])
    rows = [(i, v.tolist(), "ab"[i % 2], 1, 2, 3) for i, v in enumerate(x)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, node int, x int, home int")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(made).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(near, False)
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()


def test_op3_vectors_are_packed_or_null():
    import pyarrow as pa

    lists = pa.array([[1.0, 2.0], None, [], [0.0, 0.0], [None, 1.0], [float("inf"), 1.0], [3.0]], pa.list_(pa.float32()))
    got = embed_dedup._packed(lists, np.dtype("<f4")).to_pylist()
    assert got == [np.array([1, 2], "<f4").tobytes(), None, None, None, None, None, np.array([3], "<f4").tobytes()]
    assert embed_dedup._packed(pa.array([], pa.list_(pa.float64())), np.dtype("<f8")).to_pylist() == []


@pytest.mark.parametrize("most", [1, 6, 1000])
def test_op6_divided_cells_lose_no_pair(spark, monkeypatch, most):
    rng = np.random.default_rng(most)
    x = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    more = []
    for v in x:
        for _ in range(4):
            y = v
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= np.uint64(1) << np.uint64(b)
            more.append(y)
    fp = np.unique(np.r_[x, more].view(np.int64))
    index, cell, home = simhash.anchors(fp)
    cells = spark.createDataFrame(list(zip(cell.tolist(), home.tolist(), fp[index].tolist(), [1] * len(index), strict=True)), "cell long, home boolean, node long, w long")
    links = simhash.compare(simhash.split_large(cells, most), [], simhash._near)
    roots = simhash.connected_components(links.selectExpr("node as a", "root as b"))
    got = {r["node"]: r["root"] for r in roots.collect()}
    near = np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None]) <= 4
    want = np.arange(len(fp))
    while True:
        new = np.array([want[row].min() for row in near])
        if (new == want).all():
            break
        want = new
    assert [got.get(int(v), int(v)) for v in fp] == [int(fp[k]) for k in want] and got


def test_op7_against_plain_distances(spark, texts):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    scorer = langid.Scorer(model)
    some = [*texts[:60], "½ ² Ⅷ", "½ und der", "日本語 text", "A" * 3000, "ß_ẞ 1a2b", ""]
    for t in some:
        away = language(model, t, langid.PROFILE, langid.TOP)
        lang, score = scorer.predict(t)
        if away is None:
            assert (lang, score) == ("und", 0.0)
            continue
        best = min(away, key=lambda k: (away[k], k))
        first, second = sorted(away.values())[:2]
        assert lang == best and abs(score - ((second - first) / second if second else 0)) < 1e-12


def test_op7_signs_of_numbers_are_no_letters(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    made = spark.createDataFrame([(1, "½ ² Ⅷ 12 _"), (2, None), (3, "é")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(made, model).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und"


def test_op7_forgets_without_a_trace(spark, texts, monkeypatch):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    want = [langid.Scorer(model).predict(t) for t in texts[:40]]
    monkeypatch.setattr(langid, "SPARE", 5)
    scorer = langid.Scorer(model)
    assert [scorer.predict(t) for t in texts[:40]] == want


def test_op10_against_a_plain_forward_pass(spark, texts):
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    some = [*texts, "", " ", "a" * 70 + "B" + "!" * 9]
    got = quality.Scorer(model).score(some)
    assert np.abs(got - [quality_score(model, t) for t in some]).max() < 1e-4


def test_op10_shapes_are_of_whole_tokens():
    assert quality.shape("ab" * 40 + "7") == "aa0" and quality.shape("a1" * 50) == "a0" * 50 and quality.shape("a1" * 50 + "Z") == "a0" * 50 + "A"


def test_op10_empty_table(spark):
    model = quality.fit(spark.createDataFrame([], "doc_id long, text string"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert quality.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_names_of_helper_columns_are_free():
    assert common.own_names(["a", "N", "n_"], "n", "m") == ["n__", "m__"] and common.own_names([], "n") == ["n"]


def test_chat_sql_is_the_same_format(spark):
    t = chat.Template()
    assert all(re.search(re.escape(c[0] + t.escape + c[1:]).replace("'", "''"), re.sub(r"\s+", " ", queries.ORACLE_SQL["op2_chat_format"])) for c in t.controls)


def test_op9_an_id_of_many_rows_is_many_files(spark, monkeypatch, tmp_path):
    import zlib

    import public_tokenizers as P
    from tokenizers import Tokenizer

    from strail.llm import tokenbin

    monkeypatch.setattr(tokenbin, "ROWS_PER_FILE", 10)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    said = [f"text number {i}" for i in range(80)]
    rows = spark.createDataFrame([(None, t) for t in said] + [(7, "x")], "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/records"
    (tmp_path / "records").mkdir()
    (tmp_path / "records" / ".writing-lost.rec").write_bytes(b"half a rec")
    manifest = tokenbin.write_records(rows, path, P.path("word_bpe_49k.json"), 2)
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert sum(sizes) == 81 and len(sizes) >= 3 and not list((tmp_path / "records").glob(".writing-*"))
    got = sorted(tokenbin.read_records(spark, path, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 80 + [7]
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted(r["ids_crc32"] for r in got[:80]) == sorted(map(crc, said))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()


def test_op3_compares_in_slabs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SLAB", 7)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((40, 6))
    x = np.concatenate([x, x + 0.05 * rng.standard_normal(x.shape)])
    got = embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(near.sum(axis=1).tolist())) and near.any()
