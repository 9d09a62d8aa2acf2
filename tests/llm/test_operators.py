"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with the odd rows of each table."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("strail.llm.common")

import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from strail.llm import bpe, chat, components, decontam, embed_dedup, langid, quality, queries, simhash, suffix_dedup, tokenbin, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, score double, n int, runs string"  # extra columns with names the operators use inside
RANKS = P.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"w{i}" for i in range(30_000))


def odd_docs(spark, rows=None):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "two words here again"), (None, "no id"), (5, LONG), (6, LONG), (7, " \n\t "), (8, "ñé漢字 ́x")] if rows is None else rows
    return spark.createDataFrame([(*r, 0.5, 1, "x") for r in rows], ODD)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def roots(n, edges):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 380)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")).collect()}
    want = roots(400, edges)
    assert all(want[k] == v for k, v in got.items())
    assert {x for e in edges if e[0] != e[1] for x in e} <= set(got)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op1_gradients_are_right():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    word, chars = rng.integers(1, 50, (3, 6)), rng.integers(0, 40, (3, 6, toxicity.GRAMS))
    mask = np.ones((3, 6), bool)
    mask[0, 4:] = False
    y = np.array([1.0, 0, 1])
    _, g = net.gradients(word * mask, chars * mask[:, :, None], mask, y)
    for k in ("Wf", "Ub", "A", "v", "o", "bf"):
        at = tuple(s // 2 for s in net.p[k].shape)
        old, loss = net.p[k][at], []
        for step in (1e-3, -1e-3):
            net.p[k][at] = old + step
            loss.append(net.gradients(word * mask, chars * mask[:, :, None], mask, y)[0])
        net.p[k][at] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - g[k][at]) < 1e-3


def test_op1_windows_cover_the_text():
    for n in (1, 15, 16, 17, 31, 32, 33, 48, 49, 500):
        starts = toxicity.window_starts(n)
        assert set().union(*(range(a, min(n, a + toxicity.WINDOW)) for a in starts)) == set(range(n))


def _synthetic(n, seed):
    rng, words, bad = random.Random(seed), [f"{a}{b}" for a in "bcdfg" for b in ("al", "en", "ir", "os")], ["vile", "crud", "snark"]
    texts, y = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(10, 120))]
        if i % 3 == 0:
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice(bad)
        texts.append(" ".join(t))
        y.append(int(i % 3 == 0))
    return texts, np.array(y)


def test_op1_learns_and_is_defined_everywhere(spark):
    net = toxicity.Network.fit(*_synthetic(240, 1))
    texts, y = _synthetic(90, 2)
    assert ((toxicity.Scorer(net).score(texts) >= 0.5) == y).mean() > 0.95
    rows = toxicity.score(odd_docs(spark), net).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows) and {"doc_id", "n", "runs"} <= set(rows[0].asDict())
    assert toxicity.score(odd_docs(spark, []), net).count() == 0
    assert toxicity.Scorer(toxicity.Network.fit([], np.zeros(0))).score(["a", ""]).max() < 0.5


def test_op10_learns_and_is_defined_everywhere(spark):
    model = quality.Model.fit(*_synthetic(400, 3))
    texts, y = _synthetic(90, 4)
    assert ((quality.Scorer(model).score(texts) >= 0.5) == y).mean() > 0.9
    rows = quality.score(odd_docs(spark), model, keep_text=True, out_col="__q").collect()
    assert len(rows) == 10 and all(0 <= r["__q"] <= 1 and r["score"] == 0.5 for r in rows)
    assert quality.Scorer(quality.Model.fit(["a b"], np.array([1]))).score(["x"])[0] > 0.3


@pytest.mark.parametrize("name", ["op1_toxicity", "op10_quality"])
def test_op1_op10_columns(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == docs(spark).count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= (0.5 if name == "op1_toxicity" else 0.3))


def test_op2_round_trip(spark):
    t = chat.Template()
    rng = random.Random(0)
    bits = ["</s>", "[INST]", "\\", "x", " ", "[/ANS]", "[ROLE:a]", "\n", "é", "[/INST]</s>", " [/SYS]</s>"]
    turns = [(rng.choice(["user", "assistant", "system", "odd]%role"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    assert t.parse("".join(s for role, text in turns for s, _ in t.segments(role, text))) == turns
    rows = [(1, i, *x) for i, x in enumerate(turns)] + [(2, 0, "user", None), (2, 0, "user", None), (None, None, None, "x"), (3, 1, "assistant", "a"), (3, 0, "user", "b")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {1, 2, 3, None} and got[3]["valid"] and not got[2]["valid"] and not got[1]["valid"]
    loss = "".join(x for role, x in turns if role == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_op3_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 40)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[rng.integers(0, 60, 300)] + 0.05 * rng.standard_normal((300, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(1000, x[0].tolist(), 0), (1001, x[0].tolist(), None), (1002, None, 0), (1003, [0.0] * 16, 0), (1004, [float("nan")] * 16, 0), (1005, [1.0], 0), (None, x[0].tolist(), 0), (1006, [], 1)]
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect() if r["vec_id"] is not None}
    z = np.concatenate([x, x[:1]]).astype(np.float64)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    ids, label = [*range(360), 1000], np.array([i % 2 for i in range(360)] + [0])
    near = (z @ z.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    want = roots(361, np.argwhere(near).tolist())
    for i, k in enumerate(ids):
        assert got[k]["n_links"] == near[i].sum() and got[k]["component_id"] == ids[want[i]] and got[k]["kept"] == (k == ids[want[i]])
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (1001, 1002, 1003, 1004, 1005, 1006))
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_op4_is_the_librarys_encoding(spark):
    import tiktoken

    e = bpe.encoder(RANKS, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.tables.ranks, special_tokens={})
    rng, chars = random.Random(1), "ab  \n\t.'s1é\x1c\u0085漢字😀Ǻ_​ⅷ²"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * 3000, " " * 700, LONG]
    for t in texts:
        packed = e.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == lib.encode_ordinary(t) and e.decode(packed).decode() == t
    rows = {(r["doc_id"], r["decoded_sha256"]) for r in bpe.round_trip(odd_docs(spark), RANKS, P.PATTERN).collect()}
    assert (1, hashlib.sha256(b"").hexdigest()) in rows and (5, hashlib.sha256(LONG.encode()).hexdigest()) in rows
    assert bpe.encode_documents(odd_docs(spark, []), RANKS, P.PATTERN).count() == 0


def test_op4_appends_and_edits():
    tables, rng = bpe.encoder(RANKS, P.PATTERN).tables, random.Random(3)
    for _ in range(300):
        s = bytes(rng.choice(b"abcdeth on") for _ in range(rng.randint(0, 200)))
        own = bpe.PrefixEncoder(tables, s[:7])
        own.append(s[7:])
        a = rng.randint(0, len(s))
        b = rng.randint(a, len(s))
        own.replace(a, b, b"then")
        assert own.last == bpe.PrefixEncoder(tables, s[:a] + b"then" + s[b:]).last


def repeats(texts, length=400):
    seen, out = defaultdict(int), []
    for b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.r_[0, gone.astype(int), 0])
        out.append((len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [500, 3])
def test_op5_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, texts = [prose(rng.randint(60, 200)) for _ in range(8)], []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            r = rng.random()
            p = rng.choice(shared)
            parts.append(p[rng.randint(0, 200) :][:800] if r < 0.5 else rng.choice(["a", "ab", " "]) * rng.randint(200, 700) if r < 0.6 else prose(rng.randint(20, 150)))
        texts.append(rng.choice(["", " ", "q"]).join(parts))
    texts += ["", "x" * 399, "x" * 400, texts[0], None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, texts[1]), (900, texts[1]), (None, texts[2])]
    got = defaultdict(list)
    for r in suffix_dedup.repeats_digest(odd_docs(spark, rows).repartition(3)).collect():
        got[r[0]].append(tuple(r[1:]))
    for (i, _), want in zip(rows, repeats([(t or "").encode() for _, t in rows]), strict=True):
        assert want in got[i]
    assert sum(map(len, got.values())) == len(rows)


def test_op5_cuts_texts_and_keeps_rows(spark):
    rng = random.Random(4)
    p = " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(100))
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(odd_docs(spark, [(1, "é" + p + "ü"), (2, p + " end"), (3, None), (4, "")])).collect()}
    assert out[1]["text"] == "éü" and out[2]["text"] == " end" and out[3]["text"] is None and out[4]["text"] == "" and out[1]["runs"] == "x"
    assert suffix_dedup.remove_repeats(odd_docs(spark, [])).count() == 0


def test_op6_against_brute_force(spark):
    import re

    import xxhash

    rng = random.Random(0)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    for t in texts[:40]:
        w = t.split()
        w[rng.randrange(60)] = "Zz"
        texts.append(" ".join(w))
    texts += [None, "", "A b", "a B", "one two three", texts[0]]
    fps = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), seed=42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r["doc_id"]: r for r in simhash.simhash_components(odd_docs(spark, list(enumerate(texts)))).collect()}
    for i, f in enumerate(fps):
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == want[i]
    kept = simhash.keep_one(odd_docs(spark, [*enumerate(texts), (0, texts[0])])).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want)) and kept[0]["runs"] == "x"
    assert simhash.simhash_components(odd_docs(spark, [])).count() == 0


def test_op6_anchors_lose_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 1 << 63, dtype=np.uint64)
        y = x
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            y ^= np.uint64(1) << np.uint64(b)
        index, cell, home = simhash.anchors(np.array([x, y]).view(np.int64))
        a, b = ({(c, h) for i, c, h in zip(index, cell, home, strict=True) if i == k} for k in (0, 1))
        assert any((c, True) in b or (c, False) in b for c, h in a if h) or any((c, False) in a for c, h in b if h)


def test_op7_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in docs(spark).collect()}
    rows = queries.op7_language_id(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.9
    model = langid.fit(docs(spark))
    odd = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd_docs(spark), model).collect()}
    assert {(1, "und"), (2, "und"), (7, "und")} <= odd
    assert langid.identify(odd_docs(spark, []), model).count() == 0


def test_op7_columns_are_the_grams():
    scorer = langid.Scorer(langid.Model(["x"], {}, np.zeros((1, 1), np.int64)))
    for w in ("a", "ab", "heinger"):
        assert len(scorer.columns(w)) == len(langid.grams(w))


def edits_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_op8_against_brute_force(spark):
    rng = random.Random(0)
    prose = lambda n: "".join(rng.choice("abcdefgh  ") for _ in range(n))
    items, texts = [(i, prose(rng.randint(60, 140))) for i in range(12)], []
    for i in range(50):
        t = list(prose(150))
        if i % 2:
            part = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 14)):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([[], ["z"], [part[at], "y"]])
            t[70:70] = part
        texts.append("".join(t).upper() if i % 3 == 0 else "".join(t))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "abc"), (0, items[0][1])], "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for k, p in items:
            p, n = decontam.normalize(p), decontam.normalize(t)
            d = edits_in(p, n)
            if d <= decontam.allowed(len(p)):
                want.add((i, k, d))
    got = {tuple(r) for r in decontam.contaminated(odd_docs(spark, list(enumerate(texts))), bench).collect()}
    assert got == want and want
    by_row = decontam.contaminated(odd_docs(spark, list(enumerate(texts))), bench, by_row=True)
    assert {r["doc_id"] for r in by_row.where(F.size("__items") > 0).collect()} == {w[0] for w in want}
    assert decontam.contaminated(odd_docs(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.contaminated(odd_docs(spark, []), bench, by_row=True).count() == 0


def test_op8_blocks_of_items_agree(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {tuple(r) for r in decontam.contaminated(docs(spark), bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1500)
    assert {tuple(r) for r in decontam.contaminated(docs(spark), bench).collect()} == want and want


def test_op9_files(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [(5, "Hello  WORLD's 12\n"), (2, None), (9, "é́ <|endoftext|> x"), (2, ""), (None, "a"), (7, LONG)]
    got = tokenbin.token_records(odd_docs(spark, rows), P.path("word_bpe_49k.json"), 2).collect()
    order, at, want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), 0, []
    for k, t in order:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenbin.token_records(odd_docs(spark, []), P.path("word_bpe_49k.json"), 2).count() == 0


def test_op9_damage_is_seen(tmp_path):
    import io

    good = tokenbin.frame(b"payload") + tokenbin.frame(b"")
    f = io.BytesIO(good)
    assert tokenbin.read_record(f) == b"payload" and tokenbin.read_record(f) == b"" and tokenbin.read_record(f, 0) == b"payload"
    for i in range(len(tokenbin.frame(b"payload"))):
        bad = bytearray(good)
        bad[i] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            tokenbin.read_record(io.BytesIO(bytes(bad)))
    assert tokenbin.unmasked(tokenbin.masked(b"abc")) == zlib.crc32(b"abc")


def test_pipeline(spark):
    import corpus_pipeline

    first = docs(spark)
    got, seen = first, {r["doc_id"] for r in first.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, got = got, stage(spark, got, SF).persist()
        ids = {r["doc_id"] for r in got.select("doc_id").collect()}
        assert ids <= seen, name
        seen = ids
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == first.columns
        if name == "simhash_near_dedup":
            want = {r["component_id"] for r in simhash.simhash_components(before).collect()}
            assert ids == want
        if name == "suffix_array_dedup":
            texts = before.select("doc_id", "text").collect()
            size = {r["doc_id"]: b - n for r, (b, n, _, _) in zip(texts, repeats([r["text"].encode() for r in texts]), strict=True)}
            assert all(len(r["text"].encode()) <= size[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got.collect())
    assert seen
