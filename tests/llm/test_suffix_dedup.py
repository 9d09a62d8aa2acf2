"""Repeated passages: the transform decides, on made texts, on texts built to fool hashes and on whole tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("strail.llm.common")

from strail.llm import suffix_dedup  # noqa: E402


def repeats(texts, length=400):
    """(bytes, bytes removed, spans, digest of the rest) of each text, from all of their strings of `length` bytes."""
    seen, out = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1)), []
    for b in texts:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        flags = np.cumsum(gone)[: len(b)] > 0
        edge = np.diff(np.r_[0, flags.astype(int), 0])
        out.append((len(b), int(flags.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~flags].tobytes()).hexdigest()))
    return out


def _contents(rng, length):
    base = bytes(rng.choice(rng.choice([b"ab", b"abcdefgh \n\x00\xff"])) for _ in range(120))
    out = []
    for _ in range(rng.randint(1, 12)):
        at = rng.randint(0, 80)
        c = bytearray(base[at : at + rng.randint(length, length + 60)])
        if len(c) >= length:
            if rng.random() < 0.6:
                c[rng.randrange(len(c))] = rng.choice(b"abz")
            out.append(bytes(c))
    return out


def test_intervals_are_the_repeated_windows():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([1, 2, 5, 9, 20, 40])
        content = _contents(rng, length)
        if not content:
            continue
        n = np.array([len(c) - length + 1 for c in content])
        times = Counter(c[i : i + length] for c in content for i in range(len(c) - length + 1))
        for c, flags in zip(content, suffix_dedup.repeated_windows(content, n, length), strict=True):
            assert flags.tolist() == [times[c[i : i + length]] > 1 for i in range(len(c) - length + 1)]


def test_strings_of_one_polynomial_hash_are_unlike():
    unlike = np.array([1], np.int64)
    for k in (1, 2, 4, 8, 16, 32, 64, 128, 128, 8, 4, 1):  # the product of 1 - x^k vanishes modulo 2^64 for odd x
        unlike = np.convolve(unlike, np.r_[1, np.zeros(k - 1, np.int64), -1])
    unlike = np.r_[unlike, np.zeros(400 - len(unlike), np.int64)]
    assert unlike.any() and np.abs(unlike).max() < 120
    pair = [(100 + np.maximum(s * unlike, 0)).astype(np.uint8).tobytes() for s in (1, -1)]
    assert pair[0] != pair[1]
    assert not any(f.any() for f in suffix_dedup.repeated_windows(pair, np.array([1, 1])))
    assert all(f.all() for f in suffix_dedup.repeated_windows([pair[0], pair[0]], np.array([1, 1])))


def _rows(spark, texts, length=400):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r[0]: tuple(r[1:]) for r in suffix_dedup.repeats_digest(rows, length=length).collect()}


@pytest.mark.parametrize(("hot", "block"), [(500, 12), (2, 12), (2, 3)])
def test_hot_anchors_are_split_by_context(spark, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, texts = noise(395), []
    for i in range(40):  # 5 more bytes make a window: of those behind, few differ
        texts.append(noise(rng.randint(0, 50)) + passage + rng.choice("xy") * rng.randint(0, 9) + noise(rng.randint(0, 60)))
    texts += [passage[7:] + "é" * 30, "z" + passage + "zz", ""]
    got = _rows(spark, texts)
    assert [got[i] for i in range(len(texts))] == repeats([t.encode() for t in texts])


def test_the_transform_decides(spark, monkeypatch):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(900)
    texts = [noise(300) + passage[a:b] + noise(300) for a, b in ((0, 900), (0, 450), (90, 640), (123, 555), (333, 900), (300, 801))]
    want = repeats([t.encode() for t in texts])
    got = _rows(spark, texts)
    assert [got[i] for i in range(len(texts))] == want
    for says in (np.ones, np.zeros):  # the interval expansion bypassed; patched where the task's function refers to it
        monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda content, windows, length, says=says: [says(n, bool) for n in windows])
        got = _rows(spark, texts)
        assert [got[i] for i in range(len(texts))] != want


@pytest.mark.parametrize("length", [200, 400])
def test_whole_table_against_brute_force(spark, length):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.repeats_digest(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()}
    want = repeats([(r["text"] or "").encode() for r in rows], length)
    assert [got[r["doc_id"]] for r in rows] == want


def test_whole_larger_table_against_counts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = [(r["text"] or "").encode() for r in rows]
    seen = defaultdict(int)
    for b in texts:
        for i in range(len(b) - 399):
            seen[hash(b[i : i + 400])] += 1
    got = {r[0]: r[2] for r in suffix_dedup.repeats_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for r, b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                gone[i] += 1
                gone[i + 400] -= 1
        assert got[r["doc_id"]] == int((np.cumsum(gone) > 0).sum())


def test_columns_of_clashing_names(spark):
    passage = "".join(random.Random(6).choice("abcdefgh ") for _ in range(500))
    names = ["key", "key_", "i", "K", "null", "runs", "runs_", "__key", "h", "c"]
    rows = [(k, f"é{k}" + passage, *range(len(names))) for k in (1, 2)] + [(3, None, *range(len(names))), (3, None, *range(len(names)))]
    made = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = suffix_dedup.remove_repeats(made)
    assert out.columns == made.columns
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[0])
    assert got == [(1, "é1", *range(len(names))), (2, "é2", *range(len(names))), *[(3, None, *range(len(names)))] * 2]
