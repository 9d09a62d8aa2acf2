import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strail.functions import geometry as G
from strail.functions import hilbert as H
from strail.functions import idset as S
from strail.functions.klee import union_measure


def _units(spark, rows):
    return spark.createDataFrame(rows, "trajectory_id long, unit_index long, x0 float, y0 float, t0 long, x1 float, y1 float, t1 long, label_id long")


def _clip(p, q, lo, hi):
    """Liang-Barsky, as the brute-force twin of the slab test."""
    a, b = 0.0, 1.0
    for i in range(3):
        d = q[i] - p[i]
        if d == 0:
            if not lo[i] <= p[i] <= hi[i]:
                return False
            continue
        u, v = (lo[i] - p[i]) / d, (hi[i] - p[i]) / d
        a, b = max(a, min(u, v)), min(b, max(u, v))
    return a <= b


def test_segment_hits_box(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        p = [rng.randint(0, 12) for _ in range(6)]
        rows.append((i, 0, float(p[0]), float(p[1]), p[2], float(p[3]), float(p[4]), p[5], 1))
    box = G.Box(4, 4, 4, 8, 8, 8)
    got = {r[0]: r[1] for r in _units(spark, rows).select("trajectory_id", G.segment_hits(box)).collect()}
    for r in rows:
        assert got[r[0]] == _clip(r[2:5], r[5:8], (4, 4, 4), (8, 8, 8))


def test_boxes(spark):
    cases = {(0, 0, 0, 5, 5, 5): True, (0, 0, 0, 4, 4, 4): False, (10, 10, 10, 12, 12, 12): True, (11, 5, 5, 12, 6, 6): False, (6, 6, 6, 7, 7, 7): True, (0, 6, 6, 20, 7, 7): True}
    names = [f"q_{c}" for c in G.MIN_MAX]
    df = spark.createDataFrame([tuple(map(float, k)) for k in cases], names)
    df = df.select("*", *[F.lit(v).alias(f"p_{c}") for c, v in zip(G.MIN_MAX, (5.0, 5.0, 5.0, 10.0, 10.0, 10.0), strict=True)])
    for r in df.select(*names, G.boxes_intersect("p_", "q_").alias("meet"), *G.intersection_box("p_", "q_", "i_")).collect():
        assert r["meet"] == cases[tuple(int(r[n]) for n in names)]
        if not r["meet"]:
            assert all(r[f"i_{c}"] == 0 for c in G.MIN_MAX)
    with pytest.raises(ValueError):
        G.Box(1, 0, 0, 0, 1, 1)


@pytest.mark.parametrize(("point", "away"), [(11, 1), (99, 89), (0, 4), (4, 0), (6, 0), (10, 0)])
def test_interval_distance(spark, point, away):
    assert spark.range(1).select(G.interval_distance(F.lit(4), F.lit(10), F.lit(point))).first()[0] == away


def test_hilbert_is_a_bijection_with_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        h = np.arange(1 << dims * bits)
        points = np.array(H.hilbert_point(h, dims, bits))
        assert len({tuple(p) for p in points.T}) == len(h)
        assert (np.abs(np.diff(points, axis=1)).sum(axis=0) == 1).all()
        assert (H.hilbert_index(list(points), bits) == h).all()


def test_gray_code():
    assert H.gray(np.arange(8)).tolist() == [0, 1, 3, 2, 6, 7, 5, 4]
    assert H.gray_inverse(H.gray(np.arange(256)), 8).tolist() == list(range(256))


def test_interval_sets():
    s = S.IntervalSet([(5, 6), (11, 11)], 3)
    s.add(13)
    assert s.items == [(5, 6), (11, 11), (13, 13)]
    s = S.IntervalSet([(3, 3), (6, 6), (11, 11)], 3)
    s.add(13)
    assert s.items == [(3, 3), (6, 6), (11, 13)]
    s = S.IntervalSet([(34, 59), (101, 161), (244, 244)], 3)
    s.add(245)
    s.add(999)
    assert s.items == [(34, 161), (244, 245), (999, 999)]
    assert S.IntervalSet([(-100, -100), *((i, i) for i in range(1, 8)), (100, 110)]).trimmed(3) == [(-100, -100), (1, 7), (100, 110)]
    union = S.IntervalSet([(3, 3), (5, 11)], 3).union(S.IntervalSet([(3, 3), (4, 5)]), S.IntervalSet([(13, 13)]))
    assert union.items == [(3, 3), (4, 11), (13, 13)]
    assert S.IntervalSet([(5, 11), (18, 18), (19, 19)]).intersection(S.IntervalSet([(11, 15), (16, 16), (17, 17)])).items == [(11, 11)]
    assert S.display([(1, 1), (3, 5), (6, 9)]) == "{[1][3-9]}"


def test_relational_interval_sets_match_small_ones(spark):
    rng, rows, sets = random.Random(1), [], {}
    for k in range(20):
        ids = sorted(rng.sample(range(300), 25))
        sets[k] = S.IntervalSet([(i, i) for i in ids]).trimmed(6)
        rows += [(k, i) for i in ids]
    got = {}
    for r in S.ids_to_intervals(spark.createDataFrame(rows, "k int, id long"), ["k"], 6).collect():
        got.setdefault(r["k"], []).append((r["begin"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == sets


def test_bloom():
    bits = 5120
    a, b = S.bloom_of(np.arange(0, 100), bits), S.bloom_of(np.arange(50, 150), bits)
    assert S.bloom_contains(a, np.arange(100)).all()
    assert S.bloom_contains(S.bloom_union(a, b), np.arange(150)).all()
    assert S.bloom_contains(S.bloom_intersection(a, b), np.arange(50, 100)).all()
    assert S.bloom_contains(a, np.arange(1000, 3000)).mean() < 5 * S.bloom_error_rate(bits, 100) + 0.02


def test_union_measure():
    box = lambda *b: (np.array([x[0] for x in b], float), np.array([x[1] for x in b], float))
    assert union_measure(*box(((0, 0), (5, 10)))) == 50
    assert union_measure(*box(((0, 0), (5, 10)), ((1, 1), (2, 2)))) == 50
    assert union_measure(np.zeros((0, 2)), np.zeros((0, 2))) == 0
    rng = np.random.default_rng(0)
    for _ in range(20):
        low = rng.integers(0, 6, (8, 3))
        high = low + rng.integers(0, 4, (8, 3))
        cells = {c for a, b in zip(low, high, strict=True) for c in itertools.product(*(range(x, y) for x, y in zip(a, b, strict=True)))}
        assert union_measure(low, high) == len(cells)


def test_lists_to_intervals_and_blooms_without_a_shuffle(spark):
    """As the windows and the word-wise unions give them, list by list."""
    rng = random.Random(9)
    lists = [(k, sorted(rng.sample(range(-500, 500), rng.choice([1, 2, 4, 5, 6, 30, 200])))) for k in range(80)] + [(80, []), (81, None), (82, list(range(0, 60, 3)))]
    df = spark.createDataFrame(lists, "k long, ids array<long>").repartition(3)
    spans, blooms = S.lists_to_intervals(df, "ids", 5), S.lists_to_blooms(df, "ids", 320)
    assert "Exchange hashpartitioning" not in (spans._jdf.queryExecution().executedPlan().toString() + blooms._jdf.queryExecution().executedPlan().toString())
    got = {r["k"]: [(i["begin"], i["end"]) for i in r["ids"]] for r in spans.collect()}
    assert got == {k: S.IntervalSet([(i, i) for i in ids or []]).trimmed(5) for k, ids in lists}
    words = {r["k"]: r["ids"] for r in blooms.collect()}
    rows = df.select("k", F.explode("ids").alias("id"))
    assert {k: w for k, w in words.items() if w} == {r["k"]: r["filter"] for r in S.bloom_filters(rows, ["k"], 320).collect()} and words[80] == words[81] == {}
