import random

import pytest
from pyspark.sql import functions as F

from strail.functions.geometry import Box
from strail.operators import index as I
from strail.operators import layout as L
from strail.operators import prune as P
from strail.operators import query as Q
from strail.operators.insertion import Tree
from strail.schema import IndexConfig
from strail.sources import units as U

SCHEMA = "trajectory_id long, unit_index long, x0 float, y0 float, t0 long, x1 float, y1 float, t1 long, label_id long"
ONE = [(123, 0, 55.0, 33.0, 100, 66.0, 44.0, 105, 1), (123, 1, 66.0, 44.0, 106, 62.0, 48.0, 115, 2), (123, 2, 62.0, 48.0, 116, 62.0, 48.0, 130, 1), (123, 3, 62.0, 48.0, 131, 55.0, 33.0, 140, 3)]


@pytest.mark.parametrize(("box", "labels", "want"), [((0, 0, 105, 100, 100, 110), {2}, [1]), ((67, 45, 0, 68, 46, 200), {2}, []), ((0, 0, 0, 100, 100, 200), {4}, []), ((60, 40, 100, 100, 100, 110), {1}, [0])])
def test_simple_query(spark, box, labels, want):
    df = spark.createDataFrame(ONE, SCHEMA)
    assert [r["unit_index"] for r in Q.ordered(Q.simple(df, Q.SimpleQuery(Box(*box), frozenset(labels)))).collect()] == want


def _areas(seed):
    rng, rows = random.Random(seed), []
    a1, a2, a3 = ((0, 0, 0), (50, 50, 50)), ((1000, 1000, 30), (1200, 1100, 300)), ((400, 400, 100), (500, 500, 1100))

    def unit(t, i, area, label):
        p = [[rng.randint(lo, hi) for lo, hi in zip(*area, strict=True)] for _ in range(2)]
        rows.append((t, i, float(p[0][0]), float(p[0][1]), p[0][2], float(p[1][0]), float(p[1][1]), p[1][2], label))

    for t in range(10):
        for i in range(100, 125):
            unit(t, i, a1, i % 10)
    unit(5000, 0, a1, 11)
    for i, label in ((1, 1), (2, 2), (3, 1)):
        unit(5000, i, a3, label)
    unit(5050, 1, a3, 3)
    for t in range(9000, 9010):
        for i in range(123, 144):
            unit(t, i, a2, i % 13)
    return rows, Box(*a1[0], *a1[1]), Box(*a3[0], *a3[1])


def test_sequenced_query(spark):
    rows, a1, a3 = _areas(7)
    df = spark.createDataFrame(rows, SCHEMA)
    q = lambda box, *labels: Q.SimpleQuery(box, frozenset(labels))
    got = lambda steps: sorted((r["trajectory_id"], r["unit_index"]) for r in Q.find(df, steps).collect())
    assert got([q(a1, 0)]) == [(t, i) for t in range(10) for i in (100, 110, 120)]
    assert got([q(a3, 1, 2)]) == [(5000, 1), (5000, 2), (5000, 3)]
    assert got([q(a1, 11, 1, 2, 3, 4, 5), q(a3, 2, 3)]) == [(5000, 0), (5000, 2)]
    assert got([]) == []


def _greedy(rows, steps):
    """Row by row: switch to the next step at its first unit at or behind the last switch."""
    by, out = {}, set()
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for t, own in by.items():
        sets = [sorted({r[1] for r in own if s(r)}) for s in steps]
        marks, low = [], None
        for s in sets:
            low = next((u for u in s if low is None or u >= low), None)
            if low is None:
                break
            marks.append(low)
        else:
            for i, s in enumerate(sets):
                out |= {(t, u) for u in s if u >= marks[i] and (i + 1 == len(sets) or u < marks[i + 1])}
    return out


def test_find_equals_brute_force_and_joins(spark):
    rng, rows = random.Random(5), []
    for t in range(60):
        for i in range(rng.randint(1, 25)):
            rows.append((t, i, float(rng.randint(0, 9)), 0.0, 0, 0.0, 0.0, 0, rng.randint(1, 4)))
    df = spark.createDataFrame(rows, SCHEMA)
    box = Box(-1, -1, 0, 99, 99, 9)
    for labels in ([{1}, {2}], [{1, 2}, {2, 3}, {3}], [{4}, set(), {1}, {1}, {2}]):
        steps = [Q.SimpleQuery(box, frozenset(x)) for x in labels]
        want = _greedy(rows, [(lambda r, x=x: not x or r[8] in x) for x in labels])
        for run in (Q.find, Q.find_by_joins):
            got = [(r["trajectory_id"], r["unit_index"]) for r in run(df, steps).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_joins_read_units_once(spark, monkeypatch):
    """However many steps there are, and also where some trajectories are gathered and others joined; more steps than a mask has bits."""
    rng, rows = random.Random(6), []
    for t in range(50):
        for i in range(rng.randint(1, 25)):
            rows.append((t, i, float(rng.randint(0, 9)), 0.0, 0, 0.0, 0.0, 0, rng.randint(1, 4)))
    df, read = spark.createDataFrame(rows, SCHEMA), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    counted = df.mapInArrow(count, SCHEMA)
    box = Box(-1, -1, 0, 99, 99, 9)
    labels = [{1, 2}, {2, 3}, {3}]
    steps = [Q.SimpleQuery(box, frozenset(x)) for x in labels]
    want = _greedy(rows, [(lambda r, x=x: r[8] in x) for x in labels])
    for run in (Q.find_by_joins, lambda u, s: Q.find_any(u, s, 4), lambda u, s: Q.find_any(u, s, 1000)):
        before = read.value
        got = [(r["trajectory_id"], r["unit_index"]) for r in run(counted, steps).collect()]
        assert len(got) == len(set(got)) and set(got) == want and read.value - before == len(rows)
    monkeypatch.setattr(Q, "BITS", 2)
    assert {(r["trajectory_id"], r["unit_index"]) for r in Q.find_by_joins(df, steps).collect()} == want


def test_parser():
    q = Q.parse_query(["0, 20, MIN,MAX, 5,MAX", "1,2,3,4,5,6"], ["1, 2", ""])
    assert q[0].labels == {1, 2} and q[0].box.xmax == 20 and q[0].box.tmin == 5 and q[0].box.tmax == 2**32 - 1
    assert q[1].labels == frozenset() and q[1].box.ymin == 3
    for boxes, labels in ((["1,2,3"], [""]), (["2,1,3,4,5,6"], [""]), (["1,2,3,4,5,6"], []), ([], []), (["1,2,3,4,-5,6"], [""]), (["1,2,3,4,5,6"], ["x"])):
        with pytest.raises(ValueError):
            Q.parse_query(boxes, labels)


def test_layouts_and_pruning_agree(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_PER_PARTITION", 400)  # several range partitions
    walk = U.random_walk(spark, 1500, per_trajectory=60, labels=5, seed=4).persist()
    rows = walk.collect()
    assert len(rows) == 1500 and P.is_monotone(walk)
    steps = [Q.SimpleQuery(Box(0, 0, 0, 700, 700, 4e9), frozenset({1, 2})), Q.SimpleQuery(Box(100, 0, 0, 900, 900, 4e9), frozenset({3}))]
    want = sorted((r["trajectory_id"], r["unit_index"]) for r in Q.find(walk, steps).collect())
    assert want
    for layout, ids in (("str_lf", "exact"), ("str_plain", "interval"), ("hilbert", "null")):
        index = I.build(walk, IndexConfig(layout=layout, leaf_fanout=16, internal_fanout=8, id_set=ids))
        laid = index.units.groupBy("leaf_id").count().collect()
        assert sum(r["count"] for r in laid) == 1500 and max(r["count"] for r in laid) <= 16
        assert sorted((r["trajectory_id"], r["unit_index"]) for r in P.find_pruned(index, steps, monotone=True).collect()) == want


def test_save_and_open(spark, tmp_path):
    walk = U.random_walk(spark, 300, per_trajectory=50, labels=3, seed=2)
    index = I.build(walk, IndexConfig(leaf_fanout=20, internal_fanout=4, id_set="exact"))
    I.save(index, str(tmp_path))
    again = I.open_index(spark, str(tmp_path), index.config)
    assert again.size == 300 and again.height == index.height and again.units.count() == 300
    with pytest.raises(ValueError):
        I.open_index(spark, str(tmp_path), IndexConfig(leaf_fanout=21, internal_fanout=4, id_set="exact"))


def test_tree_keeps_every_entry():
    rng = random.Random(0)
    tree = Tree(8, 5)
    import numpy as np

    for i in range(300):
        low = np.array([rng.random() * 100 for _ in range(3)])
        tree.insert(i, low, low + 1, {i % 4: 1})
    numbers = tree.leaf_numbers(300)
    assert (numbers >= 0).all() and np.bincount(numbers).max() <= 8 and tree.height() > 2


def test_far_and_near_child():
    import numpy as np

    from strail.operators.insertion import choose, spatial_costs, volumes

    lows, highs = np.array([[0.0, 0, 0], [90, 90, 90]]), np.array([[10.0, 10, 10], [110, 110, 130]])
    for box, want in ((((95, 103, 100), (104, 109, 125)), 1), (((0, 0, 3), (5, 4, 10)), 0)):
        assert choose(spatial_costs(np.array(box[0], float), np.array(box[1], float), lows, highs), volumes(lows, highs)) == want


def test_steps_are_masked_once(spark):
    """The mask of all steps stands in the plan once: no filter repeats it, and the scan's method stays small enough to be compiled."""
    df = spark.range(100).select("id", *[F.col("id").cast(t).alias(c) for c, t in (("trajectory_id", "long"), ("unit_index", "long"), ("x0", "float"), ("y0", "float"), ("t0", "long"), ("x1", "float"), ("y1", "float"), ("t1", "long"), ("label_id", "long"))])
    hit = Q._hit(df.drop("id"), {"mask": F.when(Q.SimpleQuery(Box(1, 1, 1, 5, 5, 5)).predicate(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))})
    assert [r["mask"] for r in hit.collect()] == [1] * 5
    for x in (hit, Q.find(df, [Q.SimpleQuery(Box(1, 1, 1, 5, 5, 5))] * 2)):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("CASE WHEN") <= 2 and "Filter" not in plan.split("CASE WHEN")[0].split("Generate explode(array_remove")[-1]


def test_a_standing_segment_meets_what_holds_it(spark):
    rows = [(1, i, x, 2.0, 3, x2, 2.0, 3, 1) for i, (x, x2) in enumerate([(1.0, 1.0), (5.0, 5.0), (0.0, 9.0), (None, 2.0), (float("nan"), 2.0)])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lambda *box: [r["unit_index"] for r in Q.ordered(Q.simple(df, Q.SimpleQuery(Box(*box)))).collect()]
    assert got(1, 2, 3, 4, 2, 3) == [0, 2, 3] and got(1, 2.5, 3, 4, 9, 3) == [] and got(5, 2, 3, 5, 2, 3) == [1, 2]
