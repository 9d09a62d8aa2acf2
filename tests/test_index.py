"""Live trees, searches from the root down and their id sets, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strail.operators import index as I
from strail.operators import insertion as N
from strail.operators import joins as J
from strail.operators import layout as L
from strail.operators import prune as P
from strail.operators import query as Q
from strail.plans import catalogue as C
from strail.plans.oracle import FLAGSHIP
from strail.schema import IndexConfig
from strail.sources import units as U

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def unit(spark):
    return C.units(spark, SF).persist()


def _config(**options):
    return IndexConfig(**{"leaf_fanout": 20, "internal_fanout": 4, "id_set": "null", **options})


@pytest.mark.parametrize("id_set", ["interval", "bloom"])
def test_id_sets_leave_fewer_leaves(spark, id_set):
    at = lambda i, n, x, y: [(i, n + k, x, y + k / 10, 10 * (n + k), x + 0.5, y + k / 10, 10 * (n + k) + 5, 1 + int(x) // 50) for k in range(10)]
    rows = [u for i in range(1, 11) for u in at(i, 0, 0.0, i)] + [u for i in range(100, 140) for u in at(i, 0, 50.0, i)] + at(5, 10, 50.0, 5)
    apart = spark.createDataFrame(rows, "trajectory_id long, unit_index long, x0 double, y0 double, t0 long, x1 double, y1 double, t1 long, label_id long")
    apart = apart.select("trajectory_id", "unit_index", *[F.col(c).cast("float" if c[0] != "t" else "long").alias(c) for c in ("x0", "y0", "t0", "x1", "y1", "t1")], "label_id")
    steps = [Q.SimpleQuery(C.G.Box(0, 0, 0, 10, 500, 9000), frozenset({1})), Q.SimpleQuery(C.G.Box(40, 0, 0, 60, 500, 9000), frozenset({2}))]
    plain, with_ids = (I.build(apart, _config(layout="str_plain", id_set=s)) for s in ("null", id_set))
    few, many = ({tuple(r) for r in P.search(x, steps).leaves.collect()} for x in (with_ids, plain))
    assert few < many and len(few) <= len(many) * 2 / 3
    want = sorted(map(tuple, Q.find(apart, steps).collect()))
    assert sorted(map(tuple, P.find_pruned(with_ids, steps).collect())) == want and {r[0] for r in want} == {5}


def test_search_without_an_answer(spark, unit):
    steps = C.steps([FLAGSHIP[0], ((-9.0, -9.0, 0, -8.0, -8.0, 1), ["error"])], spark, SF)
    x = I.build(unit, _config())
    assert P.search(x, steps).leaves is None and P.leaves(x, steps) is None and P.find_pruned(x, steps).count() == 0
    assert P.visits(x, steps).agg(F.max("level")).first()[0] == x.height - 1


def test_search_beyond_the_list(spark, unit, monkeypatch):
    monkeypatch.setattr(P, "PUSHED", 1)
    steps = C.steps(FLAGSHIP, spark, SF)
    for s in ("interval", "bloom", "exact", "null"):
        got = P.find_pruned(I.build(unit, _config(id_set=s)), steps, monotone=True)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, Q.find(unit, steps).collect()))


@pytest.mark.parametrize("mode", ["normal", "increasing", "decreasing"])
def test_descent_takes_the_cheapest_child(spark, unit, mode):
    x = I.build(unit.where("t0 < 1705300000"), _config(beta=0.4, beta_mode=mode))
    probe = unit.where("t0 >= 1705300000")
    got = {(r["trajectory_id"], r["unit_index"]): r["leaf_id"] for r in I.descend(x, probe).collect()}
    nodes = {(r["level"], r["node_id"]): r for r in x.nodes.collect()}
    count = {(r["level"], r["node_id"], r["label_id"]): r["unit_count"] for r in x.postings.collect()}
    rows = probe.collect()
    assert len(got) == len(rows) and x.height >= 3
    for u in rows:
        low, high = np.minimum([u["x0"], u["y0"], u["t0"]], [u["x1"], u["y1"], u["t1"]]), np.maximum([u["x0"], u["y0"], u["t0"]], [u["x1"], u["y1"], u["t1"]])
        at = 0
        for level in range(x.height - 2, -1, -1):
            kids = sorted(n for k, n in nodes if k == level and nodes[k, n]["parent_id"] == at)
            lows, highs = (np.array([[nodes[level, n][f"{a}{m}"] for a in "xyt"] for n in kids], np.float64) for m in ("min", "max"))
            totals = np.array([count[level, n, None] for n in kids], np.float64)
            own = np.array([count.get((level, n, u["label_id"]), 0) for n in kids])
            beta = x.config.beta_at(x.height, x.height - 2 - level)
            cost = beta * N.spatial_costs(low, high, lows, highs) + (1 - beta) * np.where(own > 0, 1 - (own + 1) / (totals + 1), 1.0)
            at = kids[N.choose(cost, N.volumes(lows, highs))]
        assert got[u["trajectory_id"], u["unit_index"]] == at


def test_insertion_into_nothing_much(spark, unit):
    few = unit.orderBy("trajectory_id", "unit_index").limit(5).persist()
    rest = unit.join(few.select("trajectory_id", "unit_index"), ["trajectory_id", "unit_index"], "left_anti")
    x = I.insert(I.build(few, _config(layout="str_plain")), rest)
    assert x.size == unit.count() and x.nodes.where("level = 0").agg(F.max("n_entries")).first()[0] <= 20
    assert x.nodes.where(F.col("level") == x.height - 1).count() == 1
    same = I.insert(x, unit.where("false"))
    leaf = lambda i: {frozenset(map(tuple, r["o"])) for r in i.units.groupBy("leaf_id").agg(F.collect_list(F.struct("trajectory_id", "unit_index")).alias("o")).collect()}
    assert leaf(same) == leaf(x)


@pytest.mark.parametrize("cut", [1704100000, 1705300000])
def test_attached_trees_of_unlike_height(spark, unit, cut):
    a, b = (I.build(unit.where(c), _config()) for c in (f"t0 < {cut}", f"t0 >= {cut}"))
    for x, y in ((a, b), (b, a)):
        both = I.attach(x, y)
        assert both.height == max(a.height, b.height) + 1 and both.size == a.size + b.size
        assert both.nodes.where(F.col("level") == both.height - 2).count() == 2
        orphans = both.nodes.where(F.col("level") < both.height - 1).select((F.col("level") + 1).alias("level"), F.col("parent_id").alias("node_id")).join(both.nodes, ["level", "node_id"], "left_anti")
        assert orphans.count() == 0
    empty = I.Index(unit.where("false"), a.nodes.where("false"), a.postings.where("false"), None, a.config, 1, 0)
    assert I.attach(a, empty) is a and I.attach(empty, b).size == b.size
    with pytest.raises(ValueError):
        I.attach(a, I.build(unit, _config(leaf_fanout=30)))


def test_ranks_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(L, "ROWS_PER_PARTITION", 50)
    rows = spark.range(700).select(F.xxhash64("id").alias("v"), "id")
    got = sorted(map(tuple, L.global_rank(rows, ["v", "id"], "r", L.parts_for(700)).select("v", "r").collect()))
    assert [r for _, r in got] == list(range(700)) and L.parts_for(10**12) == L.MAX_PARTITIONS


def test_slices_by_ranks(spark, unit, monkeypatch):
    want = [tuple(r) for r in unit.orderBy("trajectory_id", "unit_index").collect()]
    monkeypatch.setattr(U, "SLICE", 0)
    monkeypatch.setattr(L, "ROWS_PER_PARTITION", 100)
    for a, n in ((0, 10), (100, 250), (900, None), (985, None)):
        assert sorted(map(tuple, U.offset_limit(unit, a, n).collect())) == want[a : None if n is None else a + n]


def test_points_meet_activities_of_their_time(spark):
    points = spark.createDataFrame([(1, i, 10 * i) for i in range(60)] + [(2, 100, 5), (None, 101, 5)], "u long, id long, t long")
    acts = spark.createDataFrame([(1, 1, 0, 1, "a"), (1, 2, 35, 400, "b"), (1, 3, 30, 60, "c"), (1, 4, 90, 80, "never"), (1, 5, 590, 590, "e"), (2, 6, 0, 4, "f")], "u long, line int, begin long, end long, name string")
    got = {r["id"]: r["name"] for r in J.label_points(points, acts, "u", ["id"]).collect()}
    for i in range(60):
        held = sorted((b, line, n) for line, b, e, n in ((1, 0, 1, "a"), (2, 35, 400, "b"), (3, 30, 60, "c"), (5, 590, 590, "e")) if b <= 10 * i <= e)
        assert got[i] == (held[0][2] if held else None)
    assert got[100] is None and got[101] is None and len(got) == 62
    assert J.label_points(points, acts.where("false"), "u", ["id"]).where("name is not null").count() == 0


def test_quickload_leaves_grow_with_memory():
    assert L.quickload_leaves(0) == 2 and L.quickload_leaves(1 << 20) > L.quickload_leaves(1 << 16)


def test_descent_by_arrays_joins_and_both(spark, unit, monkeypatch):
    """The levels that go to tasks as arrays choose as the joins do; with all of them shipped no pair is shuffled."""
    x = I.build(unit.where("t0 < 1705300000"), _config(beta=0.4))
    probe = unit.where("t0 >= 1705300000").withColumn("label_id", F.when(F.col("unit_index") % 7 == 0, None).when(F.col("unit_index") % 5 == 0, 99).otherwise(F.col("label_id")))
    got = []
    for shipped in (10**6, 40, 0):
        monkeypatch.setattr(I, "SHIPPED", shipped)
        df = I.descend(x, probe)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert ("__children" in plan) == (shipped < 10**6) and ("MapInArrow" in plan) == (shipped > 0)
        got.append(sorted((r["trajectory_id"], r["unit_index"], r["leaf_id"]) for r in df.collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == probe.count()
