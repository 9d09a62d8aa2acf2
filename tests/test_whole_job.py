"""Queries that once saw a sample only, against plain Python over all rows."""

from collections import defaultdict

import numpy as np

from strail.operators import index as I
from strail.operators import insertion as N
from strail.plans import catalogue as C

SF = "/root/testdata/sf0.001"


def test_id_sets_hold_all_units(spark):
    ids = defaultdict(set)
    for r in C.units(spark, SF).select("label_id", "trajectory_id").collect():
        ids[r[0]].add(r[1])
    spans = defaultdict(list)
    for r in C.QUERIES["interval_set_build"](spark, SF).collect():
        spans[r["label_id"]].append((r["begin"], r["end"]))
    assert set(spans) == set(ids) and all(len(v) <= 8 and all(any(a <= i <= b for a, b in v) for i in ids[k]) for k, v in spans.items())
    held = C.QUERIES["bloom_roundtrip"](spark, SF).collect()
    assert {(r["label_id"], r["id"]) for r in held} == {(k, i) for k, v in ids.items() for i in v} and all(r["held"] for r in held)


def test_spans_are_of_all_customers(spark):
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/customer.parquet").collect():
        rows[r["c_mktsegment"]].append((2 * r["c_custkey"], 2 * r["c_custkey"] + r["c_nationkey"] % 2))
    gaps, trim = defaultdict(list), defaultdict(list)
    for r in C.QUERIES["k_smallest_gap"](spark, SF).collect():
        gaps[r["k"]].append((r["gap"], r["begin"]))
    for r in C.QUERIES["interval_set_trim"](spark, SF).collect():
        trim[r["k"]].append((r["begin"], r["end"]))
    for k, v in rows.items():
        v.sort()
        between = [(b[0] - a[1], a[0]) for a, b in zip(v, v[1:], strict=False)]
        assert sorted(gaps[k]) == sorted(between)[:4]
        assert len(trim[k]) == min(5, len(v)) and all(any(a <= x and y <= b for a, b in trim[k]) for x, y in v)


def test_descent_sees_every_trajectory_and_child(spark):
    unit = C.units(spark, SF)
    laid = C._laid(spark, SF)
    boxes = {r["node_id"]: r for r in I.leaf_boxes(laid).collect()}
    hist, first = defaultdict(dict), unit.where("unit_index = 0").collect()
    for r in I.histogram(laid).collect():
        hist[r["node_id"]][r["label_id"]] = r["count"]
    got = defaultdict(list)
    fanout = 4
    probe = unit.where("unit_index = 0").select("trajectory_id", "label_id", *C.G.unit_mbb("u_"))
    for r in C._descend(probe, I.leaf_boxes(laid), I.histogram(laid), fanout).collect():
        got[r["trajectory_id"], r["level"]].append(r)
    height = max(k[1] for k in got) + 1
    box = lambda ids: (np.min([[boxes[i][f"{a}min"] for a in "xyt"] for i in ids], axis=0), np.max([[boxes[i][f"{a}max"] for a in "xyt"] for i in ids], axis=0))
    for u in first:
        low, high = np.minimum([u["x0"], u["y0"], u["t0"]], [u["x1"], u["y1"], u["t1"]]), np.maximum([u["x0"], u["y0"], u["t0"]], [u["x1"], u["y1"], u["t1"]])
        parent = 0
        for level in reversed(range(height)):
            nodes = sorted({i // fanout**level for i in boxes if i // fanout ** (level + 1) == parent})
            rows = sorted(got[u["trajectory_id"], level], key=lambda r: r["node_id"])
            assert [r["node_id"] for r in rows] == nodes
            under = [[i for i in boxes if i // fanout**level == n] for n in nodes]
            lows, highs = (np.array(x) for x in zip(*map(box, under), strict=True))
            count = [sum(hist[i].get(u["label_id"], 0) for i in ids) for ids in under]
            total = [sum(sum(hist[i].values()) for i in ids) for ids in under]
            spatial = N.spatial_costs(low, high, lows, highs)
            textual = np.array([1 - (1 + c) / (1 + t) if c else 1.0 for c, t in zip(count, total, strict=True)])
            assert np.allclose([r["spatial"] for r in rows], spatial) and np.allclose([r["textual"] for r in rows], textual)
            parent = next(r["node_id"] for r in rows if r["chosen"])
            assert parent == nodes[N.choose(0.5 * spatial + 0.5 * textual, N.volumes(lows, highs))]
    assert len({k[0] for k in got}) == len(first) == len({r["trajectory_id"] for r in C.QUERIES["choose_child"](spark, SF).collect()})


def test_descents_equal_sql_beyond_two_levels(spark, tmp_path):
    """A tree of more than 256 leaves: the SQL takes the two lowest levels, the nodes of the upper one being the root's children."""
    import duckdb
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{SF}/events.parquet")
    copies = spark.range(33).select(F.col("id").alias("k"))
    events = events.crossJoin(copies).withColumns({"event_id": F.expr("event_id + k * 1000"), "user_id": F.expr("user_id + k * 15")}).drop("k")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("choose_child", "spatial_cost", "textual_cost", "cursor_children"):
        got, want = C.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(C.ORACLE_SQL[name]).df()
        rows = [sorted(map(tuple, df[sorted(want.columns)].values.tolist())) for df in (got, want)]
        assert rows[0] == rows[1] and rows[0], name


def test_descent_without_shipped_nodes(spark, monkeypatch):
    want = {n: sorted(map(tuple, C.QUERIES[n](spark, SF).collect())) for n in ("choose_child", "spatial_cost", "textual_cost")}
    monkeypatch.setattr(C, "SHIPPED", 0)
    assert want == {n: sorted(map(tuple, C.QUERIES[n](spark, SF).collect())) for n in want}
