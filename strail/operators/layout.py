"""Physical layouts: which leaf each unit belongs to.

Ranks over a whole table are found without a single-partition window: rows are range-partitioned and sorted, a row's
place is its partition's offset plus its place there, and one small aggregate gives the offsets. Within slabs of known
size the same ranks serve again, so Sort-Tile-Recursive sorts each dimension by range and never has one task per slab.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strail.functions.geometry import unit_center, unit_extend_agg
from strail.functions.hilbert import hilbert_column, scaled
from strail.operators.insertion import Tree
from strail.operators.stored import keep

LEAF = 113
TIES = ["trajectory_id", "unit_index"]
STR_ORDERS = {"plain": ["xc", "yc", "tc"], "lf": ["label_id", "xc", "yc", "tc"], "ll": ["xc", "yc", "tc", "label_id"]}
ROWS_PER_PARTITION, MAX_PARTITIONS = 200_000, 10_000


def parts_for(n: int) -> int:
    """Range partitions of about ROWS_PER_PARTITION rows; beyond MAX_PARTITIONS they grow, and their sorts spill."""
    return min(MAX_PARTITIONS, max(1, -(-n // ROWS_PER_PARTITION)))


def global_rank(df: DataFrame, order: list[str], out: str, parts: int) -> DataFrame:
    """df with each row's place (from 0) in the total order of `order`, which must tell all rows apart.

    The sorted rows are kept: range bounds are drawn anew by each execution, and offsets must be those of the same one.
    """
    if parts == 1:
        ordered = df.coalesce(1).sortWithinPartitions(*order)
        return ordered.withColumn(out, F.monotonically_increasing_id())
    ordered = keep(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).cast("int")
    sizes = dict(ordered.groupBy(part.alias("p")).count().collect())  # a row for each partition, MAX_PARTITIONS at most
    starts = np.cumsum([0, *(sizes.get(p, 0) for p in range(parts))])[:-1].tolist()
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(starts)), "__part int, __offset long"))
    place = F.col("__offset") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("__part", part).join(offsets, "__part").withColumn(out, place).drop("__id", "__part", "__offset")


def slab_size(n: Column, leaf: int, exponent: float) -> Column:
    leaves = F.ceil(n / F.lit(float(leaf)))
    return F.lit(leaf) * F.greatest(F.lit(1).cast("long"), F.ceil(F.round(F.pow(leaves.cast("double"), F.lit(exponent)), 9)).cast("long"))


def str_layout(units: DataFrame, mode: str = "lf", leaf: int = LEAF, dims: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Sort-Tile-Recursive: units with leaf_id. Modes: plain, lf (label first), ll (label last); ties by trajectory and index.

    n is the number of units, where it is known.
    """
    names = dims or STR_ORDERS[mode]
    rows = units.select("*", *unit_center())
    n = rows.count() if n is None else n
    parts, slabs, size = parts_for(n), [], None
    rows = rows.withColumn("__n", F.lit(n).cast("long")).withColumn("__start", F.lit(0).cast("long"))
    for k, dim in enumerate(names):
        rows = global_rank(rows, [*slabs, dim, *TIES], "__rank", parts)
        if k == len(names) - 1:
            break
        size = slab_size(F.col("__n"), leaf, (len(names) - k - 1) / (len(names) - k))
        inside = F.col("__rank") - F.col("__start")
        slab = F.floor(inside / size).cast("long")
        rows = rows.withColumn("__size", size).withColumn(f"__slab{k}", slab)
        rows = rows.withColumn("__begin", F.col(f"__slab{k}") * F.col("__size"))
        rows = rows.withColumn("__start", F.col("__start") + F.col("__begin")).withColumn("__n", F.least("__size", F.col("__n") - F.col("__begin")))
        slabs.append(f"__slab{k}")
    return rows.withColumn("leaf_id", F.floor(F.col("__rank") / leaf).cast("long")).select(*units.columns, "leaf_id")


def with_hilbert(units: DataFrame, bits: int = 16) -> DataFrame:
    """units with `h`, the Hilbert index of their centre over the box of all of them (one row, joined as a broadcast)."""
    box = units.agg(*unit_extend_agg("__"))
    rows = units.select("*", *unit_center()).crossJoin(F.broadcast(box))
    cols = [scaled(F.col(f"{a}c"), F.col(f"__{a}min"), F.col(f"__{a}max"), bits) for a in "xyt"]
    return rows.withColumn("h", hilbert_column(cols, bits)).select(*units.columns, "h")


def pack_by_volume(low: np.ndarray, high: np.ndarray, leaf: int = LEAF, growth: float = 1.2) -> np.ndarray:
    """Leaf number of each row in order: half a leaf at least, then on while the box stays within 1.2 times its volume."""
    n, out, start, number = len(low), np.empty(len(low), np.int64), 0, 0
    while start < n:
        end = min(n, start + max(1, leaf // 2))
        lo, hi = low[start:end].min(axis=0), high[start:end].max(axis=0)
        most = growth * float(np.prod(hi - lo))
        while end < n and end - start < leaf:
            lo2, hi2 = np.minimum(lo, low[end]), np.maximum(hi, high[end])
            if float(np.prod(hi2 - lo2)) > most:
                break
            lo, hi, end = lo2, hi2, end + 1
        out[start:end] = number
        start, number = end, number + 1
    return out


def _corners(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    a, b = pdf[["x0", "y0", "t0"]].to_numpy(np.float64), pdf[["x1", "y1", "t1"]].to_numpy(np.float64)
    return np.minimum(a, b), np.maximum(a, b)


def hilbert_layout(units: DataFrame, leaf: int = LEAF, bits: int = 16) -> DataFrame:
    """Units in Hilbert order, packed into leaves within each range partition; leaf_id orders leaves along the curve."""
    rows = with_hilbert(units, bits)
    parts = parts_for(units.count())
    ordered = rows.repartitionByRange(parts, "h", *TIES).sortWithinPartitions("h", *TIES).withColumn("__p", F.spark_partition_id())

    def pack(batches):
        got = [b for b in batches if len(b)]  # one range partition; its size is bounded by the number of partitions
        if got:
            pdf = pd.concat(got, ignore_index=True)
            pdf["leaf_id"] = pdf["__p"].astype("int64") * (1 << 33) + pack_by_volume(*_corners(pdf), leaf)
            yield pdf.drop(columns=["__p", "h"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema) + ", leaf_id long"
    return ordered.mapInPandas(pack, schema)


def obo_layout(units: DataFrame, leaf: int = LEAF, internal: int = 127, beta: float = 0.5, tile_rows: int = 20_000, mode: str = "normal") -> DataFrame:
    """Leaves of trees built by inserting one by one (cost-driven path, quadratic split).

    Insertion is sequential; units are first cut into tiles of bounded size by Sort-Tile-Recursive, and each tile grows a
    tree of its own. With one tile this is the tree that the whole input, in order of its ids, would give.
    """
    n = units.count()
    tiles = str_layout(units, "plain", tile_rows, n=n).withColumnRenamed("leaf_id", "__tile")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIES, ignore_index=True)
        tree = Tree(leaf, internal, beta, mode)
        low, high = _corners(pdf)
        for i, label in enumerate(pdf["label_id"].to_numpy()):
            tree.insert(i, low[i], high[i], {int(label): 1})
        pdf["leaf_id"] = pdf["__tile"].astype("int64") * (1 << 33) + tree.leaf_numbers(len(pdf))
        return pdf.drop(columns="__tile")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema) + ", leaf_id long"
    return tiles.repartition(_tasks(-(-n // tile_rows)), "__tile").groupBy("__tile").applyInPandas(grow, schema)


def _tasks(tiles: int) -> int:
    """A task for each tile or so: growing a tree takes long for its few bytes, by which tiles would be put together."""
    return min(MAX_PARTITIONS, max(1, tiles))


def quickload_leaves(memory_bytes: int, internal: int = 127, label_bytes: int = 64) -> int:
    """Leaves that a routing tree of so much memory may have: six doubles and a histogram for each, and the nodes above them."""
    each = 48 + label_bytes
    return max(2, int(memory_bytes / (each * (1 + 1 / (internal - 1)))))


def quickload_layout(units: DataFrame, leaf: int = LEAF, beta: float = 0.5, sample: int = 4000, tile_rows: int = 20_000, internal: int = 127, mode: str = "normal") -> DataFrame:
    """Leaves by routing through a tree of a bounded sample, then splitting each bucket by inserting one by one.

    The sample's tree has few leaves and goes to all workers; each unit is routed by cost to one of them. Buckets of more
    than tile_rows units are cut into tiles first, so no group is larger than that.
    """
    rows = units.orderBy(F.xxhash64(*TIES)).limit(sample).toPandas()  # bounded by `sample`
    tree = Tree(max(2, len(rows) // 64 or 2), internal, beta, mode)
    low, high = _corners(rows)
    for i, label in enumerate(rows["label_id"].to_numpy()):
        tree.insert(i, low[i], high[i], {int(label): 1})
    router = tree.router()
    shared = units.sparkSession.sparkContext.broadcast(router)

    def route(batches):
        for pdf in batches:
            lo, hi = _corners(pdf)
            yield pdf.assign(__bucket=shared.value.route(lo, hi, pdf["label_id"].to_numpy()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
    routed = keep(units.mapInPandas(route, f"{schema}, __bucket long"))  # read twice; routed once
    sizes = routed.groupBy("__bucket").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("__tiles"))
    tiled = routed.join(sizes, "__bucket").withColumn("__tile", F.pmod(F.xxhash64("trajectory_id", F.expr("unit_index DIV 64")), F.col("__tiles")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(TIES, ignore_index=True)
        own = Tree(leaf, internal, beta, mode)
        lo, hi = _corners(pdf)
        for i, label in enumerate(pdf["label_id"].to_numpy()):
            own.insert(i, lo[i], hi[i], {int(label): 1})
        pdf["leaf_id"] = pdf["__bucket"].astype("int64") * (1 << 40) + pdf["__tile"].astype("int64") * (1 << 20) + own.leaf_numbers(len(pdf))
        return pdf.drop(columns=["__bucket", "__tile", "__tiles"])

    tasks = _tasks(sizes.agg(F.sum("__tiles")).first()[0] or 1)
    return tiled.repartition(tasks, "__bucket", "__tile").groupBy("__bucket", "__tile").applyInPandas(grow, f"{schema}, leaf_id long")


LAYOUTS = {
    "str_plain": lambda u, leaf=LEAF, **_: str_layout(u, "plain", leaf),
    "str_lf": lambda u, leaf=LEAF, **_: str_layout(u, "lf", leaf),
    "str_ll": lambda u, leaf=LEAF, **_: str_layout(u, "ll", leaf),
    "hilbert": lambda u, leaf=LEAF, **_: hilbert_layout(u, leaf),
    "obo": lambda u, leaf=LEAF, beta=0.5, internal=127, mode="normal": obo_layout(u, leaf, internal, beta, mode=mode),
    "quickload": lambda u, leaf=LEAF, beta=0.5, internal=127, mode="normal": quickload_layout(u, leaf, beta, internal=internal, mode=mode),
}


def apply_layout(units: DataFrame, name: str, leaf: int = LEAF, beta: float = 0.5, internal: int = 127, mode: str = "normal") -> DataFrame:
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout {name}")
    return LAYOUTS[name](units, leaf=leaf, beta=beta, internal=internal, mode=mode)


def pack_points(points: DataFrame, method: str, leaf: int = 16, key: str = "id") -> DataFrame:
    """2-D points (id, x, y) with leaf_id, `leaf` of them a leaf: `hilbert` (16 bits an axis) or `str` (columns, then rows)."""
    n = points.count()
    if method == "hilbert":
        box = points.agg(*[f(a).alias(f"__{a}{m}") for a in "xy" for f, m in ((F.min, "min"), (F.max, "max"))])
        cells = [scaled(F.col(a), F.col(f"__{a}min"), F.col(f"__{a}max")) for a in "xy"]
        rows, order = points.crossJoin(F.broadcast(box)).withColumn("__h", hilbert_column(cells, 16)), ["__h", key]  # one row
    elif method == "str":
        size = leaf * max(1, int(np.ceil(round(float(np.sqrt(np.ceil(n / leaf))), 9))))
        rows = global_rank(points, ["x", "y", key], "__x", parts_for(n)).withColumn("__slab", F.floor(F.col("__x") / size))
        order = ["__slab", "y", "x", key]
    else:
        raise ValueError(f"unknown method {method}")
    return global_rank(rows, order, "__place", parts_for(n)).withColumn("leaf_id", F.floor(F.col("__place") / leaf).cast("long")).select(*points.columns, "leaf_id")
