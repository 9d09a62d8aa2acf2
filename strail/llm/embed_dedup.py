"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

The cells only steer the search; the links are exact. For a vector x of cell c and any y of cell d with an angle of at
most t between them, the plane that halves c and d is within t of x, so x.(c - d) <= sin(t) |c - d|. Each vector
visits every smaller cell for which this holds; so each linked pair meets in the smaller of its two cells. Labels of
few vectors are one cell each, and need no centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strail.llm.blocks import compare
from strail.llm.common import discard, materialize
from strail.llm.components import connected_components

SAMPLE = 20_000  # vectors that the centroids are fitted on, about
CELL_ROWS = 2048  # vectors a cell is meant to hold
CHUNK_ROWS, SLAB = 4096, 512  # vectors of a cell, with its visitors, that are compared at once; rows of a product
MAX_CELLS = 4096  # of all labels together, as each task holds the centroids; beyond it cells grow and are compared in more chunks


def fit_cells(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centroids (unit length, double) of spherical k-means; cells that lose all rows keep their centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 1e-12, s / np.maximum(n, 1e-12), c)
    return c


def _matrix(column: pd.Series, kind: np.dtype) -> np.ndarray:
    """The packed vectors as rows of unit length, in double precision."""
    x = np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _packed(lists: pa.Array, kind: np.dtype) -> pa.Array:
    """The bytes of each vector; null for those that are null, empty or zero or hold null or non-finite parts."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    stop = np.cumsum(size)
    start, some = stop - size, size > 0
    ok = some.copy()
    if some.any():
        ok[some] = ~np.logical_or.reduceat(~np.isfinite(values), start[some]) & np.logical_or.reduceat(values != 0, start[some])
    data, w = values.tobytes(), kind.itemsize
    return pa.array([data[x * w : y * w] if good else None for x, y, good in zip(start.tolist(), stop.tolist(), ok.tolist(), strict=True)], pa.binary())


def _nodes(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """rows with `node`, a hash of label and vector that no two unlike ones share, and the distinct ones (by, x, node, least, n)."""
    for seed in range(8):
        known = materialize(rows.withColumn("node", F.when(valid, F.xxhash64("by", "x", F.lit(seed)))), "vectors")
        classes = known.where("node is not null").groupBy("by", "x", "node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
        classes = materialize(classes, "classes")
        if classes.groupBy("node").count().where("count > 1").isEmpty():
            return known, classes
        discard(known)
        discard(classes)
    raise RuntimeError("hashes of unlike vectors collide for eight seeds")


def _centroids(classes: DataFrame, kind: np.dtype) -> dict[tuple[int, str], np.ndarray]:
    """Centroids of each (bytes of a vector, label) with more vectors than a cell is meant to hold; MAX_CELLS in all at most."""
    group = classes.groupBy(F.length("x").alias("d"), "by").agg(F.count(F.lit(1)).alias("n"))
    rows = max(CELL_ROWS, classes.count() // MAX_CELLS)
    large = {(r["d"], r["by"]): r["n"] for r in group.where(F.col("n") > rows).collect()}  # as many as cells at most
    if not large:
        return {}
    share = min(1.0, SAMPLE / sum(large.values()))
    names = classes.sparkSession.createDataFrame([(d, by) for d, by in large], "d int, by string")
    drawn = classes.where(F.pmod("node", F.lit(1_000_000)) < share * 1e6).select(F.length("x").alias("d"), "by", "x")
    got = drawn.join(F.broadcast(names), ["d", "by"]).orderBy("d", "by", "x").toPandas()
    return {k: fit_cells(_matrix(part["x"], kind), min(len(part), -(-large[k] // rows))) for k, part in got.groupby(["d", "by"])}


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", by: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors.

    Rows link when `by` is equal and not null and the cosine in double precision is at least the threshold. Vectors
    that are null, empty, zero or hold null or non-finite parts link with nothing, nor do vectors of unlike length.
    Rows that repeat an id are rows of their own for n_links, but share the id's component; a null id links with
    nothing. Copies of one vector are one node, counted as often as they occur. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    id_kind = vectors.schema[id_col].dataType.simpleString()
    kind = np.dtype("<f4") if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else np.dtype("<f8")
    listed = F.col(vec_col).cast("array<float>" if kind.itemsize == 4 else "array<double>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _packed(b.column(1), kind)], names=["id", "by", "x"])

    rows = vectors.select(F.col(id_col).alias("id"), listed.alias("v"), F.col(by).cast("string").alias("by")).mapInArrow(pack, f"id {id_kind}, by string, x binary")
    rows, classes = _nodes(rows, F.col("id").isNotNull() & F.col("by").isNotNull() & F.col("x").isNotNull())
    shared = spark.sparkContext.broadcast(_centroids(classes, kind))
    slack = float(np.sqrt(max(0.0, 1 - threshold * threshold))) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, gaps = shared.value, {}
        for b in batches:
            for key, part in b.to_pandas().groupby([pc.binary_length(b.column(1)).to_numpy(), "by"], sort=False):
                c = cells.get(key)
                cell, home, at = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.arange(len(part))
                if c is not None:
                    if key not in gaps:
                        square = (c * c).sum(axis=1)
                        gaps[key] = np.sqrt(np.maximum(0, square[:, None] + square[None] - 2 * (c @ c.T))) + 1e-7
                    dots = _matrix(part["x"], kind) @ c.T
                    home = np.argmax(dots, axis=1)
                    margin = dots[np.arange(len(dots)), home][:, None] - dots
                    at, cell = np.nonzero((margin <= slack * gaps[key][home] + 1e-12) & (np.arange(len(c)) <= home[:, None]))
                part = part.iloc[at]
                part = part.assign(cell=[f"{key[0]}:{i}:{key[1]}" for i in cell], home=cell == home[at])
                yield pa.RecordBatch.from_pandas(part[["cell", "home", "node", "w", "x"]], preserve_index=False)

    placed = classes.select("by", "x", "node", F.col("n").alias("w")).mapInArrow(place, "cell string, home boolean, node long, w long, x binary")
    placed = materialize(placed, "placed")

    def near(unit: pd.DataFrame) -> np.ndarray:
        x = _matrix(unit["x"], kind)
        out = np.empty((len(x), len(x)), bool)
        for a in range(0, len(x), SLAB):  # each pair once, so both sides say the same
            out[a : a + SLAB, : a + SLAB] = x[a : a + SLAB] @ x[: a + SLAB].T >= threshold
            own = np.tril(out[a : a + SLAB, a : a + SLAB])
            out[a : a + SLAB, a : a + SLAB] = own | own.T
            out[:a, a : a + SLAB] = out[a : a + SLAB, :a].T
        return out

    found = materialize(compare(placed, ["x"], near, CHUNK_ROWS), "links")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.select("node", "least", "n").join(links, "node", "left").join(roots, "node", "left")
    joined = materialize(joined.select("node", "least", "n", "links", F.coalesce("root", "node").alias("root")), "joined")
    least = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    final = joined.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    final = materialize(final, "final")
    out = rows.select("id", "node").join(final, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
