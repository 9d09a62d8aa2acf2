"""Comparison of the rows of a cell in bounded blocks, for the operators that search near neighbours.

A row is (cell, home, node, w, payload): w vectors or documents are equal to the node; home rows belong to the cell, visitors were copied to it because a neighbour may
live there. Cells of more than `block` rows are cut into chunks by a hash of the node, and each pair of chunks becomes
a unit of its own; so no task ever holds more than two chunks. Units are packed into buckets to keep tasks few.
A unit returns, for each row with a link, the weight of its links there and the smallest node of its group there: a forest,
never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
BUCKET_ROWS = 12_000


def units(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (cell, home boolean, node long, w long, ...), written -> the same with unit_i, unit_j, chunk and bucket."""
    total = rows.count()
    large = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = large.select("cell", F.ceil(F.col("n") / block).cast("int").alias("s"))
    cut = rows.join(large, "cell", "left").withColumn("s", F.coalesce("s", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("s")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, s - 1)")))
    cut = cut.withColumns({"unit_i": F.least("chunk", "other"), "unit_j": F.greatest("chunk", "other")}).drop("other", "s")
    return cut.withColumn("bucket", F.pmod(F.xxhash64("cell", "unit_i", "unit_j"), F.lit(max(1, total // BUCKET_ROWS))))


def forest(near: np.ndarray, node: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near: symmetric boolean matrix without diagonal. Rows that have a link, the weight of their links, the smallest node of their group."""
    linked = near.any(axis=1)
    root, left = np.full(len(node), -1, np.int64), linked.copy()
    for at in np.argsort(node, kind="stable"):
        if not left[at]:
            continue
        group = np.zeros(len(node), bool)
        new = np.array([at])
        while len(new):
            group[new] = True
            new = np.flatnonzero(near[new].any(axis=0) & ~group)
        root[group] = node[at]
        left &= ~group
    has = np.flatnonzero(linked)
    return has, np.array([w[row].sum() for row in near[has]], np.int64), root[has]


def compare(rows: DataFrame, payload: list[str], matrix: Callable[[pd.DataFrame], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(node, root, links) for each row with a link in a unit; matrix(unit) says which of its rows are near each other."""

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = pdf.sort_values(["cell", "unit_i", "unit_j", "node"], kind="stable", ignore_index=True)
        key = pdf[["cell", "unit_i", "unit_j"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        ends = np.r_[starts[1:], len(pdf)]
        out = []
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            unit = pdf.iloc[a:b]
            home, chunk, node = unit["home"].to_numpy(), unit["chunk"].to_numpy(), unit["node"].to_numpy()
            near = matrix(unit) & (home[:, None] | home[None, :])
            if unit["unit_i"].iat[0] != unit["unit_j"].iat[0]:
                near &= chunk[:, None] != chunk[None, :]
            np.fill_diagonal(near, False)
            if near.any():
                has, links, root = forest(near, node, unit["w"].to_numpy())
                out.append(pd.DataFrame({"node": node[has], "root": root, "links": links}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"node": np.zeros(0, np.int64), "root": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})

    cut = units(rows, block).select("bucket", "cell", "unit_i", "unit_j", "chunk", "home", "node", "w", *payload)
    return cut.groupBy("bucket").applyInPandas(run, "node long, root long, links long")
