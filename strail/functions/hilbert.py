"""Hilbert curve of any dimension, vectorized over rows (Hamilton's compact state: entry point and direction).

The index of a point is built from its top bits down. State (e, d) says how the sub-cube that holds the point is
turned; the bits of one plane are turned back, read as a Gray code, and the state moves on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gray(i: np.ndarray) -> np.ndarray:
    return i ^ i >> 1


def gray_inverse(g: np.ndarray, bits: int) -> np.ndarray:
    out, shift = g, 1
    while shift < bits:
        out, shift = out ^ out >> shift, shift * 2
    return out


def _turn(v: np.ndarray, by: np.ndarray, n: int, left: bool) -> np.ndarray:
    by = by % n
    by = by if left else (n - by) % n
    return (v << by | v >> (n - by)) & ((1 << n) - 1)


def entry_point(i: np.ndarray) -> np.ndarray:
    return np.where(i == 0, 0, gray(np.maximum(2 * ((i - 1) // 2), 0)))


def _trailing_ones(i: np.ndarray) -> np.ndarray:
    zero = ~i & (i + 1)  # the lowest bit that is not set
    return np.log2(np.maximum(zero, 1)).astype(np.int64)


def direction(i: np.ndarray, n: int) -> np.ndarray:
    return np.where(i == 0, 0, np.where(i % 2 == 0, _trailing_ones(np.maximum(i - 1, 0)), _trailing_ones(i)) % n)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    w = np.arange(1 << n, dtype=np.int64)
    return entry_point(w).astype(np.int64), direction(w, n).astype(np.int64)


def hilbert_index(coords: list[np.ndarray], bits: int) -> np.ndarray:
    """Index of each point; coords: one array of integers in [0, 2^bits) for each dimension."""
    n = len(coords)
    entries, turns = _tables(n)
    coords = [np.asarray(c, np.int64) for c in coords]
    e, d, h = (np.zeros(len(coords[0]), np.int64) for _ in range(3))
    for b in range(bits - 1, -1, -1):
        plane = np.zeros_like(h)
        for j, c in enumerate(coords):
            plane |= (c >> b & 1) << j
        w = gray_inverse(_turn(plane ^ e, d + 1, n, left=False), n)
        e = e ^ _turn(entries[w], d + 1, n, left=True)
        d = (d + turns[w] + 1) % n
        h = h << n | w
    return h


def hilbert_point(index: np.ndarray, dims: int, bits: int) -> list[np.ndarray]:
    entries, turns = _tables(dims)
    index = np.asarray(index, np.int64)
    e, d = np.zeros_like(index), np.zeros_like(index)
    out = [np.zeros_like(index) for _ in range(dims)]
    for b in range(bits - 1, -1, -1):
        w = index >> (b * dims) & ((1 << dims) - 1)
        plane = _turn(gray(w), d + 1, dims, left=True) ^ e
        for j in range(dims):
            out[j] |= (plane >> j & 1) << b
        e = e ^ _turn(entries[w], d + 1, dims, left=True)
        d = (d + turns[w] + 1) % dims
    return out


def hilbert_column(cols: list[Column], bits: int = 16) -> Column:
    """The index of integer columns as a long, in Arrow batches."""

    @F.pandas_udf("long")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([s.to_numpy() for s in series], bits))

    return run(*cols)


def curve(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """All points of a curve: (h, c0, c1, ...)."""
    names = [f"c{i}" for i in range(dims)]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["id"], **dict(zip(names, hilbert_point(pdf["id"].to_numpy(), dims, bits), strict=True))})

    return spark.range(1 << (dims * bits)).mapInPandas(run, "h long, " + ", ".join(f"{n} long" for n in names))


def scaled(value: Column, low: Column, high: Column, bits: int = 16) -> Column:
    """floor((v - low) / (high - low) * (2^bits - 1)); a range of no width counts as 1."""
    d = F.when(high == low, F.lit(1.0)).otherwise((high - low).cast("double"))
    return F.floor((value - low).cast("double") / d * F.lit(float((1 << bits) - 1))).cast("long")
