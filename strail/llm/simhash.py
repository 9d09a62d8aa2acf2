"""SimHash near-duplicates by anchor-point covering.

A fingerprint of 64 bits is cut into two blocks of 23 bits and one of 18. Two fingerprints that differ in at most four
bits differ in at most one bit of one of the first two blocks, or not at all in the third (else 2 + 2 + 1 = 5). The
anchors of a 23-bit block are the words of the perfect Golay code (covering radius 3); those of the 18-bit block are
all of its values (radius 0). Each fingerprint lives at the one anchor within the covering radius, and is copied to
each anchor within radius plus threshold (3 + 1, or 0 + 0) that is smaller than its own; a pair of different homes is
thus met at the smaller home, and nowhere is a pair lost. Only distinct fingerprints are compared.

A block has 4,096 anchors, so cells grow with the corpus. A cell of more than SPLIT fingerprints is divided once more,
by the bits outside its block: two of its fingerprints differ there in at most four bits, so they differ in at most one
bit of one of two sub-blocks, or not at all in the rest (else 2 + 2 + 1 = 5). Each fingerprint goes to its three values
and, for the two, to those that lack one of its ones. That is about 17 rows for each, however large the cell was.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strail.llm.blocks import BLOCK, compare
from strail.llm.common import materialize, own_names, text_of
from strail.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4
SPLIT = 17 * BLOCK  # beyond it comparing a cell in chunks takes more copies than dividing it
GOLAY = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the (23, 12) code


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the XXH64 of all word shingles; texts of fewer words are one shingle, texts of none give zero."""
    tokens = text.lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not tokens:
        return 0
    line = b" ".join(tokens)
    starts = np.zeros(len(tokens), np.int64)
    np.cumsum(np.fromiter(map(len, tokens[:-1]), np.int64, len(tokens) - 1) + 1, out=starts[1:])
    n = max(1, len(tokens) - words + 1)
    ends = np.r_[starts[words : words + n - 1] - 1, len(line)] if len(tokens) > words else np.array([len(line)])
    pieces = map(line.__getitem__, map(slice, starts[:n].tolist(), ends.tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: the fingerprint as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.encode()) for t in map(str, b.column(1).to_pylist())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


@lru_cache(1)
def golay_patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to 4 by syndrome: patterns, first place of each syndrome, and the pattern of weight up to 3."""

    def syndrome(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    by: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            p = sum(1 << b for b in bits)
            by[syndrome(p)].append(p)
    home = np.array([x[0] for x in by], np.int64)  # the code is perfect: one pattern of weight 0 to 3 each
    return np.array([p for x in by for p in x], np.int64), np.r_[0, np.cumsum([len(x) for x in by])], home


@lru_cache(1)
def _syndromes() -> np.ndarray:
    x = np.arange(1 << 23, dtype=np.int32)
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, np.int32(GOLAY << (bit - 11)), np.int32(0))
    return x.astype(np.int16)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index into fp, cell, home): each fingerprint at its home anchors and as visitor at smaller anchors near it."""
    patterns, first, home_of = golay_patterns()
    index, cells, homes = [], [], []
    u = fp.view(np.uint64)
    for block in range(2):
        x = (u >> np.uint64(23 * block) & np.uint64((1 << 23) - 1)).astype(np.int64)
        s = _syndromes()[x]
        home = x ^ home_of[s]
        n = first[s + 1] - first[s]
        at = np.repeat(np.arange(len(x)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s], n)
        anchor = x[at] ^ patterns[place]
        keep = anchor <= home[at]
        index.append(at[keep])
        cells.append(anchor[keep] * 4 + block)
        homes.append(anchor[keep] == home[at][keep])
    index.append(np.arange(len(u)))
    cells.append((u >> np.uint64(46)).astype(np.int64) * 4 + 2)
    homes.append(np.ones(len(u), bool))
    return np.concatenate(index), np.concatenate(cells), np.concatenate(homes)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        index, cell, home = anchors(fp)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home), pa.array(fp[index]), pa.array(np.ones(len(index), np.int64))], names=["cell", "home", "node", "w"])


def sub_cells(fp: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index into fp, cell, home) of fingerprints in large cells, at the values of the bits outside the cell's block."""
    u, block = fp.view(np.uint64), cell & 3
    low, high = u & np.uint64((1 << 23) - 1), u >> np.uint64(46)
    rest = np.select([block == 0, block == 1], [u >> np.uint64(23), low | high << np.uint64(23)], u & np.uint64((1 << 46) - 1)).astype(np.int64)
    all_of = np.arange(len(u))
    index, cells, homes = [], [], []
    for part, value in enumerate((rest & 0x3FFF, rest >> 14 & 0x3FFF, rest >> 28)):
        base = (cell * 4 + part + 1) << 18
        index.append(all_of)
        cells.append(base + value)
        homes.append(np.ones(len(u), bool))
        for bit in range(14 if part < 2 else 0):
            at = np.flatnonzero(value >> bit & 1)
            index.append(at)
            cells.append(base[at] + (value[at] ^ 1 << bit))
            homes.append(np.zeros(len(at), bool))
    return np.concatenate(index), np.concatenate(cells), np.concatenate(homes)


def _sub_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        index, cell, home = sub_cells(fp, b.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home), pa.array(fp[index]), pa.array(np.ones(len(index), np.int64))], names=["cell", "home", "node", "w"])


def split_large(cells: DataFrame, most: int) -> DataFrame:
    """cells with those of more than `most` rows divided. There a pair may meet twice, so links can't be counted after it."""
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("cell")
    large = F.broadcast(materialize(large, "large"))  # as many as anchors at most, and as rows by `most`
    parts = cells.join(large, "cell", "left_semi").select("node", "cell").mapInArrow(_sub_cells, "cell long, home boolean, node long, w long")
    small = cells.join(large, "cell", "left_anti").select((F.col("cell") * 4 * (1 << 18)).alias("cell"), "home", "node", "w")
    return materialize(small.union(parts), "split")


def _near(unit: pd.DataFrame) -> np.ndarray:
    x = unit["node"].to_numpy().view(np.uint64)
    near = np.empty((len(x), len(x)), bool)
    for a in range(0, len(x), 256):
        near[a : a + 256] = np.bitwise_count(x[a : a + 256, None] ^ x[None, :]) <= DISTANCE
    return near


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs; component_id is the smallest id of those reachable by links.

    Null and empty texts have fingerprint zero. Repeated rows and ids each keep their row. A null id is no candidate for
    the smallest one (a component of null ids only has none). An empty table gives an empty one.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    cells = materialize(classes.select("fp").mapInArrow(_cells, "cell long, home boolean, node long, w long"), "cells")
    links = materialize(compare(split_large(cells, SPLIT), [], _near), "links")
    roots = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, "joined")
    least = materialize(joined.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    final = materialize(joined.join(least, "root").select("fp", "component_id"), "final")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(final, "fp").select(F.col("id").alias(id_col), hexed, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, and of rows that share it the one of smallest text.

    Rows of a component that has null ids only all stay, as nothing tells them apart.
    """
    own, n, row = own_names(docs.columns + ["component_id"], "own_id", "n", "row")
    found = simhash_components(docs.select(id_col, text_col), id_col, text_col).select(F.col(id_col).alias(own), "component_id")
    found = found.where(F.col(own).eqNullSafe(F.col("component_id")))
    ids = materialize(found.groupBy(own).agg(F.count(F.lit(1)).alias(n)), "kept")
    same = F.col(id_col).eqNullSafe(F.col(own))
    once = docs.join(ids.where(f"{n} = 1 or {own} is null").select(own).hint("merge"), same, "left_semi")  # ids grow with the corpus
    twice = ids.where(f"{n} > 1 and {own} is not null").select(own)
    if twice.isEmpty():
        return once
    order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first())
    first = docs.join(twice, same, "left_semi").withColumn(row, F.row_number().over(order)).where(f"{row} = 1").drop(row)
    return once.unionByName(first)
