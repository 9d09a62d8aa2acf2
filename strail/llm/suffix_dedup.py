"""Repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. A transform of a whole corpus is no
distributed object, so strings that may be equal are first brought together; the transform then decides:

1. Anchors. Of the 64-byte grams in a window of `length` bytes the one of smallest hash (of equals the last) is the
   window's anchor: a function of the window's bytes alone, so equal windows have equal anchors at equal places.
   Neighbouring windows of one anchor form a segment. Windows of an anchor that occurs once have no equal.
2. Segments that are equal byte for byte (by a BLAKE2 digest) are one class with a count; all windows of a class of two
   or more repeat.
3. Distinct segments that share an anchor are put together, and the Burrows-Wheeler transform of their bytes is
   expanded backwards, breadth first: intervals of suffixes that start with common strings of growing length, each
   setting the border behind it. After `length` levels the borders that are still open are those between suffixes with
   a common prefix of `length` bytes or more; a window repeats if and only if it starts such a suffix.

An anchor with more than HOT distinct segments (a passage whose surroundings differ in thousands of documents) would
not fit one task. It is split by more context: its windows are cut into blocks of BLOCK, counted from the anchor, and
only blocks whose common bytes are equal stay together; a block whose common bytes occur once repeats nowhere, and the
others go through the same expansion. Common bytes with more than HOT surroundings of their own are split again, into
single windows: their whole bytes are context then, and nothing is left to expand. So no group that a task holds grows with
the corpus, and no window is left out.

What is joined grows with the corpus, so joins are sort-merge joins at every size (AQE splits skewed keys).
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strail.llm.common import arrow_bytes, discard, materialize, own_names, text_of

LENGTH, GRAM = 400, 64
HOT = 500  # distinct contents of one anchor, or of one block, that one task compares
BLOCK = 12  # windows of a block of a hot anchor
BUCKET_BYTES = 500_000
SLICE = 1_000_000
BASE = 0x9E3779B97F4A7C15
KEY_SYMBOLS = 7  # of 9 bits each in a long


def _prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (byte + 1) * BASE^i, modulo 2^64, and the inverse powers that move a difference of two to place 0."""
    n = len(data)
    power, inverse = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    power[0] = inverse[0] = 1
    power[1:], inverse[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return sums, inverse


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: row, first window (relative to the text), number of windows, anchor's place behind the first
    window's start, and anchor hash of each segment. The hash only brings windows together: unlike grams of one hash are
    compared in vain, and nothing is decided by it."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty.astype(np.uint64)
    sums, inverse = _prefix_hash(data)
    h = _mix((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    width, last = length - gram + 1, np.uint64((1 << 30) - 1)
    key = (h & ~last) | (last - np.arange(len(h), dtype=np.uint64))
    rows = np.concatenate([key, np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - width + 1
    anchor = (last - (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & last)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(n) + length <= offsets[1:][row])
    if not len(at):
        return empty, empty, empty, empty, empty.astype(np.uint64)
    a, r = anchor[at], row[at]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
    count = np.diff(np.r_[new, len(at)])
    return r[new], at[new] - offsets[r[new]], count, a[new] - at[new], h[a[new]]


def _slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes and the rank of each. Signs 0, 1, ... stand at `ends`; other symbols are len(ends) + byte.

    The first symbols are compared as one number, then the compared length doubles for all suffixes that are not yet
    alone; a comparison that reaches a sign is decided by it.
    """
    n, k = len(text), len(ends)
    owner = np.repeat(np.arange(k), np.diff(np.r_[-1, ends]))
    end_of, at = ends[owner], np.arange(n)
    symbol = np.where(text < k, 0, text - k + 1).astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(KEY_SYMBOLS):
        key <<= 9
        m = max(0, n - i)
        key[:m] += np.where(at[:m] + i <= end_of[:m], symbol[i : i + m], 0)
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    active, step = order[~(new & np.r_[new[1:], True])], KEY_SYMBOLS
    while len(active):
        behind = active + step
        second = np.where(behind <= end_of[active], rank[np.minimum(behind, n - 1)] + k, owner[active])
        own = rank[active]
        key = own * (n + k + 1) + second
        by = np.argsort(key)
        active, key, own = active[by], key[by], own[by]
        no = np.arange(len(active))
        place = own + no - np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], no, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        rank[active] = np.maximum.accumulate(np.where(new, place, 0))
        order[place] = active
        active, step = active[~(new & np.r_[new[1:], True])], step * 2
    return order, rank


def repeated_suffixes(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share a prefix of at least `length` symbols with another one; text and ends as for suffix_array().

    Level by level, the interval of each string is expanded by all symbols that stand before its suffixes. A longer
    string's interval sets the border behind it if that is still open: the suffixes on its two sides have exactly the
    level's length in common. One whose border is set already tells nothing new, nor does what comes from it. So each
    border is set once, and the intervals of all levels together are no more than the suffixes.
    """
    n, k = len(text), len(ends)
    order, rank = suffix_array(text, ends)
    before = order - 1  # of the first suffix the last sign
    bwt, last_first = text[before], rank[before].astype(np.int32)
    border = np.zeros(n + 1, bool)  # border[i]: the suffixes of ranks i - 1 and i differ before `length`
    border[0] = border[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for level in range(length):
        many = high - low + 1
        interval = np.repeat(np.arange(len(low)), many)
        at = np.arange(len(interval)) + np.repeat(low - (np.cumsum(many) - many), many)
        if level:  # a sign can only be the last symbol of a common string's extension
            real = bwt[at] >= k
            at, interval = at[real], interval[real]
        if not len(at):
            break
        to = last_first[at]
        by = np.argsort(to)
        to, interval, symbol = to[by], interval[by], bwt[at[by]]
        first = np.flatnonzero(np.r_[True, (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1])])
        low, high = to[first].astype(np.int64), to[np.r_[first[1:] - 1, len(to) - 1]].astype(np.int64)
        keep = ~border[high + 1]
        low, high = low[keep], high[keep]
        border[high + 1] = True
    out = np.zeros(n, bool)
    out[order] = ~border[:-1] | ~border[1:]
    return out


def repeated_windows(content: list[bytes], windows: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each of the distinct contents, which of its windows also start elsewhere among all."""
    size = np.array([len(c) + 1 for c in content], np.int64)
    ends = np.cumsum(size) - 1
    text = np.frombuffer(b"\0".join(content) + b"\0", np.uint8).astype(np.int32) + len(content)
    text[ends] = np.arange(len(content))
    flags, first = repeated_suffixes(text, ends, length), ends - size + 1
    return [flags[a : a + n] for a, n in zip(first.tolist(), windows.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _digests(data: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Two longs for each of the byte strings, which nobody can make equal for unlike ones."""
    blake = hashlib.blake2b
    own = b"".join([blake(data[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(own, np.int64).reshape(-1, 2)


def _release(spark: SparkSession) -> None:
    """Shuffle files go once the JVM sees that nothing refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def _each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 3: the owners 0, 0, 1, 1, 1 and the places 0, 1, 0, 1, 2."""
    own = np.repeat(np.arange(len(count)), count)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _binary(data: bytes, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    return pa.array([data[x:y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, runs_col: str = "runs") -> DataFrame:
    """docs, its text not null, with runs_col: array of (start, windows, sign), of which windows repeat and which don't; see spans_of().

    Rows are told apart by id and text; rows equal in both are documents of their own that repeat each other. `length`
    is more than GRAM. Columns of docs keep their names; helper columns take names that docs has not.
    """
    if length <= GRAM:
        raise ValueError(f"length must be more than {GRAM}")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    key_col, i_col, k_col = own_names(docs.columns + [runs_col], "key", "i", "k")
    source = docs.withColumn(text_col, text_of(text_col)).withColumn(key_col, F.xxhash64(text_col))
    texts = source.select(F.col(id_col).alias("id"), F.col(key_col).alias("key"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrow_bytes(b.column(2))
            for i, j in _slices(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                row, start, n, place, h = segments(part, own, length)
                first = own[row] + start
                g = _digests(part.tobytes(), first, first + n + length - 1)
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(h.view(np.int64)), pa.array(g[:, 0]), pa.array(g[:, 1]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))],
                    names=["id", "key", "h", "g1", "g2", "start", "n", "place"],
                )

    every = materialize(texts.mapInArrow(scan, f"id {kind}, key long, h long, g1 long, g2 long, start int, n int, place int"), "segments")
    again = materialize(every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "anchors")
    found = materialize(every.join(again.hint("merge"), "h", "left_semi"), "found")
    discard(every)
    discard(again)
    _release(spark)
    one = F.first(F.struct("id", "key", "start", "n", "place")).alias("one")
    classes = materialize(found.groupBy("h", "g1", "g2").agg(F.count(F.lit(1)).alias("c"), one).select("h", "c", "one.*"), "classes")
    open_ = classes.groupBy("h").agg(F.count(F.lit(1)).alias("distinct"), F.sum((F.col("c") == 1).cast("int")).alias("single"))
    open_ = materialize(open_.where("distinct > 1 and single > 0").select("h", (F.col("distinct") > HOT).alias("hot")), "open")
    asked = classes.join(open_.hint("merge"), "h").groupBy("id", "key").agg(F.collect_list(F.struct("h", "c", "hot", "start", "n", "place")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrow_bytes(b.column(2))
            lists = b.column(3)
            each = pa.RecordBatch.from_struct_array(lists.flatten())
            own = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            first, n = offsets[own] + _column(each, "start"), _column(each, "n")
            take = pa.array(own)
            arrays = [b.column(0).take(take), b.column(1).take(take), *each.columns, _binary(data.tobytes(), first, first + n + length - 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "key", *each.schema.names, "content"])

    joined = texts.join(asked.withColumnsRenamed({"id": "i", "key": "k"}).hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
    content = joined.select("id", "key", "text", "asked").mapInArrow(cut, f"id {kind}, key long, h long, c long, hot boolean, start int, n int, place int, content binary")
    content = materialize(content, "content")
    discard(classes)
    discard(open_)
    _release(spark)
    single = [_expanded(content.where("not hot"), [F.col("h")], length), *_split_hot(content.where("hot"), kind, length)]
    out = single[0]
    for more in single[1:]:
        out = out.union(more)
    single = materialize(out, "single")
    discard(content)
    _release(spark)
    sign = lambda df, s: df.select("id", "key", F.struct("start", "n", F.lit(s).alias("sign")).alias("run"))
    runs = sign(found, 1).union(sign(single, -1)).groupBy("id", "key").agg(F.collect_list("run").alias(runs_col))
    runs = runs.withColumnsRenamed({"id": i_col, "key": k_col})
    return source.join(runs.hint("merge"), F.col(id_col).eqNullSafe(F.col(i_col)) & (F.col(key_col) == F.col(k_col)), "left").drop(i_col, k_col, key_col)


def _expanded(rows: DataFrame, group: list, length: int) -> DataFrame:
    """Runs (id, key, start, n) of windows that occur once, of rows (id, key, c, start, n, content) that are distinct in a group.

    The rows of a group meet in one task; groups are packed into buckets, as equal windows are of one group.
    """
    size = rows.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64(*group), F.lit(max(1, size // BUCKET_BYTES))).alias("bucket")

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = repeated_windows(pdf["content"].tolist(), pdf["n"].to_numpy(np.int64), length)
        at, start, n = [], [], []
        for i, (again, c, s) in enumerate(zip(flags, pdf["c"], pdf["start"], strict=True)):
            if c == 1:
                a, b = _runs(~again)
                at += [i] * len(a)
                start.append(a + s)
                n.append(b - a)
        out = pdf[["id", "key"]].iloc[at].reset_index(drop=True)
        out["start"] = np.concatenate([*start, np.zeros(0, np.int64)]).astype(np.int32)
        out["n"] = np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int32)
        return out

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select(bucket, "id", "key", "c", "start", "n", "content").groupBy("bucket").applyInPandas(expand, f"id {kind}, key long, start int, n int")


def _split_hot(rows: DataFrame, kind: str, length: int) -> list[DataFrame]:
    """Runs (id, key, start, n) of windows that occur once, of segments whose anchor is shared by too many for one task.

    Each step is a count with partial sums, whatever a key's share, or an expansion of at most HOT distinct contents.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrow_bytes(b.column(5))
            text = data.tobytes()
            n, place = _column(b, "n").astype(np.int64), _column(b, "place").astype(np.int64)
            low = -place // BLOCK  # the block of the segment's first window, counted from the anchor
            own, no = _each((n - 1 - place) // BLOCK - low + 1)
            block = low[own] + no
            full = block * BLOCK + place[own]  # the block's first window, in this segment or before it
            first, stop = np.maximum(full, 0), np.minimum(full + BLOCK, n[own])
            at = offsets[own]
            core = _digests(text, at + full + BLOCK - 1, at + full + length)
            whole = _digests(text, at + first, at + stop + length - 1)
            take = pa.array(own)
            arrays = [b.column(i).take(take) for i in (0, 1, 2, 3)] + [pa.array(x) for x in (block.astype(np.int32), core[:, 0], core[:, 1], whole[:, 0], whole[:, 1], (first - full).astype(np.int32), (_column(b, "start")[own] + first).astype(np.int32), (stop - first).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*arrays, _binary(text, at + first, at + stop + length - 1)], names=names)

    names = ["id", "key", "h", "c", "block", "core1", "core2", "f1", "f2", "skip", "start", "n", "content"]
    key = ["h", "block", "core1", "core2"]
    cut = rows.select("id", "key", "h", "c", "start", "content", "n", "place").mapInArrow(blocks, f"id {kind}, key long, h long, c long, block int, core1 long, core2 long, f1 long, f2 long, skip int, start int, n int, content binary")
    one = F.first(F.struct("id", "key", "start", "n", "content")).alias("one")
    classes = materialize(cut.groupBy(*key, "f1", "f2", "skip").agg(F.sum("c").alias("c"), one).select(*key, "c", "one.*"), "blocks")
    cores = classes.groupBy(*key).agg(F.count(F.lit(1)).alias("distinct"), F.sum((F.col("c") == 1).cast("int")).alias("single"))
    cores = materialize(cores.where("single > 0").select(*key, "distinct"), "cores")
    told = materialize(classes.join(cores.hint("merge"), key), "told")
    alone = told.where("distinct = 1").select("id", "key", "start", "n")
    shared = _expanded(told.where(f"distinct > 1 and distinct <= {HOT}"), [F.col(k) for k in key], length)

    def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrow_bytes(b.column(4))
            own, no = _each(_column(b, "n").astype(np.int64))
            first = offsets[own] + no
            w = _digests(data.tobytes(), first, first + length)
            take = pa.array(own)
            start = _column(b, "start")[own] + no.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), *(b.column(i).take(take) for i in (0, 1, 2)), pa.array(start)], names=["w1", "w2", "id", "key", "c", "start"])

    windows = told.where(f"distinct > {HOT}").select("id", "key", "c", "start", "content", "n").mapInArrow(each_window, f"w1 long, w2 long, id {kind}, key long, c long, start int")
    windows = windows.groupBy("w1", "w2").agg(F.sum("c").alias("c"), F.first(F.struct("id", "key", "start")).alias("one")).where("c = 1")
    return [alone, shared, windows.select("one.*", F.lit(1).alias("n"))]


def spans_of(size: int, runs: list[dict] | None, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of bytes to remove from a text of `size` bytes."""
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = np.zeros(size, bool)
    for r in sorted(runs, key=lambda r: -r["sign"]):  # what repeats first, then what doesn't after all
        windows[r["start"] : r["start"] + r["n"]] = r["sign"] > 0
    a, b = _runs(windows)
    b = b + length - 1
    if not len(a):
        return a, b
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]


def repeats_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row; null and empty texts have no bytes to remove."""
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, runs in zip(b.column(1), b.column(2), strict=True):
                data = text.as_py().encode()
                a, z = spans_of(len(data), runs.as_py(), length)
                kept = hashlib.sha256()
                for x, y in zip([0, *z.tolist()], [*a.tolist(), len(data)], strict=True):
                    kept.update(data[x:y])
                out.append((len(data), int((z - a).sum()), len(a), kept.hexdigest()))
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    (runs_col,) = own_names([id_col, text_col], "runs")
    rows = removed_spans(docs.select(id_col, text_col), id_col, text_col, length, runs_col).select(id_col, text_col, runs_col)
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with all repeated passages cut out of the text; a character goes if any of its bytes does. Null texts stay null."""
    columns = docs.columns
    at = columns.index(text_col)
    null_col, runs_col = own_names(columns, "null", "runs")
    was_null = docs.withColumn(null_col, F.col(text_col).isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, runs, null in zip(b.column(at), b.column(len(columns) + 1), b.column(len(columns)), strict=True):
                data = text.as_py().encode()
                a, z = spans_of(len(data), runs.as_py(), length)
                parts = [data[x:y].decode(errors="ignore") for x, y in zip([0, *z.tolist()], [*a.tolist(), len(data)], strict=True)]
                out.append(None if null.as_py() else "".join(parts))
            arrays = list(b.columns[: len(columns)])
            arrays[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return removed_spans(was_null, id_col, text_col, length, runs_col).select(*[F.col(f"`{c}`") for c in columns], null_col, runs_col).mapInArrow(run, schema)
