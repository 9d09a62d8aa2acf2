"""Id sets: exact arrays, arrays of closed intervals, Bloom filters and the set of everything.

Interval sets are arrays of struct<begin, end>, ascending and disjoint. Intervals that touch in one point merge
([a, b] and [b, c]); neighbours ([1, 2] and [3, 4]) do not, except for display.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVALS = "array<struct<begin: bigint, end: bigint>>"


def trim_intervals(rows: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """rows (keys, begin, end), disjoint in each set -> at most `capacity` intervals a set: the largest gaps stay open.

    Of equal gaps the earlier one stays. Two windows over one partitioning, so one shuffle.
    """
    by = Window.partitionBy(*keys)
    gap = F.col("begin") - F.lag("end").over(by.orderBy("begin"))
    ranked = rows.withColumn("gap", gap).withColumn("gap_rank", F.row_number().over(by.orderBy(F.col("gap").desc_nulls_last(), "begin")))
    new = F.sum(F.when(F.col("gap").isNotNull() & (F.col("gap_rank") <= capacity - 1), 1).otherwise(0)).over(by.orderBy("begin"))
    return ranked.withColumn("part", new).groupBy(*keys, "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("part")


def ids_to_intervals(rows: DataFrame, keys: list[str], capacity: int, id_col: str = "id") -> DataFrame:
    """The ids of each set as at most `capacity` intervals, a superset of them."""
    distinct = rows.select(*keys, F.col(id_col).alias("begin"), F.col(id_col).alias("end")).distinct()
    return trim_intervals(distinct, keys, capacity)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow list column one behind the other, and where each list begins; a null is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _per_batch(df: DataFrame, column: str, kind: str, made) -> DataFrame:
    """df with the lists of a column replaced by what `made` makes of a batch of them: row by row, so without a shuffle."""
    import pyarrow as pa

    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = made(columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{c}` {kind if c == column else t}" for c, t in df.dtypes))


def lists_to_intervals(df: DataFrame, column: str, capacity: int) -> DataFrame:
    """df with each ascending list of distinct ids as at most `capacity` intervals: those of trim_intervals(), list by list."""

    def made(lists):
        import pyarrow as pa

        ids, starts = _lists(lists)
        cut = np.ones(len(ids), bool)  # whether an interval begins here
        for i in np.flatnonzero(np.diff(starts) > capacity):
            a, b = starts[i], starts[i + 1]
            cut[a + 1 : b] = False
            cut[a + 1 + np.argsort(ids[a : b - 1] - ids[a + 1 : b], kind="stable")[: capacity - 1]] = True  # of equal gaps the earlier
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(ids)) - 1
        offsets = np.searchsorted(begin, starts)
        spans = pa.StructArray.from_arrays([pa.array(ids[begin]), pa.array(ids[end])], names=["begin", "end"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)

    return _per_batch(df, column, INTERVALS, made)


def lists_to_blooms(df: DataFrame, column: str, bits: int) -> DataFrame:
    """df with each list of ids as a Bloom filter: the words of bloom_filters(), list by list."""

    def made(lists):
        import pyarrow as pa

        ids, starts = _lists(lists)
        p = bloom_positions(ids, bits)
        words = -(-bits // 64)
        key = (np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:, None] * words + p // 64).ravel()
        bit = (np.uint64(1) << (p % 64).astype(np.uint64)).ravel()
        order = np.argsort(key, kind="stable")
        key, bit = key[order], bit[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        either = np.bitwise_or.reduceat(bit, first) if len(key) else bit
        offsets = np.searchsorted(key[first], np.arange(len(starts)) * words)
        return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key[first] % words), pa.array(either.view(np.int64)))

    return _per_batch(df, column, "map<bigint, bigint>", made)


def union_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The union of all intervals of a group: touching ones merge."""
    by = Window.partitionBy(*keys).orderBy("begin", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(before.isNull() | (F.col("begin") > before), 1).otherwise(0)
    part = F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("start", start).withColumn("part", part).groupBy(*keys, "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("part")


def intersect_intervals(rows: DataFrame, keys: list[str], sets: int) -> DataFrame:
    """What all `sets` sets of a group cover, by an event sweep; each set is disjoint in itself.

    A border of any set stays a border: neighbours such as [1, 2] and [3, 4] are not merged.
    """
    event = F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("step")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("step"))))
    events = rows.select(*keys, event.alias("e")).select(*keys, "e.*").groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    by = Window.partitionBy(*keys).orderBy("at")
    swept = events.withColumns({"open": F.sum("step").over(by), "next": F.lead("at").over(by)}).where(F.col("open") == sets)
    return swept.select(*keys, F.col("at").alias("begin"), (F.col("next") - 1).alias("end"))


def merge_neighbours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """[a, b] and [b + 1, c] as one."""
    by = Window.partitionBy(*keys).orderBy("begin")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("start", F.when(before.isNull() | (F.col("begin") > before + 1), 1).otherwise(0))
    part = F.sum("start").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("part", part).groupBy(*keys, "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("part")


def contains(intervals: Column, value: Column) -> Column:
    return F.exists(intervals, lambda i: (i["begin"] <= value) & (value <= i["end"]))


def overlaps_any(intervals: Column, spans: list[tuple[int, int]]) -> Column:
    """Whether an interval of the column meets one of a few spans."""
    one = lambda i: F.exists(F.array(*[F.struct(F.lit(b).cast("long").alias("begin"), F.lit(e).cast("long").alias("end")) for b, e in spans]), lambda s: (s["begin"] <= i["end"]) & (i["begin"] <= s["end"]))
    return F.exists(intervals, one) if spans else F.lit(False)


def display_intervals(rows: DataFrame, keys: list[str], out: str = "text") -> DataFrame:
    """(keys, out) of rows (keys, begin, end): {[1][3-9]}, neighbours joined."""
    one = F.when(F.col("begin") == F.col("end"), F.format_string("[%d]", "begin")).otherwise(F.format_string("[%d-%d]", "begin", "end"))
    merged = merge_neighbours(rows, keys).select(*keys, "begin", one.alias("one"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("begin", "one"))), lambda x: x["one"])
    return merged.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(listed, ""), F.lit("}")).alias(out))


def bloom_error(bits: int, n: Column, probes: int = 5) -> Column:
    """How often a filter of so many bits with n ids says yes to another id."""
    return F.pow(1 - F.pow(F.lit(1 - 1 / bits), n * probes), F.lit(float(probes)))


def bloom_words(filters: DataFrame, keys: list[str], how: str, sets: int, filter_col: str = "filter") -> DataFrame:
    """(keys, word, bits) of filters united (`or`) or intersected (`and`, of `sets` filters a group); words without bits go."""
    words = filters.select(*keys, F.explode(filter_col).alias("word", "bits")).groupBy(*keys, "word")
    made = words.agg(F.expr(f"bit_{how}(bits)").alias("bits"), F.count(F.lit(1)).alias("n"))
    return made.where((F.col("bits") != 0) & ((F.col("n") == sets) | F.lit(how == "or"))).drop("n")


def display(intervals: list[tuple[int, int]]) -> str:
    """{[1][3-9]}: neighbours are joined for display."""
    out: list[list[int]] = []
    for b, e in sorted(intervals):
        if out and b <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return "{" + "".join(f"[{b}]" if b == e else f"[{b}-{e}]" for b, e in out) + "}"


class IntervalSet:
    """A small interval set on the driver, of bounded capacity; for planning and tests."""

    def __init__(self, items: list[tuple[int, int]] | None = None, capacity: int | None = None):
        self.capacity, self.items = capacity, sorted(items or [])
        self._fit()

    def _fit(self) -> None:
        if self.capacity is not None:
            self.items = self.trimmed(self.capacity)

    def trimmed(self, capacity: int) -> list[tuple[int, int]]:
        if capacity < 1:
            raise ValueError("capacity must be at least 1")
        gaps = sorted(((self.items[i + 1][0] - self.items[i][1], -i) for i in range(len(self.items) - 1)), reverse=True)[: capacity - 1]
        cuts, out = {-i for _, i in gaps}, []
        for i, (b, e) in enumerate(self.items):
            if i == 0 or i - 1 in cuts:
                out.append((b, e))
            else:
                out[-1] = (out[-1][0], e)
        return out

    def add(self, value: int) -> None:
        if value not in self:
            self.items = sorted([*self.items, (value, value)])
            self._fit()

    def __contains__(self, value: int) -> bool:
        return any(b <= value <= e for b, e in self.items)

    def union(self, *others: IntervalSet) -> IntervalSet:
        out: list[tuple[int, int]] = []
        for b, e in sorted(x for s in (self, *others) for x in s.items):
            if out and b <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((b, e))
        return IntervalSet(out, self.capacity)

    def intersection(self, *others: IntervalSet) -> IntervalSet:
        sets, out = [self.items, *(s.items for s in others)], []
        at = [0] * len(sets)
        while all(i < len(s) for i, s in zip(at, sets, strict=True)):
            low, high = max(s[i][0] for i, s in zip(at, sets, strict=True)), min(s[i][1] for i, s in zip(at, sets, strict=True))
            if low <= high:
                out.append((low, high))
            at = [i + (s[i][1] == high) for i, s in zip(at, sets, strict=True)]
        return IntervalSet(out, self.capacity)


_M1, _M2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)  # fixed values of the public 128-bit hash


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _final(k: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        k = (k ^ k >> np.uint64(33)) * np.uint64(factor)
    return k ^ k >> np.uint64(33)


def murmur128_long(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MurmurHash3 x64-128, seed 0, of each id as 8 little-endian bytes."""
    k = np.asarray(ids, np.int64).view(np.uint64) * _M1
    h1, h2 = _rotl(k, 31) * _M2, np.zeros(len(k), np.uint64)
    h1, h2 = h1 ^ np.uint64(8), h2 ^ np.uint64(8)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _final(h1), _final(h2)
    h1 = h1 + h2
    return h1, h2 + h1


PROBES = 5


def bloom_positions(ids: np.ndarray, bits: int) -> np.ndarray:
    h1, h2 = murmur128_long(ids)
    return np.stack([((h1 + np.uint64(i) * h2) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)], axis=1)


def bloom_bits(capacity: int) -> int:
    """As many bits as an interval set of this capacity takes."""
    return capacity * 128


def bloom_of(ids: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, bool)
    out[bloom_positions(np.asarray(ids, np.int64), bits).ravel()] = True
    return np.packbits(out, bitorder="little").tobytes()


def bloom_contains(filter_: bytes, ids: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8), bitorder="little")
    return bits[bloom_positions(np.asarray(ids, np.int64), len(bits))].all(axis=1)


def bloom_union(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def bloom_intersection(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.uint8) & np.frombuffer(b, np.uint8)).tobytes()


def bloom_error_rate(bits: int, n: int, probes: int = PROBES) -> float:
    return (1 - (1 - 1 / bits) ** (probes * n)) ** probes


def bloom_filters(rows: DataFrame, keys: list[str], bits: int, id_col: str = "id") -> DataFrame:
    """One Bloom filter for each group: set bits are found row by row and merged as words by bit_or, so it is partial."""

    @F.pandas_udf("array<long>")
    def positions(ids: pd.Series) -> pd.Series:
        return pd.Series(list(bloom_positions(ids.to_numpy(), bits)))

    spread = rows.select(*keys, F.explode(positions(F.col(id_col).cast("long"))).alias("p")).select(*keys, F.expr("p DIV 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
    return spread.groupBy(*keys, "word").agg(F.expr("bit_or(bit)").alias("bits")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("filter"))


def bloom_may_contain(filter_: Column, value: Column, bits: int) -> Column:
    """Whether the map of words of bloom_filters() may hold the id."""

    @F.pandas_udf("array<long>")
    def positions(ids: pd.Series) -> pd.Series:
        return pd.Series(list(bloom_positions(ids.to_numpy(), bits)))

    word = F.transform(positions(value.cast("long")), lambda p: F.struct(F.floor(p / 64).cast("long").alias("w"), (p % 64).cast("int").alias("b")))
    return F.forall(word, lambda s: F.getbit(F.coalesce(F.element_at(filter_, s["w"]), F.lit(0).cast("long")), s["b"]) == 1)
