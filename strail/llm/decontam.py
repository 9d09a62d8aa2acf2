"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ in k = m // 12 edits. Items below 24 characters match without edits, as whole
words. With an item cut into k + 1 pieces, one piece must occur unchanged wherever the item occurs with at most k edits. One automaton over the pieces of a block
of items finds the exact hits in a document; around each hit Myers' bit-parallel distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strail.llm.common import text_of

BUDGET = 12  # characters for each allowed edit
BLOCK_CHARS = 2_000_000  # characters of items in one block; larger benchmarks are matched block by block
SHORTEST = 24  # items of fewer normalized characters match exactly, as whole words only


def normalize(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split()) if text else ""


def allowed(length: int, budget: int = BUDGET) -> int:
    return length // budget if length >= 2 * budget else 0


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their places."""
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def whole_words(text: str, a: int, b: int) -> bool:
    """Whether text[a:b] neither starts nor ends within a word."""
    inside = lambda i: 0 < i < len(text) and all(c.isalnum() or c == "_" for c in text[i - 1 : i + 1])
    return not inside(a) and not inside(b)


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Myers: the least edit distance of the pattern to any part of text, and where the first such part ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int, str]], budget: int = BUDGET):
        """items: (id, normalized text)."""
        self.items = [(i, t, allowed(len(t), budget)) for i, t in items]
        self.masks = [masks(t) for _, t, _ in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for at, p in pieces(t, k):
                found.setdefault(p, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for p, where in found.items():
            self.automaton.add_word(p, (len(p), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def match(self, text: str) -> list[tuple[int, int]]:
        """(item id, least number of edits) of each item that occurs in the normalized text."""
        if not self.any:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                start = end + 1 - size - at  # where the item would start without insertions or deletions before
                k, m = self.items[n][2], len(self.items[n][1])
                if not k and m < SHORTEST and not whole_words(text, start, start + m):
                    continue
                own = spans.setdefault(n, [])
                if not own or start - k > own[-1][0] + k or start < own[-1][0]:  # hits of one diagonal band are one window
                    own.append((start, start + m))
        out = []
        for n, own in spans.items():
            item, t, k = self.items[n]
            least = k + 1
            for a, b in sorted(own):
                low = max(0, a - 2 * k)
                window = text[low : b + 4 * k]
                if t in window:
                    least = 0
                    break
                least = min(least, best_match(self.masks[n], len(t), window)[0])
            if least <= k:
                out.append((item, least))
        return sorted(out)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, normalized, in blocks of bounded size; only one block at a time is held."""
    block, size = [], 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        t = normalize(r[1])
        if r[0] is None or not t:
            continue
        block.append((r[0], t))
        size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False, items_col: str = "__items") -> DataFrame:
    """(id, item_id, edits) for each item that a document holds with at most its allowed edits.

    Null and empty items match nothing, nor do null and empty texts; short items (under 24 normalized characters) match
    whole words without edits. A row is
    given for each document row, null and repeated ids included; an item id that repeats is given once, with the fewest
    edits. With by_row the result has docs' columns and items_col, an array of (item_id, edits), for all rows instead;
    a name that docs has already is refused.
    """
    columns = docs.columns
    if by_row and items_col.lower() in {c.lower() for c in columns}:
        raise ValueError(f"docs has a column {items_col} already")
    out: DataFrame | None = None
    current = docs
    for block in item_blocks(benchmark):
        found = _match_block(current if by_row and out is not None else docs, block, budget, id_col, text_col, by_row, columns, items_col)
        if by_row:
            current = out = found
        else:
            out = found if out is None else out.union(found)
    if out is None:
        if by_row:
            return docs.withColumn(items_col, F.expr("cast(array() as array<struct<item_id: bigint, edits: int>>)"))
        return docs.select(F.col(id_col), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("edits")).where("false")
    return out


def _match_block(docs: DataFrame, block: list, budget: int, id_col: str, text_col: str, by_row: bool, columns: list[str], items_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((block, budget))
    more = by_row and items_col in docs.columns

    def least(text: str, matcher: Matcher) -> list[tuple[int, int]]:
        got: dict[int, int] = {}
        for item, k in matcher.match(normalize(text)):
            got[item] = min(k, got.get(item, k))
        return sorted(got.items())

    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for b in batches:
            if by_row:
                place = columns.index(text_col)
                items = [[{"item_id": i, "edits": k} for i, k in least(t.as_py(), matcher)] for t in b.column(place)]
                if more:
                    items = [[*a, *x] for a, x in zip(b.column(len(columns)).to_pylist(), items, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(items, kind)], names=[*columns, items_col])
                continue
            keys, ids, edits = [], [], []
            for key, t in zip(b.column(0), b.column(1), strict=True):
                for i, k in least(t.as_py(), matcher):
                    keys.append(key.as_py()), ids.append(i), edits.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(ids, pa.int64()), pa.array(edits, pa.int32())], names=[id_col, "item_id", "edits"])

    if by_row:
        schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns] + [f"`{items_col}` array<struct<item_id: bigint, edits: int>>"])
        return docs.mapInArrow(run, schema)
    kind_of = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_of(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind_of}, item_id long, edits int")


_matchers: dict[int, tuple] = {}


def _matcher(shared) -> Matcher:
    """One automaton for each broadcast block and worker process."""
    block, budget = shared.value
    got = _matchers.get(0)
    if got is None or got[0] is not block:
        _matchers[0] = got = (block, Matcher(block, budget))
    return got[1]
