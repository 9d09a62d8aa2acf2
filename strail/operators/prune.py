"""Pruning of leaves before the scan: boxes, labels, shared ids and time windows of all steps together.

Id pruning is always safe. Time windows assume that time does not run backwards along unit_index; so they are used only
if the caller vouches for that, or a check of the data does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strail.functions.geometry import meets
from strail.functions.idset import IntervalSet, bloom_words, intersect_intervals, overlaps_any, trim_intervals, union_intervals
from strail.operators.index import Index
from strail.operators.query import GATHERED, SimpleQuery, find, find_any
from strail.operators.stored import keep

PUSHED = 2000  # nodes that are pushed down as a list; more go through a semi-join


def is_monotone(units: DataFrame) -> bool:
    """Whether time never runs backwards along a trajectory."""
    w = Window.partitionBy("trajectory_id").orderBy("unit_index")
    late = units.select("t0", "t1", F.lag("t1").over(w).alias("before")).where("t1 < t0 or t0 < before")
    return late.isEmpty()


def candidates(index: Index, step: SimpleQuery, level: int = 0) -> DataFrame:
    """(node_id, tmin, tmax): nodes of a level that may hold units of the step."""
    nodes = index.nodes.where(F.col("level") == level).where(meets(step.box)).select("node_id", "tmin", "tmax")
    if not step.labels:
        return nodes
    lists = index.postings.where((F.col("level") == level) & F.col("label_id").isin(sorted(step.labels))).select("node_id").distinct()
    return nodes.join(lists, "node_id", "left_semi")


@dataclass(frozen=True)
class TimeWindow:
    begin: int
    end: int

    @property
    def empty(self) -> bool:
        return self.begin > self.end


def trim_windows(windows: list[TimeWindow]) -> list[TimeWindow] | None:
    """A step ends no later than the next one does, and begins no earlier than the one before; None if a window is empty."""
    out = list(windows)
    for i in range(len(out) - 2, -1, -1):
        out[i] = TimeWindow(out[i].begin, min(out[i].end, out[i + 1].end))
    for i in range(1, len(out)):
        out[i] = TimeWindow(max(out[i].begin, out[i - 1].begin), out[i].end)
    return None if any(w.empty for w in out) else out


def time_windows(index: Index, steps: list[SimpleQuery], level: int = 0) -> list[TimeWindow]:
    """[least tmin, greatest tmax] of each step's candidates; one row a step comes to the driver. [0, -1] if there are none."""
    parts = None
    for i, s in enumerate(steps):
        row = candidates(index, s, level).agg(F.min("tmin").alias("a"), F.max("tmax").alias("b")).select(F.lit(i).alias("i"), "a", "b")
        parts = row if parts is None else parts.union(row)
    got = {r["i"]: r for r in parts.collect()}
    return [TimeWindow(got[i]["a"], got[i]["b"]) if got[i]["a"] is not None else TimeWindow(0, -1) for i in range(len(steps))]


def shared_ids(index: Index, steps: list[SimpleQuery]) -> DataFrame:
    """(trajectory_id) of those that have candidate leaves for every step; for exact id sets."""
    rows = None
    for i, s in enumerate(steps):
        posts = index.postings.where(F.col("level") == 0)
        posts = posts.where(F.col("label_id").isin(sorted(s.labels))) if s.labels else posts.where("label_id is null")
        own = posts.join(candidates(index, s).select("node_id"), "node_id", "left_semi").select(F.explode("ids").alias("trajectory_id"), F.lit(i).alias("step"))
        rows = own if rows is None else rows.union(own)
    return rows.groupBy("trajectory_id").agg(F.count_distinct("step").alias("n")).where(F.col("n") == len(steps)).select("trajectory_id")


def _one_of(col: str, steps: list[SimpleQuery], test) -> Column:
    """Array of the steps that a row passes."""
    return F.array_compact(F.array(*[F.when(test(s), F.lit(i)) for i, s in enumerate(steps)])).alias(col)


def _labelled(step: SimpleQuery) -> Column:
    return F.col("label_id").isin(sorted(step.labels)) if step.labels else F.col("label_id").isNull()


@dataclass
class Search:
    """What a level-wise search leaves: leaves by step, ids that all steps share (spans), and the nodes looked at on each level."""

    leaves: DataFrame | None  # step, node_id
    spans: list[tuple[int, int]] | None
    visited: list[tuple[int, int]]  # level, nodes that stayed
    few: list[int] | None = None  # the leaves of all steps, where they are few


def _shared_spans(cand: DataFrame, n: int, capacity: int) -> list[tuple[int, int]]:
    """At most capacity intervals for each step, and what all steps have in common: bounded by n * capacity."""
    rows = cand.select("step", F.explode("ids").alias("i")).select("step", "i.begin", "i.end").distinct()  # many nodes have the same ids
    spans = trim_intervals(union_intervals(rows, ["step"]), ["step"], capacity)
    both = intersect_intervals(spans.select(F.lit(1).alias("k"), "begin", "end"), ["k"], n)
    return sorted((r["begin"], r["end"]) for r in both.collect())


def _few(rows: list, steps: int, index: Index, monotone: bool) -> tuple[list, list[tuple[int, int]] | None] | None:
    """A level's candidates, few enough for the driver, that windows and id sets leave, and the shared spans; None if a step has none."""
    got = [[r for r in rows if r["step"] == i] for i in range(steps)]
    if not all(got):
        return None
    if monotone:
        windows = trim_windows([TimeWindow(min(r["tmin"] for r in own), max(r["tmax"] for r in own)) for own in got])
        if windows is None:
            return None
        got = [[r for r in own if r["tmin"] <= w.end and r["tmax"] >= w.begin] for own, w in zip(got, windows, strict=True)]
    spans = None
    if index.config.id_set == "interval":
        sets = [IntervalSet([], index.config.lambda_).union(*[IntervalSet([(i["begin"], i["end"]) for i in r["ids"]]) for r in own]) for own in got]
        spans = sets[0].intersection(*sets[1:]).items
        got = [[r for r in own if any(b <= i["end"] and i["begin"] <= e for i in r["ids"] for b, e in spans)] for own in got]
    elif index.config.id_set == "bloom":
        words = []
        for own in got:
            either: dict[int, int] = {}
            for r in own:
                for w, bits in r["ids"].items():
                    either[w] = either.get(w, 0) | bits
            words.append(either)
        both = {w: reduce(and_, (x[w] for x in words)) for w in words[0] if all(w in x for x in words)}
        got = [[r for r in own if any(bits & both.get(w, 0) for w, bits in r["ids"].items())] for own in got]
    return None if not all(got) else ([r for own in got for r in own], spans)


def search(index: Index, steps: list[SimpleQuery], monotone: bool = False) -> Search:
    """From the root down: on each level the children of the nodes that stayed, by box, label, time windows and id sets.

    Interval and Bloom sets are compared on every level, exact ones by find_pruned() for the units. While candidates are few
    (PUSHED a step, each with an id set of bounded size) they come to the driver, one job a level, and the next level's scan
    takes them as a filter; more of them stay tables.
    """
    n, visited, spans = len(steps), [], None
    alive: dict[int, list[int]] | DataFrame | None = None
    stay = None
    kinds = ["ids"] if index.config.id_set in ("interval", "bloom") else []
    for level in range(index.height - 1, -1, -1):
        nodes = index.nodes.where(F.col("level") == level).select("node_id", "parent_id", "tmin", "tmax", _one_of("by_box", steps, lambda s: meets(s.box))).where(F.size("by_box") > 0)
        posts = index.postings.where(F.col("level") == level).select("node_id", *kinds, _one_of("by_label", steps, _labelled)).where(F.size("by_label") > 0)
        if isinstance(alive, dict):
            nodes = nodes.where(F.col("parent_id").isin(sorted({p for own in alive.values() for p in own})))
        cand = nodes.join(posts, "node_id").select("node_id", "parent_id", "tmin", "tmax", *kinds, F.explode(F.array_intersect("by_box", "by_label")).alias("step"))
        if isinstance(alive, dict):
            own = F.lit(False)
            for i, parents in alive.items():
                own = own | ((F.col("step") == i) & F.col("parent_id").isin(parents))
            cand = cand.where(own)
        elif alive is not None:
            cand = cand.join(alive.select("step", F.col("node_id").alias("parent_id")), ["step", "parent_id"], "left_semi")
        rows = cand.select("step", "node_id", "tmin", "tmax", *kinds).limit(PUSHED * n + 1).collect()  # bounded
        if len(rows) <= PUSHED * n:
            got = _few(rows, n, index, monotone)
            if got is None:
                return Search(None, None, visited)
            rows, spans = got
            alive = {i: sorted({r["node_id"] for r in rows if r["step"] == i}) for i in range(n)}
            visited.append((level, len({r["node_id"] for r in rows})))
            continue
        if monotone:
            got = {r["step"]: TimeWindow(r["a"], r["b"]) for r in cand.groupBy("step").agg(F.min("tmin").alias("a"), F.max("tmax").alias("b")).collect()}
            windows = trim_windows([got[i] for i in range(n)]) if len(got) == n else None
            if windows is None:
                return Search(None, None, visited)
            inside = F.lit(False)
            for i, w in enumerate(windows):
                inside = inside | ((F.col("step") == i) & (F.col("tmin") <= w.end) & (F.col("tmax") >= w.begin))
            cand = cand.where(inside)
        if index.config.id_set == "interval":
            spans = _shared_spans(cand, n, index.config.lambda_)
            cand = cand.where(overlaps_any(F.col("ids"), spans))
        elif index.config.id_set == "bloom":
            words = bloom_words(bloom_words(cand, ["step"], "or", n, "ids").select("step", F.create_map("word", "bits").alias("filter")), [], "and", n)
            shared = {r["word"]: r["bits"] for r in words.collect()}  # as many words as a filter has
            table = F.create_map(*[x for w, b in {-1: 0, **shared}.items() for x in (F.lit(w).cast("long"), F.lit(b).cast("long"))])
            common = F.aggregate(F.map_entries("ids"), F.lit(0), lambda a, e: a + F.bit_count(e["value"].bitwiseAND(F.coalesce(F.element_at(table, e["key"]), F.lit(0).cast("long")))))
            cand = cand.where(common > 0)
        alive = stay = keep(cand.select("step", "node_id").distinct())
        if stay.select("step").distinct().count() < n:
            return Search(None, None, visited)
        visited.append((level, stay.select("node_id").distinct().count()))
    if not isinstance(alive, dict):
        return Search(stay, spans, visited)
    stay = index.units.sparkSession.createDataFrame([(i, p) for i, own in alive.items() for p in own], "step int, node_id long")
    return Search(stay, spans, visited, sorted({p for own in alive.values() for p in own}))


def leaves(index: Index, steps: list[SimpleQuery], monotone: bool = False) -> DataFrame | None:
    """(leaf_id) that may hold units of any step of a match; None if nothing can match."""
    found = search(index, steps, monotone).leaves
    return None if found is None else found.select(F.col("node_id").alias("leaf_id")).distinct()


def visits(index: Index, steps: list[SimpleQuery], monotone: bool = False) -> DataFrame:
    """(level, nodes, stayed): how many nodes each level has and how many a search leaves; none below a level without any."""
    got = dict(search(index, steps, monotone).visited)
    rows = index.nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"))
    stayed = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in {-1: 0, **got}.items() for x in kv]), F.col("level")), F.lit(0))
    return rows.select("level", "nodes", stayed.cast("long").alias("stayed"))


def find_pruned(index: Index, steps: list[SimpleQuery], monotone: bool = False) -> DataFrame:
    """find() over the leaves that the search leaves; the same result, or for monotone data as vouched for."""
    if not steps:
        return find(index.units, steps)
    found = search(index, steps, monotone)
    if found.leaves is None:
        return find(index.units.where("false"), steps)
    if found.few is not None and len(found.few) <= PUSHED:
        units = index.units.where(F.col("leaf_id").isin(found.few))
    else:
        units = index.units.join(found.leaves.select(F.col("node_id").alias("leaf_id")).distinct(), "leaf_id", "left_semi")
    if found.spans is not None:
        spans = units.sparkSession.createDataFrame(found.spans, "begin long, end long")  # so many as a step's sets have, at most
        units = units.join(F.broadcast(spans), F.col("trajectory_id").between(F.col("begin"), F.col("end")), "left_semi")
    elif index.config.id_set == "exact":
        units = units.join(shared_ids(index, steps), "trajectory_id", "left_semi")
    return find(units, steps) if index.size <= GATHERED else find_any(units, steps)
