"""Simple and ordered ("sequenced") queries over units.

A sequenced query is a list of steps, each a closed box and a set of labels (empty: any). Let S_i be the unit indexes of
a trajectory that satisfy step i, m_1 = min S_1, and m_(i+1) = the least u in S_(i+1) with u >= m_i. The trajectory
matches if all m_i exist. It returns, of S_i, the indexes from m_i to before m_(i+1), and of the last step all from m_n.

The plan is one scan: a predicate for each step gives a bit mask, rows of no step are dropped before the one shuffle (by
trajectory), and matching indexes alone are gathered, as (index, mask). The chain of m_i is a higher-order expression,
and the matching units come out of the gathered array again, so there is no join back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strail.functions.geometry import Box, segment_hits
from strail.operators.stored import keep
from strail.schema import MAX_FLOAT, MAX_TIME, UNITS


GATHERED = 1_000_000  # matching units of a trajectory that one row may hold
BITS = 62  # steps of a mask


@dataclass(frozen=True)
class SimpleQuery:
    box: Box
    labels: frozenset[int] = field(default_factory=frozenset)

    def predicate(self) -> Column:
        hit = segment_hits(self.box)
        return hit & F.col("label_id").isin(sorted(self.labels)) if self.labels else hit


def parse_box(text: str) -> Box:
    """xmin,xmax,ymin,ymax,tmin,tmax; MIN and MAX are the ends of the range; blanks are ignored."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 6:
        raise ValueError(f"expected six values in {text!r}")
    values: list = []
    for i, p in enumerate(parts):
        if p in ("MIN", "MAX"):
            values.append((-MAX_FLOAT if p == "MIN" else MAX_FLOAT) if i < 4 else (0 if p == "MIN" else MAX_TIME))
        elif i < 4:
            values.append(float(p))
        elif re.fullmatch(r"\d+", p) and int(p) <= MAX_TIME:
            values.append(int(p))
        else:
            raise ValueError(f"bad time {p!r}")
    return Box(values[0], values[2], values[4], values[1], values[3], values[5])


def parse_labels(text: str) -> frozenset[int]:
    if not text.strip():
        return frozenset()
    parts = [p.strip() for p in text.split(",")]
    if not all(re.fullmatch(r"\d+", p) for p in parts):
        raise ValueError(f"bad label list {text!r}")
    return frozenset(map(int, parts))


def parse_query(boxes: list[str], labels: list[str]) -> list[SimpleQuery]:
    if len(boxes) != len(labels):
        raise ValueError("as many boxes as label lists are needed")
    if not boxes:
        raise ValueError("a query needs a step")
    return [SimpleQuery(parse_box(b), parse_labels(x)) for b, x in zip(boxes, labels, strict=True)]


def simple(units: DataFrame, query: SimpleQuery) -> DataFrame:
    return units.where(query.predicate())


def find(units: DataFrame, steps: list[SimpleQuery]) -> DataFrame:
    """The matching units of a sequenced query, with `step` (from 0). No step: no row. Repeated units stay repeated."""
    fields = [f for f in UNITS.fieldNames() if f != "trajectory_id"]
    if not steps:
        return units.where("false").select("trajectory_id", *fields, F.lit(0).alias("step"))
    if len(steps) == 1:
        return units.where(steps[0].predicate()).select("trajectory_id", *fields, F.lit(0).alias("step"))
    if len(steps) > 62:
        raise ValueError("a query has at most 62 steps")
    mask = F.lit(0).cast("long")
    for i, s in enumerate(steps):
        mask = mask + F.when(s.predicate(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return _gathered(_hit(units, {"mask": mask}), len(steps))


def _hit(units: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """units of any step, with the masks. A generator drops the others: a filter would be pushed below the masks, so that each
    is computed twice by one method, which is then too large (8,000 bytes) to be compiled and takes 20 times as long."""
    some = reduce(or_, [F.col(m) != 0 for m in masks])
    return units.withColumns(masks).withColumn("__some", F.explode(F.array_remove(F.array(some), F.lit(False)))).drop("__some")


def _gathered(hit: DataFrame, n: int) -> DataFrame:
    """The rows of find() of units with the mask of their n steps, two or more."""
    fields = [f for f in UNITS.fieldNames() if f != "trajectory_id"]
    rows = hit.groupBy("trajectory_id").agg(F.expr("bit_or(mask)").alias("any"), F.collect_list(F.struct("unit_index", *fields[1:], "mask")).alias("units"))
    rows = rows.where(F.col("any") == (1 << n) - 1)
    least = "array_min(transform(filter(units, u -> {}), u -> u.unit_index))"
    first, later = least.format("(u.mask & 1L) <> 0"), least.format("(u.mask & shiftleft(1L, i)) <> 0 and u.unit_index >= element_at(acc, -1)")
    marks = F.expr(f"aggregate(sequence(1, {n - 1}), cast(array({first}) as array<bigint>), (acc, i) -> concat(acc, array({later})))")
    out = rows.select("trajectory_id", "units", marks.alias("marks")).where("element_at(marks, -1) is not null").select("trajectory_id", "marks", F.explode("units").alias("u"))
    step = F.expr("size(filter(marks, m -> m <= u.unit_index)) - 1")  # the last step that begins at or before the unit
    out = out.withColumn("step", step).where("step >= 0 and (u.mask & shiftleft(1L, step)) <> 0")
    return out.select("trajectory_id", "u.unit_index", *[f"u.{f}" for f in fields[1:]], "step")


def _masked(units: DataFrame, steps: list[SimpleQuery]) -> DataFrame:
    """The units of any step, with bit masks of their steps (`mask`, and one more for each BITS further steps); kept, as the joins
    read them once for each step."""
    masks = {}
    for k in range(0, len(steps), BITS):
        mask = F.lit(0).cast("long")
        for i, s in enumerate(steps[k : k + BITS]):
            mask = mask + F.when(s.predicate(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        masks[_mask(k)] = mask
    return keep(_hit(units.select(*UNITS.fieldNames()), masks))


def _mask(step: int) -> str:
    return f"mask{step // BITS}" if step >= BITS else "mask"


def find_by_joins(units: DataFrame, steps: list[SimpleQuery]) -> DataFrame:
    """As find(), without gathering a trajectory's matches: for trajectories of any length, at n more joins.

    Each m_i is an aggregate; trajectories are reduced by each step before the next one is looked at. Units are read once,
    those of no step are dropped, and one join with all m_i gives the rows, as the ranges of the steps are disjoint.
    """
    if not steps:
        return find(units, steps)
    return _joined(_masked(units, steps), len(steps))


def _joined(hits: DataFrame, n: int) -> DataFrame:
    """The rows of find_by_joins() of units with the mask of their steps."""
    own = lambda i: F.col(_mask(i)).bitwiseAND(F.lit(1 << i % BITS).cast("long")) != 0
    marks = hits.where(own(0)).groupBy("trajectory_id").agg(F.min("unit_index").alias("m0"))
    for i in range(1, n):
        joined = hits.where(own(i)).select("trajectory_id", "unit_index").join(marks, "trajectory_id").where(F.col("unit_index") >= F.col(f"m{i - 1}"))
        marks = keep(joined.groupBy("trajectory_id", *[f"m{k}" for k in range(i)]).agg(F.min("unit_index").alias(f"m{i}")))  # a row a trajectory
    step = F.when(F.lit(False), F.lit(0))
    for i in range(n):
        inside = own(i) & (F.col("unit_index") >= F.col(f"m{i}"))
        step = step.when(inside & (F.col("unit_index") < F.col(f"m{i + 1}")) if i + 1 < n else inside, F.lit(i))
    out = hits.join(marks, "trajectory_id").withColumn("step", step).where("step is not null")
    return out.select(*UNITS.fieldNames(), "step")


def find_any(units: DataFrame, steps: list[SimpleQuery], most: int = GATHERED) -> DataFrame:
    """find() for trajectories with at most `most` matching units, find_by_joins() for the longer ones; one more count before.

    Units are read once. The longer trajectories stay a table, however many there are.
    """
    if len(steps) < 2:
        return find(units, steps)
    if len(steps) > 62:
        raise ValueError("a query has at most 62 steps")
    hits = _masked(units, steps)
    long = keep(hits.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("trajectory_id"))
    if long.isEmpty():
        return _gathered(hits, len(steps))
    short, rest = hits.join(long, "trajectory_id", "left_anti"), keep(hits.join(long, "trajectory_id", "left_semi"))
    return _gathered(short, len(steps)).unionByName(_joined(rest, len(steps)))


def counts(matches: DataFrame) -> DataFrame:
    """One row: trajectories, units."""
    return matches.agg(F.countDistinct("trajectory_id").alias("trajectories"), F.count(F.lit(1)).alias("units"))


def stats_json(matches: DataFrame) -> DataFrame:
    """One JSON object: the units and trajectories that matched."""
    return counts(matches).select(F.to_json(F.struct("units", "trajectories")).alias("json"))


def ordered(matches: DataFrame) -> DataFrame:
    return matches.orderBy("trajectory_id", "unit_index")


def as_text(matches: DataFrame) -> DataFrame:
    """One line for each unit, as the command line prints it."""
    point = lambda i: F.format_string("(%.5f, %.5f, %d)", F.col(f"x{i}").cast("double"), F.col(f"y{i}").cast("double"), F.col(f"t{i}"))
    return matches.select("trajectory_id", "unit_index", F.format_string("%d: %s -> %s, label %d", F.col("unit_index"), point(0), point(1), F.col("label_id")).alias("line"))


def find_each(units: DataFrame, queries: dict[str, list[SimpleQuery]]) -> DataFrame:
    """(query, trajectory_id, unit_index) of the matches of several named queries, in one scan and one shuffle."""
    if any(len(s) > 62 for s in queries.values()):
        raise ValueError("a query has at most 62 steps")
    tests = []
    for name, steps in queries.items():
        mask = F.lit(0).cast("long")
        for i, s in enumerate(steps):
            mask = mask + F.when(s.predicate(), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        tests.append(F.struct(F.lit(name).alias("query"), F.lit(len(steps)).alias("n"), mask.alias("mask")))
    hit = units.select("trajectory_id", "unit_index", F.explode(F.filter(F.array(*tests), lambda x: x["mask"] != 0)).alias("q"))
    rows = hit.groupBy("q.query", "q.n", "trajectory_id").agg(F.collect_list(F.struct("unit_index", "q.mask")).alias("units"))
    least = "array_min(transform(filter(units, u -> {}), u -> u.unit_index))"
    first, later = least.format("(u.mask & 1L) <> 0"), least.format("(u.mask & shiftleft(1L, i)) <> 0 and u.unit_index >= element_at(acc, -1)")
    marks = F.expr(f"aggregate(if(n > 1, sequence(1, n - 1), cast(array() as array<int>)), cast(array({first}) as array<bigint>), (acc, i) -> concat(acc, array({later})))")
    out = rows.select("query", "trajectory_id", "units", marks.alias("marks")).where("element_at(marks, -1) is not null").select("query", "trajectory_id", "marks", F.explode("units").alias("u"))
    out = out.withColumn("step", F.expr("size(filter(marks, m -> m <= u.unit_index)) - 1")).where("step >= 0 and (u.mask & shiftleft(1L, step)) <> 0")
    return out.select("query", "trajectory_id", "u.unit_index")


def selectivity(units: DataFrame, queries: dict[str, list[SimpleQuery]]) -> DataFrame:
    """(query, trajectories, units) for each named query, those without a match included; the units are read once."""
    got = find_each(units, queries).groupBy("query").agg(F.countDistinct("trajectory_id").alias("trajectories"), F.count(F.lit(1)).alias("units"))
    names = units.sparkSession.createDataFrame([(n,) for n in queries], "query string")
    return names.join(got, "query", "left").select("query", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("trajectories", "units")])


def query_set_averages(units: DataFrame, sets: dict[str, dict[str, list[SimpleQuery]]]) -> DataFrame:
    """(name, queries, trajectories, units): means over the queries of each named set."""
    every = {f"{s}/{q}": steps for s, own in sets.items() for q, steps in own.items()}
    by = selectivity(units, every).withColumn("name", F.substring_index("query", "/", 1))
    return by.groupBy("name").agg(F.count(F.lit(1)).alias("queries"), F.avg("trajectories").alias("trajectories"), F.avg("units").alias("units"))


def split_tokens(text: Column, separator: str) -> Column:
    """The tokens between separators; an empty text has none, a separator alone has two empty ones."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, re.escape(separator)))
