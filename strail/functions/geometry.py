"""Geometry of units, boxes and intervals as Columns: no Python runs on rows, and box tests reach the Parquet scan.

A box is given by the names of its six columns, or as a Box of literals. Positions are 32-bit floats, times are longs;
differences are taken in these types before they widen, predicates on segments are double.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "t")
EPSILON = 2.220446049250313e-16
MIN_MAX = [f"{a}{m}" for m in ("min", "max") for a in AXES]


def f32(v: float) -> float:
    """The nearest 32-bit float, as a double."""
    return struct.unpack("<f", struct.pack("<f", v))[0]


@dataclass(frozen=True)
class Box:
    """A closed box of literals; positions are rounded to 32-bit floats as the stored ones are."""

    xmin: float
    ymin: float
    tmin: int
    xmax: float
    ymax: float
    tmax: int

    def __post_init__(self) -> None:
        for a in ("xmin", "ymin", "xmax", "ymax"):
            object.__setattr__(self, a, f32(float(getattr(self, a))))
        if self.xmin > self.xmax or self.ymin > self.ymax or self.tmin > self.tmax:
            raise ValueError("a box's minimum is above its maximum")

    def bounds(self, axis: str) -> tuple:
        return getattr(self, f"{axis}min"), getattr(self, f"{axis}max")


def unit_mbb(prefix: str = "") -> list[Column]:
    """xmin, ymin, tmin, xmax, ymax, tmax of the unit's end points, in either order."""
    return [F.least(f"{a}0", f"{a}1").alias(f"{prefix}{a}min") for a in AXES] + [F.greatest(f"{a}0", f"{a}1").alias(f"{prefix}{a}max") for a in AXES]


def unit_center() -> list[Column]:
    """xc, yc as the 32-bit mean, tc as the floor of the mean."""
    return [((F.col(f"{a}0") + F.col(f"{a}1")) / F.lit(2.0)).cast("float").alias(f"{a}c") for a in "xy"] + [F.expr("(t0 + t1) DIV 2").alias("tc")]


def box_center(p: str = "") -> list[Column]:
    return [((F.col(f"{p}{a}min") + F.col(f"{p}{a}max")) / F.lit(2.0)).cast("float").alias(f"{a}c") for a in "xy"] + [F.expr(f"({p}tmin + {p}tmax) DIV 2").alias("tc")]


def widths(p: str = "") -> list[Column]:
    return [F.col(f"{p}{a}max") - F.col(f"{p}{a}min") for a in AXES]


def volume(p: str = "") -> Column:
    w = [c.cast("double") for c in widths(p)]
    return w[0] * w[1] * w[2]


def is_empty(p: str = "") -> Column:
    a, b, c = (w == 0 for w in widths(p))
    return a | b | c


def union_box(p: str, q: str, out: str = "") -> list[Column]:
    return [F.least(f"{p}{a}min", f"{q}{a}min").alias(f"{out}{a}min") for a in AXES] + [F.greatest(f"{p}{a}max", f"{q}{a}max").alias(f"{out}{a}max") for a in AXES]


def extend_agg(p: str = "", out: str = "") -> list[Column]:
    """The box around all boxes of a group, as aggregates."""
    return [F.min(f"{p}{a}min").alias(f"{out}{a}min") for a in AXES] + [F.max(f"{p}{a}max").alias(f"{out}{a}max") for a in AXES]


def unit_extend_agg(out: str = "") -> list[Column]:
    """The box around all units of a group."""
    return [F.min(F.least(f"{a}0", f"{a}1")).alias(f"{out}{a}min") for a in AXES] + [F.max(F.greatest(f"{a}0", f"{a}1")).alias(f"{out}{a}max") for a in AXES]


def boxes_intersect(p: str, q: str) -> Column:
    """Closed on all sides: touching counts."""
    out = F.lit(True)
    for a in AXES:
        out = out & (F.col(f"{p}{a}min") <= F.col(f"{q}{a}max")) & (F.col(f"{q}{a}min") <= F.col(f"{p}{a}max"))
    return out


def box_contains(p: str, q: str) -> Column:
    out = F.lit(True)
    for a in AXES:
        out = out & (F.col(f"{p}{a}min") <= F.col(f"{q}{a}min")) & (F.col(f"{q}{a}max") <= F.col(f"{p}{a}max"))
    return out


def intersection_box(p: str, q: str, out: str = "") -> list[Column]:
    """The common box; the zero box if there is none."""
    meet = boxes_intersect(p, q)
    low = [F.when(meet, F.greatest(f"{p}{a}min", f"{q}{a}min")).otherwise(F.lit(0)).alias(f"{out}{a}min") for a in AXES]
    return low + [F.when(meet, F.least(f"{p}{a}max", f"{q}{a}max")).otherwise(F.lit(0)).alias(f"{out}{a}max") for a in AXES]


def _literal(axis: str, v) -> Column:
    return F.lit(int(v)) if axis == "t" else F.lit(float(v)).cast("float")


def meets(box: Box, p: str = "") -> Column:
    """A box of columns meets a box of literals: plain comparisons, which reach the scan."""
    out = F.lit(True)
    for a in AXES:
        lo, hi = box.bounds(a)
        out = out & (F.col(f"{p}{a}min") <= _literal(a, hi)) & (F.col(f"{p}{a}max") >= _literal(a, lo))
    return out


def unit_mbb_meets(box: Box) -> Column:
    """The unit's box meets the box: for each axis one end is not above it and one is not below it."""
    out = F.lit(True)
    for a in AXES:
        lo, hi = (_literal(a, v) for v in box.bounds(a))
        out = out & ((F.col(f"{a}0") <= hi) | (F.col(f"{a}1") <= hi)) & ((F.col(f"{a}0") >= lo) | (F.col(f"{a}1") >= lo))
    return out


def segment_hits(box: Box) -> Column:
    """The segment meets the closed box, exactly, in double: slab test over the parameter range [0, 1].

    An axis on which the segment does not move has no quotients; there the box test alone decides. Beyond 8,000 bytes of code a
    scan is never compiled, so the steps of a query have to stay small together.
    """
    near, far = [F.lit(0.0)], [F.lit(1.0)]
    for a in AXES:
        p, q = F.col(f"{a}0").cast("double"), F.col(f"{a}1").cast("double")
        one, two = (F.try_divide(F.lit(float(v)) - p, q - p) for v in box.bounds(a))  # null where q = p, which least and greatest pass over
        near.append(F.least(one, two))
        far.append(F.greatest(one, two))
    return unit_mbb_meets(box) & (F.greatest(*near) <= F.least(*far))


def point_less_eq(p: str, q: str) -> Column:
    out = F.lit(True)
    for a in AXES:
        out = out & (F.col(f"{p}{a}") <= F.col(f"{q}{a}"))
    return out


def vectors_equal(p: str, q: str) -> Column:
    return (F.col(f"{p}x") == F.col(f"{q}x")) & (F.col(f"{p}y") == F.col(f"{q}y")) & (F.col(f"{p}t") == F.col(f"{q}t"))


def units_equal(p: str, q: str) -> Column:
    """All fields of two units; the places in their trajectories are not among them."""
    out = F.col(f"{p}label_id") == F.col(f"{q}label_id")
    for end in "01":
        for a in AXES:
            out = out & (F.col(f"{p}{a}{end}") == F.col(f"{q}{a}{end}"))
    return out


def vector_add(p: str, q: str) -> list[Column]:
    return [(F.col(f"{p}{a}") + F.col(f"{q}{a}")).alias(a) for a in AXES]


def vector_sub(p: str, q: str) -> list[Column]:
    return [(F.col(f"{p}{a}") - F.col(f"{q}{a}")).alias(a) for a in AXES]


def interval_contains(begin: Column, end: Column, point: Column) -> Column:
    return (begin <= point) & (point <= end)


def interval_overlaps(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    return (e1 >= b2) & (b1 <= e2)


def interval_distance(begin: Column, end: Column, point: Column) -> Column:
    """0 inside, else how far the nearer end is."""
    return F.greatest(begin - point, point - end, F.lit(0))


def div0(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is nearly 0."""
    return F.when(F.abs(b) < EPSILON, F.lit(0.0)).otherwise(a / b)


def inverse(v: Column) -> Column:
    return F.when(v <= EPSILON / 2, F.lit(0.0)).otherwise(F.lit(1.0) / v)


def format_point(x: str, y: str, t: str) -> Column:
    return F.format_string("(%.5f, %.5f, %d)", F.col(x).cast("double"), F.col(y).cast("double"), F.col(t))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp; earlier ones raise."""
    s = F.unix_timestamp(ts)
    return F.when(s < 0, F.raise_error(F.lit("time before 1970")).cast("long")).otherwise(s)
