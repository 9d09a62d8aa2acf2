"""Joins: points with activities, units with dictionaries, ids with new ids, pairs of cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strail.operators.layout import global_rank, parts_for


def label_points(points: DataFrame, activities: DataFrame, by: str, point_key: list[str]) -> DataFrame:
    """points (by, t, ...) with `name` of the activity of earliest (begin, line) whose closed interval holds t, else null.

    The join is an equi-join on the user and a stretch of time with a range condition: stretches are twice as long as the
    mean activity, which is copied to each that it meets, so a user with much data is many keys and points meet the activities
    of their own time only. Of the activities that hold a point one is kept by a minimum over a struct, which is partial.
    """
    mean = activities.agg(F.avg(F.col("end") - F.col("begin"))).first()[0]
    width = max(1, int(2 * (mean or 0)))
    stretch = lambda c: F.floor(F.col(c) / width)
    a = activities.where(F.col("begin") <= F.col("end")).select(F.col(by).alias("__by"), "begin", "end", F.col("line").alias("__line"), "name", F.explode(F.sequence(stretch("begin"), stretch("end"))).alias("__stretch"))
    hit = points.join(a, (F.col(by) == F.col("__by")) & (stretch("t") == F.col("__stretch")) & (F.col("t") >= F.col("begin")) & (F.col("t") <= F.col("end")), "left")
    first = F.min(F.when(F.col("begin").isNotNull(), F.struct("begin", "__line", "name"))).alias("first")
    rest = [c for c in points.columns if c not in point_key]
    out = hit.groupBy(*point_key).agg(*[F.first(c).alias(c) for c in rest], first)
    return out.select(*points.columns, F.col("first.name").alias("name"))


def runs_to_units(points: DataFrame, order: list[str]) -> DataFrame:
    """Units between neighbouring points that both have a label; the label is the later point's, indexes count on."""
    w = Window.partitionBy("trajectory_id").orderBy("t", *order)
    seg = points.select(
        "trajectory_id", F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), F.lag("t").over(w).alias("t0"),
        F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("t").alias("t1"), "name", F.lag("name").over(w).alias("before"), *[F.col(c).alias(f"__{c}") for c in order],
    )
    seg = seg.where("name is not null and before is not null")
    index = F.row_number().over(Window.partitionBy("trajectory_id").orderBy("t1", *[f"__{c}" for c in order])) - 1
    return seg.select("trajectory_id", index.cast("long").alias("unit_index"), "x0", "y0", "t0", "x1", "y1", "t1", "name")


def remap_ids(units: DataFrame, seed: int = 1) -> DataFrame:
    """Each trajectory id replaced by another one of the same set, by rank of a seeded hash: a bijection without collisions."""
    ids = units.select("trajectory_id").distinct()
    parts = parts_for(ids.count())
    order = ids.select("trajectory_id", F.md5(F.concat_ws(":", F.col("trajectory_id").cast("string"), F.lit(str(seed)))).alias("roll"))
    source = global_rank(order, ["roll", "trajectory_id"], "r", parts).drop("roll")
    target = global_rank(ids.withColumnRenamed("trajectory_id", "new_id"), ["new_id"], "r", parts)
    return units.join(source.join(target, "r").drop("r"), "trajectory_id").drop("trajectory_id").withColumnRenamed("new_id", "trajectory_id")


def shuffle_ids(units: DataFrame, seed: int = 1) -> DataFrame:
    """Each trajectory id replaced by a seeded permutation of 64-bit words, narrow: for data of any size, no shuffle at all.

    An odd multiplier and xor-shifts are bijections of the 64-bit integers, so ids stay apart.
    """
    h = F.col("trajectory_id").bitwiseXOR(F.lit(seed * 0x9E3779B9 & (2**62 - 1)))
    for right in (33, 29, 32):
        h = h.bitwiseXOR(F.shiftrightunsigned(h, right))
        h = h.bitwiseXOR(F.shiftleft(h, 17))
    return units.withColumn("trajectory_id", h)


def ordered_pairs(cities: DataFrame, key: str = "idx", most: int = 5000) -> DataFrame:
    """All pairs i < j of a small table; more than `most` rows raise, as pairs grow with their square."""
    n = cities.limit(most + 1).count()
    if n > most:
        raise ValueError(f"pairs of more than {most} rows")
    a = cities.select([F.col(c).alias(f"a_{c}") for c in cities.columns])
    b = cities.select([F.col(c).alias(f"b_{c}") for c in cities.columns])
    return a.join(F.broadcast(b), F.col(f"a_{key}") < F.col(f"b_{key}"))


def shared_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label_id, count_a, count_b) of labels that both histograms have."""
    return a.select("label_id", F.col("count").alias("count_a")).join(b.select("label_id", F.col("count").alias("count_b")), "label_id")
