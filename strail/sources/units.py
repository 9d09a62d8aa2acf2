"""Sources of units: points, activities, route steps, random walks and files."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strail.schema import UNITS

PIECE_SECONDS, SPLIT_SECONDS = 15, 20


def read_units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UNITS).parquet(path)


def write_units(units: DataFrame, path: str, mode: str = "overwrite") -> None:
    units.select(*UNITS.fieldNames()).write.mode(mode).parquet(path)


def as_units(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Any table as units: columns names the column, or the SQL expression, of each field; all fields are needed."""
    missing = [f for f in UNITS.fieldNames() if f not in columns]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return rows.select(*[F.expr(columns[f.name]).cast(f.dataType).alias(f.name) for f in UNITS])


def units_from_points(points: DataFrame, order: list[str], label: str = "name") -> DataFrame:
    """points (trajectory_id, t, x, y, label, order columns) -> a unit for each pair of neighbours; the later point's label.

    One window over one partitioning: the scan, one shuffle by trajectory and a sort.
    """
    w = Window.partitionBy("trajectory_id").orderBy("t", *order)
    seg = points.select(
        "trajectory_id",
        (F.row_number().over(w) - 1).cast("long").alias("unit_index"),
        F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("t").alias("t0"),
        F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.lead("t").over(w).alias("t1"),
        F.lead(label).over(w).alias("name"),
    )
    return seg.where("t1 IS NOT NULL")


def _rank_key(rows: DataFrame, order: list[str]) -> Column:
    """What a minimum over `order` is taken of. Two whole numbers are packed into one decimal, which a hash aggregate can
    hold; a minimum of structs makes Spark sort all rows instead."""
    kinds = dict(rows.dtypes)
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and all(kinds[c] in ("int", "bigint") for c in order):
        high, low = (F.col(c).cast("decimal(20,0)") for c in order)
        return (high * F.lit(Decimal(2**64)) + (low + F.lit(Decimal(2**63)))).cast("decimal(38,0)")
    return F.struct(*order)


def label_dictionary(points: DataFrame, label: str, order: list[str]) -> DataFrame:
    """(label_id, name): ids from 1 in the order of first occurrence. The window is over distinct names only.

    Of two order columns the first is a time below 2^32, or small in the same way.
    """
    first = points.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("name")).agg(F.min(_rank_key(points, order)).alias("first"))
    return first.select(F.row_number().over(Window.orderBy("first")).cast("long").alias("label_id"), "name")


def extend_dictionary(labels: DataFrame, names: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The dictionary with names it lacks, numbered on in the order of first occurrence; known ids stay."""
    fresh = label_dictionary(names.join(labels.select(F.col("name").alias(name)), name, "left_anti"), name, order)
    top = labels.agg(F.coalesce(F.max("label_id"), F.lit(0)).alias("top"))
    return labels.unionByName(fresh.crossJoin(F.broadcast(top)).select((F.col("label_id") + F.col("top")).alias("label_id"), "name"))  # top is one row


def with_label_ids(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Names replaced by ids; a name that the dictionary lacks raises."""
    joined = rows.join(labels, "name", "left")
    missing = F.raise_error(F.concat(F.lit("no label id for "), F.col("name"))).cast("long")
    return joined.withColumn("label_id", F.when(F.col("name").isNotNull() & F.col("label_id").isNull(), missing).otherwise(F.col("label_id"))).drop("name")


def with_label_names(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "label_id", "left")


def event_points(events: DataFrame) -> DataFrame:
    """Points of the events table: a user's path over value and props.k."""
    return events.select(
        F.col("user_id").alias("trajectory_id"), "event_id", F.unix_timestamp("ts").alias("t"), F.col("value").cast("float").alias("x"),
        F.get_json_object("props", "$.k").cast("float").alias("y"), F.col("event_type").alias("name"),
    )


def units_from_events(events: DataFrame) -> DataFrame:
    points = event_points(events)
    return with_label_ids(units_from_points(points, ["event_id"]), label_dictionary(points, "name", ["t", "event_id"])).select(*UNITS.fieldNames())


def order_points(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_custkey").alias("trajectory_id"), "o_orderkey", F.unix_timestamp("o_orderdate").alias("t"), F.col("o_totalprice").cast("float").alias("x"),
        F.substring("o_orderpriority", 1, 1).cast("float").alias("y"), F.col("o_orderstatus").alias("name"),
    )


def units_from_orders(orders: DataFrame) -> DataFrame:
    points = order_points(orders)
    return with_label_ids(units_from_points(points, ["o_orderkey"]), label_dictionary(points, "name", ["t", "o_orderkey"])).select(*UNITS.fieldNames())


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """GPS logs (six header lines; lat, lon, three ignored fields, date, time): (path, line, lat, lon, t); bad lines raise."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    lines = lines.where("line >= 6 and trim(text) <> ''")
    p = F.split("text", ",")
    strict = r"^\s*-?\d+(\.\d+)?\s*,\s*-?\d+(\.\d+)?\s*,[^,]*,[^,]*,[^,]*,\s*\d{4}-\d{2}-\d{2}\s*,\s*\d{2}:\d{2}:\d{2}\s*$"
    bad = F.raise_error(F.concat(F.lit("Expected a point in line "), (F.col("line") + 1).cast("string")))
    ok = F.when(F.col("text").rlike(strict), F.col("text")).otherwise(bad.cast("string"))
    t = F.to_timestamp(F.concat_ws(" ", F.trim(p[5]), F.trim(p[6])), "yyyy-MM-dd HH:mm:ss")
    return lines.withColumn("text", ok).select("path", "line", F.trim(p[0]).cast("double").alias("lat"), F.trim(p[1]).cast("double").alias("lon"), F.unix_timestamp(t).alias("t"))


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    """Activity logs (one header line; begin, end inclusive, mode): (path, line, begin, end, name); bad lines raise."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    lines = lines.where("line >= 1 and trim(text) <> ''")
    pattern = r"^\s*(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+([A-Za-z0-9]+)\s*$"
    bad = F.raise_error(F.concat(F.lit("Expected an activity in line "), (F.col("line") + 1).cast("string")))
    ok = F.when(F.col("text").rlike(pattern), F.col("text")).otherwise(bad.cast("string"))
    stamp = lambda i: F.unix_timestamp(F.to_timestamp(F.regexp_replace(F.regexp_extract("text", pattern, i), r"\s+", " "), "yyyy/MM/dd HH:mm:ss"))
    return lines.withColumn("text", ok).select("path", "line", stamp(1).alias("begin"), stamp(2).alias("end"), F.regexp_extract("text", pattern, 3).alias("name"))


def number_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, trajectory_id): ids from 1 in the order of the paths; the window is over distinct paths only."""
    return paths.select(column).distinct().select(column, F.row_number().over(Window.orderBy(column)).cast("long").alias("trajectory_id"))


def read_user_logs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(units, path ids) of a folder of users, each with labels.txt and Trajectory/*.plt; users without labels.txt are left out."""
    from strail.operators.joins import label_points, runs_to_units

    user = lambda part: F.regexp_extract("path", rf"([^/]+)/{part}", 1)
    acts = read_activities(spark, f"{root}/*/labels.txt").withColumn("user", user("labels"))
    points = read_points(spark, f"{root}/*/Trajectory/*.plt").withColumn("user", user("Trajectory"))
    points = points.join(acts.select("user").distinct(), "user", "left_semi")
    ids = number_paths(points)
    points = points.join(ids, "path").select("trajectory_id", "user", "line", "t", F.col("lon").cast("float").alias("x"), F.col("lat").cast("float").alias("y"))
    labelled = label_points(points, acts.select("user", "line", "begin", "end", "name"), by="user", point_key=["trajectory_id", "line"])
    labels = label_dictionary(acts, "name", ["user", "begin", "line"])
    return with_label_ids(runs_to_units(labelled, ["line"]), labels).select(*UNITS.fieldNames()), ids


def split_long_units(units: DataFrame, piece: int = PIECE_SECONDS, limit: int = SPLIT_SECONDS) -> DataFrame:
    """Units of `limit` seconds or more cut into pieces of `piece` seconds by linear interpolation; indexes are set anew.

    Piece k runs from x0 + dx * piece * k to x0 + dx * piece * (k + 1) in double, then 32 bits; the last ends at the unit's end.
    """
    dt = F.col("t1") - F.col("t0")
    n = F.when(dt >= limit, F.ceil(dt / F.lit(float(piece)))).otherwise(F.lit(1)).cast("int")
    rows = units.withColumn("n", n).withColumn("k", F.explode(F.expr("sequence(0, n - 1)")))
    last = F.col("k") == F.col("n") - 1
    at = lambda a, k: (F.col(f"{a}0").cast("double") + (F.col(f"{a}1").cast("double") - F.col(f"{a}0").cast("double")) * (k * piece).cast("double") / dt.cast("double")).cast("float")
    k, nxt = F.col("k"), F.col("k") + 1
    cols = {}
    for a in "xy":
        cols[f"{a}s"] = F.when(k == 0, F.col(f"{a}0")).otherwise(at(a, k))
        cols[f"{a}e"] = F.when(last, F.col(f"{a}1")).otherwise(at(a, nxt))
    cols["ts_"], cols["te"] = F.col("t0") + k * piece, F.when(last, F.col("t1")).otherwise(F.col("t0") + nxt * piece)
    w = Window.partitionBy("trajectory_id").orderBy("unit_index", "k")
    rows = rows.withColumns(cols)
    return rows.select("trajectory_id", (F.row_number().over(w) - 1).cast("long").alias("unit_index"), F.col("xs").alias("x0"), F.col("ys").alias("y0"), F.col("ts_").alias("t0"), F.col("xe").alias("x1"), F.col("ye").alias("y1"), F.col("te").alias("t1"), "label_id")


def route_label(ref: Column, name: Column) -> Column:
    """The reference if there is one, else the name, else N/A."""
    return F.coalesce(F.nullif(ref, F.lit("")), F.nullif(name, F.lit("")), F.lit("N/A"))


def step_seconds(duration: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(duration).cast("long"))


def units_from_routes(steps: DataFrame) -> DataFrame:
    """steps (route_id, step, x, y, duration, name) -> units; times add up along the route, the first step gives only its place.

    Steps that share a number go by place, duration and name.
    """
    w = Window.partitionBy("route_id").orderBy("step", "x", "y", "duration", "name")
    t = F.sum(step_seconds(F.col("duration"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = steps.withColumn("t", t).select(
        F.col("route_id").alias("trajectory_id"), (F.row_number().over(w) - 2).cast("long").alias("unit_index"),
        F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), F.lag("t").over(w).alias("t0"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("t").alias("t1"), "name",
    )
    return rows.where("unit_index >= 0")


def random_walk(spark: SparkSession, units: int, per_trajectory: int = 1000, labels: int = 1000, width: float = 1000.0, height: float = 1000.0, seed: int = 1) -> DataFrame:
    """Random walks: each trajectory has U[0.5, 1.5) * per_trajectory units (the last is cut), steps of up to 5 a side.

    Trajectories are generated apart from each other, so any number of them is one parallel job.
    """
    count = max(1, 2 * -(-units // per_trajectory) + 1)
    heads = spark.range(1, count + 1).select(F.col("id").alias("trajectory_id"), F.floor((0.5 + F.rand(seed)) * per_trajectory).cast("long").alias("n"))
    before = F.sum("n").over(Window.orderBy("trajectory_id").rowsBetween(Window.unboundedPreceding, -1))  # one row a trajectory
    heads = heads.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < units).withColumn("n", F.least("n", F.lit(units) - F.col("before"))).where("n > 0")
    steps = heads.select("trajectory_id", F.explode(F.expr("sequence(0L, n)")).alias("k"))
    first = F.col("k") == 0
    roll = lambda i: F.rand(seed + i)
    steps = steps.select(
        "trajectory_id", "k",
        F.when(first, roll(1) * width).otherwise(roll(1) * 10 - 5).alias("dx"), F.when(first, roll(2) * height).otherwise(roll(2) * 10 - 5).alias("dy"),
        F.when(first, F.floor(roll(3) * 100_000)).otherwise(5 + F.floor(roll(3) * 20)).cast("long").alias("dt"),
        F.when((F.col("k") <= 1) | (roll(4) < 0.2), 1 + F.floor(roll(5) * labels)).cast("long").alias("switch"),
    )
    w = Window.partitionBy("trajectory_id").orderBy("k")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = steps.select("trajectory_id", "k", F.sum("dx").over(run).cast("float").alias("x"), F.sum("dy").over(run).cast("float").alias("y"), F.sum("dt").over(run).alias("t"), F.last("switch", ignorenulls=True).over(run).alias("label_id"))
    seg = walked.select("trajectory_id", (F.col("k") - 1).alias("unit_index"), F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), F.lag("t").over(w).alias("t0"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("t").alias("t1"), "label_id")
    return seg.where("unit_index >= 0")


SLICE = 100_000  # rows that a slice may reach to without ranks over all rows


def offset_limit(units: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A slice in (trajectory_id, unit_index) order; an offset beyond the end raises."""
    size = units.count()
    if offset > size:
        raise ValueError(f"offset {offset} is beyond the {size} units")
    if limit is not None and offset + limit <= SLICE:  # so few are kept by each task while it reads
        return units.orderBy("trajectory_id", "unit_index").offset(offset).limit(limit)
    from strail.operators.layout import global_rank, parts_for

    place = F.col("__place")
    placed = global_rank(units, ["trajectory_id", "unit_index"], "__place", parts_for(size)).where(place >= offset)
    return (placed if limit is None else placed.where(place < offset + limit)).drop("__place")


def demo_points(spark: SparkSession, n: int, skewed: bool = False, seed: int = 1) -> DataFrame:
    """2-D points: uniform in a unit square, or around three centres with radii that thin out."""
    base = spark.range(n)
    if not skewed:
        return base.select("id", F.rand(seed).alias("x"), F.rand(seed + 1).alias("y"))
    centre, angle, radius = F.floor(F.rand(seed) * 3), F.rand(seed + 1) * 6.283185307179586, F.pow(F.rand(seed + 2), 2) * 0.2
    rows = base.select("id", centre.alias("c"), angle.alias("a"), radius.alias("r"))
    cx, cy = F.element_at(F.array(*map(F.lit, (0.25, 0.7, 0.6))), F.col("c").cast("int") + 1), F.element_at(F.array(*map(F.lit, (0.3, 0.25, 0.75))), F.col("c").cast("int") + 1)
    return rows.select("id", (cx + F.cos("a") * F.col("r")).alias("x"), (cy + F.sin("a") * F.col("r")).alias("y"))
