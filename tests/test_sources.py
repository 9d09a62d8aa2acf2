import datetime as dt

import pytest
from pyspark.sql import functions as F

from strail.sources import units as U
from strail.streaming.ingest import stream_units, write_units_stream

HEAD = "\n".join(["x"] * 6) + "\n"


def _user(root, name, labels, logs):
    d = root / name / "Trajectory"
    d.mkdir(parents=True)
    if labels is not None:
        (root / name / "labels.txt").write_text("Start Time\tEnd Time\tTransportation Mode\n" + labels)
    for f, text in logs.items():
        (d / f).write_text(HEAD + text)


def test_user_logs(spark, tmp_path):
    point = lambda s: f"39.5,116.{s:02d},0,1,2,2008-10-23,02:53:{s:02d}\n"
    _user(tmp_path, "000", "2008/10/23 02:53:04\t2008/10/23 02:53:20\twalk\n2008/10/23 02:53:30\t2008/10/23 02:53:50\tbus\n", {"a.plt": "".join(map(point, (4, 10, 20, 25, 31, 40)))})
    _user(tmp_path, "001", None, {"b.plt": point(4)})
    units, ids = U.read_user_logs(spark, str(tmp_path))
    rows = units.orderBy("trajectory_id", "unit_index").collect()
    assert ids.count() == 1
    assert [(r["unit_index"], r["t1"] - r["t0"], r["label_id"]) for r in rows] == [(0, 6, 1), (1, 10, 1), (2, 9, 2)]
    assert rows[0]["t0"] == int(dt.datetime(2008, 10, 23, 2, 53, 4, tzinfo=dt.UTC).timestamp())


def test_bad_point_raises(spark, tmp_path):
    (tmp_path / "x.plt").write_text(HEAD + "39.5,116,0,1,2,2008-10-23,02:53:04\nnonsense\n")
    with pytest.raises(Exception, match="line 8"):
        U.read_points(spark, str(tmp_path / "x.plt")).collect()


def test_dictionary(spark):
    names = spark.createDataFrame([("C", 1), ("B", 2), ("D", 3), ("A", 4), ("C", 5)], "name string, n int")
    first = U.label_dictionary(names, "name", ["n"])
    assert [r["name"] for r in first.orderBy("label_id").collect()] == ["C", "B", "D", "A"]
    more = U.extend_dictionary(first, spark.createDataFrame([("E", 1), ("A", 2)], "name string, n int"), "name", ["n"])
    assert {r["name"]: r["label_id"] for r in more.collect()} == {"C": 1, "B": 2, "D": 3, "A": 4, "E": 5}


def test_units_by_a_map_need_all_fields(spark):
    with pytest.raises(ValueError, match="unit_index"):
        U.as_units(spark.range(1), {"trajectory_id": "id"})


def test_offset_beyond_the_end(spark):
    with pytest.raises(ValueError):
        U.offset_limit(U.random_walk(spark, 10, 5, 2), 11)


def test_stream_gives_the_units_of_the_batch(spark, tmp_path):
    schema = "trajectory_id long, t long, x float, y float, label_id long, ord long"
    rows = [(i % 3, 10 * i, float(i), 0.0, 1, i) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    points = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = write_units_stream(stream_units(points), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()}
    batch = U.units_from_points(spark.createDataFrame(rows, schema).withColumn("name", F.col("label_id")), ["ord"])
    assert got == {tuple(r) for r in batch.select("trajectory_id", "unit_index", "x0", "y0", "t0", "x1", "y1", "t1", F.col("name").alias("label_id")).collect()} and len(got) == 27


def test_stream_sets_late_points_aside(spark, tmp_path):
    schema = "trajectory_id long, t long, x float, y float, label_id long, ord long"
    for k, rows in enumerate([[(1, 10, 0.0, 0.0, 1, 0), (1, 20, 1.0, 0.0, 1, 1)], [(1, 15, 9.0, 9.0, 1, 2), (1, 30, 2.0, 0.0, 1, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        points = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = write_units_stream(stream_units(points, late=True), str(tmp_path / "out"), str(tmp_path / "cp"), late_path=str(tmp_path / "late")).start()
        q.processAllAvailable()
        q.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("unit_index", "t0", "t1").collect())
    late = [tuple(r) for r in spark.read.parquet(str(tmp_path / "late")).select("trajectory_id", "t1", "x1", "y1").collect()]
    assert got == [(0, 10, 20), (1, 20, 30)] and late == [(1, 15, 9.0, 9.0)]
