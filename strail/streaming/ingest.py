"""Units from a stream of points: an incremental source for an index.

Points of a trajectory become units as they arrive; the last point of each trajectory is the state. Batches append units
to a Parquet table, exactly once per batch id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "trajectory_id long, unit_index long, x0 float, y0 float, t0 long, x1 float, y1 float, t1 long, label_id long"
STATE = "x float, y float, t long, n long"
LATE = -1  # unit_index of the rows of late points


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    pdf = pd.concat(list(batches), ignore_index=True).sort_values(["t", "ord"], kind="stable")
    out = []
    for p in pdf.itertuples(index=False):
        if last is not None and p.t < last[2]:
            out.append((key[0], LATE, None, None, None, p.x, p.y, p.t, p.label_id))  # older than the state: too late for its place
            continue
        if last is not None:
            out.append((key[0], last[3], last[0], last[1], last[2], p.x, p.y, p.t, p.label_id))
        last = (float(p.x), float(p.y), int(p.t), 0 if last is None else last[3] + 1)
    if last is not None:
        state.update(last)
    made = pd.DataFrame(out, columns=["trajectory_id", "unit_index", "x0", "y0", "t0", "x1", "y1", "t1", "label_id"], dtype=object)
    yield made.astype({"trajectory_id": "int64", "unit_index": "int64", "t0": "Int64", "t1": "int64", "label_id": "Int64", **{c: "float32" for c in ("x0", "y0", "x1", "y1")}})


def stream_units(points: DataFrame, late: bool = False) -> DataFrame:
    """A stream of points (trajectory_id, t, x, y, label_id, ord) -> a stream of units.

    A point older than the last one of its trajectory is late. With `late` it comes as a row of unit_index LATE whose end
    is the point, for write_units_stream() to set aside; without, it is left out.
    """
    units = points.groupBy("trajectory_id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return units if late else units.where(f"unit_index <> {LATE}")


def write_units_stream(units: DataFrame, path: str, checkpoint: str, late_path: str | None = None):
    """Appends each batch under its own folder, which a repeated batch overwrites; late points, if they are in it, go to late_path."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where(f"unit_index <> {LATE}").write.mode("overwrite").parquet(f"{path}/batch={number}")
        if late_path is not None:
            batch.where(f"unit_index = {LATE}").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        batch.unpersist()

    return units.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
