"""Where tables that are used more than once are kept, and where files of a session may go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir, the folder that all executors see; None where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None)


def keep(df: DataFrame) -> DataFrame:
    """df, computed once: in the shared folder, where lost executors lose nothing, else (local runs) in memory and on disk."""
    return df.checkpoint() if shared_folder(df.sparkSession) else df.persist()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that driver and executors share; a local folder only where the master is local."""
    folder = shared_folder(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_strail_scratch", None) or "file://" + tempfile.mkdtemp(prefix="strail-")
        spark.sparkContext._strail_scratch = folder
    return f"{folder.rstrip('/')}/strail-{name}-{uuid.uuid4().hex}"
