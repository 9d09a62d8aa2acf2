"""What the training-data operators share: the shared folder, written tables, held-out folds and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one set here where it is unset (tests, local mode)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(spark.sparkContext, "_strail_dir", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="strail-")
            spark.sparkContext._strail_dir = where
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/strail-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there and lost executors lose nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder goes with the job
            return


def own_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names with as many underscores behind them as keep them apart from those taken, in any case of letters."""
    lower, end = {t.lower() for t in taken}, ""
    while any(w.lower() + end in lower for w in wanted):
        end += "_"
    return [w + end for w in wanted]


def text_of(col: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids fall in no fold (null)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string or binary Arrow column without nulls, without copying the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, (_, at, data) = len(column), column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded_ids(spark: SparkSession, rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` rows, those of smallest hash of the key: a fixed sample, small enough to broadcast."""
    return rows.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(bound)


def sample_labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, mod: int, bound: int) -> tuple[list[str], np.ndarray, list[int]]:
    """Texts, 0/1 labels and ids of at most `bound` labelled rows for each label, only of those whose fold isn't 0.

    Rows with a null id, or a label that is neither 0 nor 1, teach nothing. Repeated label rows count once; repeated
    document rows of one id give their smallest text.
    """
    own = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where((fold("doc_id", mod) != 0) & F.col("y").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = bounded_ids(spark, own.where("y = 0"), "doc_id", bound).union(bounded_ids(spark, own.where("y = 1"), "doc_id", bound))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(text_of()).alias("text"))
    got = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in got], np.array([r["y"] for r in got], np.int64), [r["doc_id"] for r in got]
