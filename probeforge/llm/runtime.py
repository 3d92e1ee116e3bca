"""Cutting lineage in the shared folder, Arrow batches of bounded bytes, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch of texts: the JVM and the worker each hold one or two for a task.
BATCH_BYTES = 8 << 20


def lean_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about BATCH_BYTES, unless the session has a limit of its own; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(key, str(BATCH_BYTES))


def map_rows(docs: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``change`` applied to batches of whole rows, whatever the columns are called."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(change(batch).columns, names=names)

    lean_batches(docs.sparkSession)
    return docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, docs.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="probeforge-"))
            have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get()
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Later steps read the files, so a lost executor costs no recomputation of what came before. The files
    stay with the run's shared folder, whose owner removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/probeforge/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted), else as it is.

    Meant for staged tables of a few numeric columns, whose count is read from Parquet footers.
    """
    return F.broadcast(df) if df.count() <= rows else df
