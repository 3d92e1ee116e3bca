"""Writers: JSON lines, split folders, rejects, incremental conditions and wide summaries."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeforge.schema import PUBLIC_FIELDS


def write_jsonl(df: DataFrame, path: str, public_only: bool = False, single_file: bool = False) -> None:
    out = df.select(*PUBLIC_FIELDS) if public_only else df
    out = out.select(F.to_json(F.struct("*")).alias("value"))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(path)


def write_pool(df: DataFrame, path: str, reasons: str = "reasons") -> None:
    """Accepted items and, beside them, rejects with their reasons, and ``stats.json``: counts, the reject rate and the most frequent reasons."""
    write_jsonl(df.where(F.size(reasons) == 0).drop(reasons), f"{path}/all")
    write_jsonl(df.where(F.size(reasons) > 0).select(reasons, F.struct(*(c for c in df.columns if c != reasons)).alias("item")), f"{path}/rejects")
    counts = df.agg(F.count("*").alias("processed"), F.count_if(F.size(reasons) == 0).alias("accepted")).first()
    top = df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(5).collect()
    rejected = counts["processed"] - counts["accepted"]
    stats = counts.asDict() | {"rejected": rejected, "reject_rate": rejected / counts["processed"] if counts["processed"] else None, "top_reasons": {r["reason"]: r["n"] for r in top}}
    write_document(df.sparkSession, f"{path}/stats.json", stats)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder a split; combined_train and combined_test are reads of these by partition pruning."""
    df.write.mode("overwrite").partitionBy(split).json(f"{path}/splits")


def read_combined(spark, path: str, part: str) -> DataFrame:
    return spark.read.json(f"{path}/splits").where(F.startswith("split", F.lit(part + "_")))


def write_condition(df: DataFrame, path: str) -> None:
    """Only the conditions in ``df`` are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition").parquet(path)


def write_wide_csv(df: DataFrame, path: str, sort_by: str) -> None:
    """One sorted file with a header; values that are no numbers count as -1 in the order."""
    df.orderBy(F.coalesce(F.col(sort_by).try_cast("double"), F.lit(-1.0)).desc()).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_document(spark: SparkSession, path: str, doc: dict) -> None:
    """One JSON document as one file, on any file system that Spark can write."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(json.dumps(doc, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, or of the digests of a folder's files in order of their names."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"))
    found = [r["digest"] for r in files.orderBy("path").collect()]  # a row a file
    return found[0] if len(found) == 1 else hashlib.sha256("".join(found).encode()).hexdigest()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder; a temporary one only where that is unset and all runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="probeforge-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}-{name}"


#: Rows of wide records that are one task's work.
SPREAD_ROWS = 20_000


def spread(df: DataFrame, *key: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``key`` to tasks of about ``rows`` rows: a file of few bytes and many rows is otherwise read, and worked on, by one task."""
    parts = -(-df.count() // (rows or SPREAD_ROWS))
    return df.repartition(parts, *key) if parts > 1 else df


def matched(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the items, by a shuffle: few bytes on disk can be millions of rows, too many to broadcast."""
    return left.join(right.hint("merge"), key, how)


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in ``folder``, else in a shared folder, and read again."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{name}" if folder else shared_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
