"""Structured Streaming forms (extensions): windowed accounting, sessions and deduplication with watermarks.

In append mode a window or session goes out once the watermark has passed its end, and its state goes then; rows older than the
watermark are dropped. ``state`` holds the form with state and timers of its own.

Each function takes a streaming or a batch DataFrame and gives the same rows for both once a watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeforge.operators.accounting import sample_outcomes, status_columns


def timed(df: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """With ``ts`` as a timestamp and a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed_accounting(df: DataFrame, ts: str = "ts", width: str = "1 day", slide: str | None = None, status: str = "response_status") -> DataFrame:
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(window.alias("w")).agg(*status_columns(status)).select(F.col("w.start").alias("start"), "*").drop("w")


def sessions(df: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    out = df.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_requests(df: DataFrame, key: str = "request_id") -> DataFrame:
    """The first row of each key within the watermark (streaming) or of all rows (batch)."""
    return df.dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is available, into an in-memory table; for tests and demonstrations."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def sample_leakage(df: DataFrame, **columns: str) -> DataFrame:
    """The outcome of each sample, kept up to date as its attacks arrive."""
    return sample_outcomes(df, **columns)


def run_updates(df: DataFrame, folder: str, key: str) -> DataFrame:
    """All that is available of an update-mode stream; the latest row of each ``key`` over this and all earlier runs with ``folder``.

    Each batch is its own part, written again if it is run again, so a restart neither loses nor doubles a change.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = df.writeStream.foreachBatch(sink).outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start()
    q.awaitTermination()
    changes = df.sparkSession.read.schema(f"{', '.join(f'`{n}` {k}' for n, k in df.dtypes)}, batch int").parquet(f"{folder}/out")
    last = changes.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct("batch", *(["final"] if "final" in df.columns else []))).alias("r"))
    return last.select("r.*")


def run_to_folder(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is available, through ``foreachBatch`` into Parquet below ``folder``; a batch written again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/all" if mode == "complete" else f"{folder}/out/part={number}")

    q = df.writeStream.foreachBatch(sink).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out/all" if mode == "complete" else f"{folder}/out/part=*")
