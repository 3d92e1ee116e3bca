"""A run in shards that can be resumed: a table of finished shards, an anti-join of what is left, a reduce of what is there.

One job answers all shards that are left. A shard that its model gives up on (``WorkerFailure``, or a model that cannot be loaded)
yields a row that says so, and does not stop the others; its answers of this attempt do not count. Then the shards whose answers are
all there are committed: one row a shard with the attempt that answered it. Reading goes through these rows, so answers of
attempts that failed or were cut off are never seen, and a shard is committed once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeforge.functions.text import hex_int
from probeforge.operators.accounting import accounting_sets
from probeforge.operators.inference import NO_OP, RESPONSE, Adapter, Method, WorkerFailure, answer_batches, requests
from probeforge.operators.sampling import seeded
from probeforge.operators.scoring import score_responses
from probeforge.sources.writers import matched

COMMIT = "shard int, attempt string, requests long"


def shard_of(of: int, *key: str):
    """The number of a row's shard, as ``sampling.shard`` cuts them."""
    return F.pmod(hex_int(F.substring(seeded("shard", *key), 1, 8)), F.lit(of)).cast("int")


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, attempt, requests) of the committed shards; a row a shard."""
    empty = spark.createDataFrame([], COMMIT)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(COMMIT).parquet(f"{folder}/commits") if there else empty


def _answers(reqs: DataFrame, adapter: Adapter, batch_size: int) -> DataFrame:
    load = adapter.load

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, why, lost = None, None, set()
        try:
            model = load()
        except Exception as e:  # noqa: BLE001  any fault of a model is recorded
            why = f"{type(e).__name__}: {e}"
        for pdf in batches:
            for shard, rows in pdf.groupby("shard", sort=False):
                if shard in lost:
                    continue
                failed = why
                if not failed:
                    try:
                        yield answer_batches(model, rows, batch_size).assign(shard=shard, failed=None)
                    except WorkerFailure as e:
                        failed = f"WorkerFailure: {e}"
                if failed:
                    lost.add(shard)
                    yield pd.DataFrame({"request_id": [None], "raw_output": [None], "error_status": [None], "error_detail": [None], "latency_ms": [None], "shard": [shard], "failed": [failed]}).astype({"latency_ms": "float64"})

    return reqs.repartition("shard").mapInPandas(run, RESPONSE + ", shard int, failed string")


def run_shards(items: DataFrame, adapter: Adapter, folder: str, of: int, method: Method = NO_OP, run_id: str = "run", batch_size: int = 64) -> DataFrame:
    """Answers the shards that ``folder`` lacks; (shard, failed) of those that could not be finished. Call it again to resume."""
    spark = items.sparkSession
    method.check(adapter)
    asked = requests(items, run_id, method).withColumn("shard", shard_of(of, "item_id"))
    left = asked.join(F.broadcast(finished(spark, folder).select("shard")), "shard", "left_anti")  # a row a shard
    attempt = uuid.uuid4().hex
    path = f"{folder}/answers/attempt={attempt}"
    method.answered(_answers(left, method.applied(adapter), batch_size)).write.parquet(path)
    said = spark.read.parquet(path)
    wanted = left.groupBy("shard").agg(F.count("*").alias("requests"))
    got = said.groupBy("shard").agg(F.count("request_id").alias("n"), F.count_distinct("request_id").alias("different"), F.max("failed").alias("failed"))
    state = wanted.join(got, "shard", "left").select("shard", "requests", F.coalesce("failed", F.when((F.coalesce("n", F.lit(0)) != F.col("requests")) | (F.col("different") != F.col("requests")), "answers missing or repeated")).alias("failed"))
    rows = state.collect()  # a row a shard
    done = [(r["shard"], attempt, r["requests"]) for r in rows if not r["failed"]]
    if done:
        spark.createDataFrame(done, COMMIT).coalesce(1).write.mode("append").parquet(f"{folder}/commits")
    return spark.createDataFrame([(r["shard"], r["failed"]) for r in rows if r["failed"]], "shard int, failed string")


def shard_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of the committed shards."""
    done = finished(spark, folder)
    if done.isEmpty():
        return spark.createDataFrame([], RESPONSE + ", shard int")
    said = spark.read.schema(RESPONSE + ", shard int, failed string, attempt string").parquet(f"{folder}/answers")
    return said.where("failed is null").join(F.broadcast(done.select("shard", "attempt")), ["shard", "attempt"], "left_semi").drop("failed", "attempt")


def reduce_shards(items: DataFrame, folder: str, of: int, method: Method = NO_OP, run_id: str = "run") -> tuple[DataFrame, DataFrame, list[int]]:
    """(records, metrics, numbers of the shards that are missing) of what is committed, whether or not all is."""
    spark = items.sparkSession
    asked = requests(items, run_id, method)
    records = score_responses(matched(asked, shard_answers(spark, folder), "request_id"))
    metrics = accounting_sets(records, [[], ["split", "question_format", "input_condition"], ["concept_id", "input_condition"]])
    have = {r["shard"] for r in finished(spark, folder).collect()}  # a row a shard
    used = {r["shard"] for r in asked.select(shard_of(of, "item_id").alias("shard")).distinct().collect()}
    return records, metrics, sorted(used - have)
