"""Streams with watermarks and state of their own: late and repeated rows, expiry, restart from the checkpoint."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from probeforge.streaming import metrics as M
from probeforge.streaming.state import keyed_state_store, tracked_leakage

KIND = "sample_id string, attack_id string, response_status string, attack_unit_cost int, ts timestamp"
BEGIN = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def rows(*given):
    return [(s, a, status, 1, None if m is None else BEGIN + dt.timedelta(minutes=m)) for s, a, status, m in given]


@pytest.fixture
def leakage(spark, tmp_path):
    def run(*given):
        spark.createDataFrame(rows(*given), KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = M.timed(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), "ts", "10 minutes")
        with keyed_state_store(spark):
            out = M.run_updates(tracked_leakage(stream, HOUR), str(tmp_path), "sample_id")
        return {r["sample_id"]: tuple(r)[1:] for r in out.collect()}

    return run


def test_state_over_restarts(leakage, spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = leakage(("a", "1", "refusal", 0), ("b", "1", "incorrect", 1), ("a", "2", "incorrect", 2), ("a", "2", "incorrect", 2))
    assert got == {"a": ("contained", 2, 2, False), "b": ("contained", 1, 1, False)}
    # a new run goes on from the checkpoint: a repeated attack counts once, however late it comes again
    got = leakage(("a", "1", "refusal", 0), ("a", "3", "correct", 20), ("c", "1", "refusal", 20))
    assert got == {"a": ("leaked", 3, 3, False), "b": ("contained", 1, 1, False), "c": ("unscorable", 1, 1, False)}
    # minute 75: b has been silent for over an hour, a and c have not; an attack before the watermark is dropped
    got = leakage(("d", "1", "incorrect", 75), ("c", "2", "correct", 5))
    assert got == {"a": ("leaked", 3, 3, False), "b": ("contained", 1, 1, True), "c": ("unscorable", 1, 1, False), "d": ("contained", 1, 1, False)}
    # all that were silent end; b opens a new state
    got = leakage(("b", "1", "correct", 400))
    assert got == {"a": ("leaked", 3, 3, True), "b": ("leaked", 1, 1, False), "c": ("unscorable", 1, 1, True), "d": ("contained", 1, 1, True)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_missing_time_fails(leakage):
    from pyspark.errors import StreamingQueryException

    with pytest.raises(StreamingQueryException, match="attack_unit_cost or ts is missing"):
        leakage(("a", "1", "refusal", None))


def test_state_is_dropped(spark, tmp_path):
    """Windows that the watermark has passed leave the state store, and late rows do not come back."""
    kind = "request_id long, ts timestamp, response_status string"
    day = lambda i, h=0: BEGIN + dt.timedelta(days=i, hours=h)
    (tmp_path / "in").mkdir()
    stream = M.timed(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), "ts", "1 hour")
    got = None
    for given in ([(1, day(0), "correct"), (2, day(0, 5), "refusal"), (3, day(1, 2), "correct")], [(4, day(0, 6), "correct"), (5, day(3), "correct")]):
        spark.createDataFrame(given, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = M.run_to_folder(M.windowed_accounting(stream), str(tmp_path))
    assert sorted((r["start"].day, r["attempted"], r["n_correct"]) for r in got.collect()) == [(1, 2, 1), (2, 1, 1)]
    q = M.windowed_accounting(stream).writeStream.format("noop").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/again").start()
    q.awaitTermination()
    states = [p["stateOperators"][0] for p in map(lambda p: json.loads(p.json), q.recentProgress) if p["stateOperators"]]
    assert states[-1]["numRowsTotal"] == 1 and sum(s["numRowsRemoved"] for s in states) == 2


def test_first_requests_forget(spark, tmp_path):
    kind = "request_id long, ts timestamp"
    at = lambda m: BEGIN + dt.timedelta(minutes=m)
    for given in ([(1, at(0)), (1, at(1)), (2, at(2))], [(1, at(5)), (3, at(300))], [(1, at(301)), (3, at(302)), (2, at(3))]):
        spark.createDataFrame(given, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = M.run_to_folder(M.first_requests(M.timed(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), "ts", "10 minutes")), str(tmp_path))
    # request 1 is new again long after its key was forgotten; request 2 at minute 3 is older than the watermark
    assert sorted((r["request_id"], r["ts"] >= at(300)) for r in got.select("request_id", F.col("ts")).collect()) == [(1, False), (1, True), (2, False), (3, True)]
