"""Leakage of samples as a stream with state of its own: ``transformWithStateInPandas`` with value state, timers and expiry.

Each access to state from Python costs some 0.1 ms, so samples share states: a part (a hash of the sample) has one value state with
its open samples' outcomes so far and the attacks already counted (8 bytes an attack: a 64-bit hash, compared within its
sample), which is read and written once for all rows that a batch has of the part. A part's timer stands at the first end of its
samples: a sample ends ``silence`` after its latest attack in event time, its last row is marked ``final`` and what is held of
it goes. Rows go out in update mode, one for each sample that changed; a repeated attack changes nothing, an attack older than the
watermark is dropped, and an attack on a sample that has ended opens a new state. A task holds one part at a time; more
``parts`` make them smaller.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "sample_id string, outcome string, cost bigint, requests bigint, final boolean"
#: Parts that samples are dealt to; fixed for a checkpoint.
PARTS = 1024
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that such state needs, for queries started inside; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _packed(df: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(df, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class SampleLeakage(StatefulProcessor):
    """Rows (sample, attack: a 64-bit hash, leaked, contained, cost, at in milliseconds) of a part to the outcomes of their samples."""

    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "totals binary, attacks binary, timer bigint")

    def _load(self) -> tuple[pd.DataFrame | None, pd.DataFrame | None, int]:
        """(a row an open sample, a row an attack with the place of its sample, the part's timer)."""
        held = self.held.get()
        return (_unpacked(bytes(held[0])), _unpacked(bytes(held[1])), held[2]) if held else (None, None, -1)

    def _save(self, totals: pd.DataFrame, attacks: pd.DataFrame, timer: int, fired: bool = False) -> None:
        first = int(totals["latest"].min()) + self.silence if len(totals) else -1
        if first != timer or fired:
            if timer >= 0 and not fired:
                self.handle.deleteTimer(timer)
            if first >= 0:
                self.handle.registerTimer(first)
        if len(totals):
            self.held.update((_packed(totals), _packed(attacks), first))
        else:
            self.held.clear()

    @staticmethod
    def _rows(totals: pd.DataFrame, final: bool) -> pd.DataFrame:
        outcome = np.where(totals["leaked"], "leaked", np.where(totals["contained"], "contained", "unscorable"))
        return pd.DataFrame({"sample_id": totals["sample"].to_numpy(), "outcome": outcome, "cost": totals["cost"].to_numpy(), "requests": totals["requests"].to_numpy(), "final": final})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        totals, attacks, timer = self._load()
        known = len(totals) if totals is not None else 0
        names = pd.concat([totals["sample"], new["sample"]], ignore_index=True) if known else new["sample"]
        code, names = pd.factorize(names)  # the samples held come first, in their order
        new["code"] = code[known:]
        seen = pd.DataFrame({"code": new["code"].to_numpy(np.int64), "attack": new["attack"].to_numpy(np.int64)})
        before = len(attacks) if known else 0
        seen = pd.concat([attacks, seen], ignore_index=True) if before else seen
        first = ~seen.duplicated().to_numpy()
        new = new[first[before:]]
        if not len(new):
            return
        some = new.groupby("code").agg(leaked=("leaked", "max"), contained=("contained", "max"), cost=("cost", "sum"), requests=("attack", "size"), latest=("at", "max"))
        old = totals.drop(columns="sample") if known else some.iloc[:0]
        both = pd.concat([old, some]) if known else some
        both = both.groupby(level=0).agg({"leaked": "max", "contained": "max", "cost": "sum", "requests": "sum", "latest": "max"}).sort_index()
        both.insert(0, "sample", np.asarray(names, dtype=object)[both.index.to_numpy()])
        self._save(both, seen[first], timer)
        yield self._rows(both.loc[some.index], False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        totals, attacks, timer = self._load()
        over = (totals["latest"] + self.silence <= max(timerValues.getCurrentWatermarkInMs(), timer)).to_numpy()
        place = np.cumsum(~over) - 1  # of what stays
        code = attacks["code"].to_numpy()
        stays = ~over[code]
        left = pd.DataFrame({"code": place[code[stays]], "attack": attacks["attack"].to_numpy()[stays]})
        self._save(totals[~over], left, timer, fired=True)
        yield self._rows(totals[over], True)

    def close(self) -> None:
        pass


def tracked_leakage(attacks: DataFrame, silence_ms: int, sample: str = "sample_id", attack: str = "attack_id", status: str = "response_status", cost: str = "attack_unit_cost", ts: str = "ts", parts: int = PARTS) -> DataFrame:
    """The changing outcome of each sample of a watermarked stream; run it inside ``keyed_state_store``."""
    spent = F.col(cost).cast("bigint")
    checked = F.when(spent.isNull() | F.col(ts).isNull(), F.raise_error(F.lit(f"{cost} or {ts} is missing")).cast("bigint")).otherwise(spent)
    name = F.coalesce(F.concat(F.lit("v"), F.col(sample).cast("string")), F.lit("n"))  # a null sample is one, too
    is_ = lambda s: F.coalesce(F.col(status) == s, F.lit(False))
    rows = attacks.select(
        F.pmod(F.xxhash64(name), F.lit(parts)).alias("part"), name.alias("sample"), F.xxhash64(F.col(attack).cast("string")).alias("attack"), is_("correct").alias("leaked"), is_("incorrect").alias("contained"),
        checked.alias("cost"), F.unix_millis(ts).alias("at"), F.col(ts),
    )
    out = rows.groupBy("part").transformWithStateInPandas(SampleLeakage(silence_ms), OUTPUT, "update", "eventTime")
    own = F.when(F.startswith("sample_id", F.lit("v")), F.substring("sample_id", 2, 1 << 30)).cast(dict(attacks.dtypes)[sample])
    return out.withColumn("sample_id", own)
