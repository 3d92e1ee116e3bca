"""The legacy run of items under conditions, by each of its four ways, with every answer written once and read from there.

``batch`` and ``single``: text is generated for a batch or one request at a time and its digit is read. ``logit``: the options are scored at
the end of the prompt, whose forced open think block is closed first. ``thinking``: thoughts are generated in rounds of the adapter's budget;
only requests whose block is still open are asked again, after the last round the block is closed, and then the options are scored.

A request without its image is not asked. Oracle conditions on retain splits are the baseline's records under another name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeforge.functions.text import answer_prompt, argmax_option, closed_think, legacy_digit, legacy_prompt, open_think
from probeforge.operators.inference import Adapter, infer, infer_options
from probeforge.schema import CapabilityMismatch, require_none
from probeforge.sources.writers import matched, spread, staged

PATHS = ("batch", "single", "logit", "thinking")
RECORD = ("id", "split", "condition", "gt_index", "pred_index", "is_correct", "is_invalid", "error", "raw_output", "meta_synset")


def conditioned(items: DataFrame, conditions: list[str], concepts: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """A request for each item and condition, with prompt_text and missing (an image that ``files`` (path) lacks)."""
    per_item = F.col("condition").isin("ORACLE_HARD", "ORACLE_REVERSE")
    is_forget = F.col("split").endswith("_forget")
    rows = items.withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).where(~per_item | is_forget)
    rows = rows.withColumns({"request_id": F.concat_ws("/", "condition", "item_id"), "prompt_text": legacy_prompt("question", "choices", "condition", is_forget, "concept_name", concepts)})
    if files is None:
        return rows.withColumn("missing", F.lit(False))
    there = files.select(F.col("path").alias("image"), F.lit(True).alias("there")).distinct()
    return matched(rows, there, "image", "left").withColumn("missing", F.col("there").isNull()).drop("there")


def _continued(reqs: DataFrame, adapter: Adapter, batch_size: int) -> DataFrame:
    """(request_id, more, think_error): what the model adds to each thought."""
    load = adapter.think

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                some = pdf.iloc[at : at + batch_size]
                try:
                    found, failed = list(model(some)), None
                    if len(found) != len(some):
                        raise ValueError(f"{len(found)} outputs for {len(some)} requests")
                except Exception as e:  # noqa: BLE001  any fault of a model is recorded
                    found, failed = [""] * len(some), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"request_id": some["request_id"].to_numpy(), "more": found, "think_error": failed}).astype({"think_error": "object"})

    return reqs.mapInPandas(run, "request_id string, more string, think_error string")


def thoughts(reqs: DataFrame, adapter: Adapter, rounds: int = 2, batch_size: int = 64) -> DataFrame:
    """(request_id, thought with its block closed, rounds it took, think_error). Each round asks only what the one before left open."""
    if adapter.think is None:
        raise CapabilityMismatch(["think"], adapter.name)
    left, done = reqs.withColumns({"thought": F.lit(""), "think_error": F.lit(None).cast("string")}), None
    for n in range(1, rounds + 1):
        said = staged(_continued(left.select("request_id", F.concat("prompt_text", "thought").alias("prompt_text"), "thought", *[c for c in reqs.columns if c not in ("request_id", "prompt_text")]), adapter, batch_size), f"thoughts-{n}")
        now = matched(left.drop("think_error"), said, "request_id").withColumn("thought", F.concat("thought", "more")).drop("more")
        closed = F.lit(n == rounds) | F.col("think_error").isNotNull() | ~open_think("thought")
        over = now.where(closed).select("request_id", closed_think("thought").alias("thought"), F.lit(n).alias("rounds"), "think_error")
        done = over if done is None else done.unionByName(over)
        left = now.where(~closed)
    return done


def _scored_options(reqs: DataFrame, adapter: Adapter, batch_size: int) -> DataFrame:
    """(request_id, pred_index, error, raw_output) by the logit path; a prompt that still ends inside a think block raises."""
    require_none(reqs.where(open_think("prompt_text")).select("request_id"), "open think block")
    found = infer_options(reqs, adapter, batch_size)
    pred = argmax_option("logits")
    return found.select("request_id", pred.alias("pred_index"), F.when(pred.isNull(), F.coalesce("error_detail", F.lit("logit_inference_failed"))).alias("error"), F.coalesce(F.concat(F.lit("logit:"), pred.cast("string")), F.lit("")).alias("raw_output"))


def legacy_records(
    items: DataFrame, adapter: Adapter, conditions: list[str], way: str = "batch", concepts: list[str] | None = None, files: DataFrame | None = None,
    template: Callable[[Column], Column] = lambda prompt: prompt, rounds: int = 2, batch_size: int = 64,
) -> DataFrame:
    """RECORD for each item and condition, by one of PATHS. ``template``: the adapter's chat template, as a column expression of the prompt."""
    if way not in PATHS:
        raise ValueError(f"unknown way {way!r}; known: {', '.join(PATHS)}")
    rows = conditioned(items, conditions, concepts, files)
    rows = staged(spread(rows, "request_id") if files is None else rows, "legacy-requests")  # the join with files has dealt them
    asked = rows.where(~F.col("missing"))
    if way in ("batch", "single"):
        said = infer(asked.withColumn("prompt_text", template(F.col("prompt_text"))), adapter, 1 if way == "single" else batch_size)
        pred = F.when(F.col("error_status").isNull(), legacy_digit("raw_output"))
        error = F.coalesce("error_detail", F.when(pred.isNull(), "no_digit_0_3_found"))
        answers = said.select("request_id", pred.alias("pred_index"), error.alias("error"), F.coalesce("raw_output", F.lit("")).alias("raw_output"))
    elif way == "logit":
        answers = _scored_options(asked.withColumn("prompt_text", answer_prompt(template(F.col("prompt_text")))), adapter, batch_size)
    else:
        thought = staged(thoughts(asked.withColumn("prompt_text", template(F.col("prompt_text"))), adapter, rounds, batch_size), "legacy-thoughts")
        ready = matched(asked, thought.where("think_error is null"), "request_id").withColumn("prompt_text", F.concat(template(F.col("prompt_text")), "thought"))
        answers = _scored_options(ready, adapter, batch_size).withColumn("raw_output", F.regexp_replace("raw_output", "^logit:", "logit_thinking:"))
        lost = thought.where("think_error is not null").select("request_id", F.lit(None).cast("int").alias("pred_index"), F.col("think_error").alias("error"), F.lit("").alias("raw_output"))
        answers = answers.unionByName(lost)
    out = matched(rows, staged(answers, "legacy-answers"), "request_id", "left")
    records = out.select(
        F.col("item_id").alias("id"), "split", "condition", F.col("answer_index").alias("gt_index"), "pred_index", F.coalesce(F.col("pred_index") == F.col("answer_index"), F.lit(False)).alias("is_correct"),
        F.col("pred_index").isNull().alias("is_invalid"), F.when(F.col("missing"), F.concat(F.lit("image_not_found: "), "image")).otherwise(F.col("error")).alias("error"),
        F.coalesce("raw_output", F.lit("")).alias("raw_output"), F.col("concept_name").alias("meta_synset"),
    )
    names = [c for c in conditions if c.startswith("ORACLE_")]
    again = records.where((F.col("condition") == "BASELINE_NORMAL") & ~F.col("split").endswith("_forget")).drop("condition")
    return records.unionByName(again.withColumn("condition", F.explode(F.array(*map(F.lit, names)))).select(*RECORD)) if names else records
