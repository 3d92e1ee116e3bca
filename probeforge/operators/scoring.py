"""Scorers of raw outputs as columns: status, prediction, scorer and how it matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeforge.functions.text import argmax_option, norm_text, option_digit, refusal_match, squeeze, strip_marks


def _result(status: Column, prediction: Column, scorer: str, mode: Column) -> Column:
    return F.struct(status.alias("response_status"), prediction.cast("string").alias("prediction"), F.lit(scorer).alias("scorer_id"), F.lit("1.0.0").alias("scorer_version"), mode.alias("match_mode"))


def score_mcq(raw: str, choices: str, answer: str) -> Column:
    """An option's digit, else its exact text, else a refusal, else invalid format."""
    cs = F.col(choices)
    digit = option_digit(raw, F.size(cs))
    at = F.array_position(F.transform(cs, norm_text), norm_text(strip_marks(raw)))
    plain = F.array_position(F.transform(cs, norm_text), norm_text(raw))
    text = F.when(plain > 0, plain - 1).when(at > 0, at - 1)
    prediction = F.coalesce(digit, text.cast("int"))
    status = F.when(prediction.isNotNull(), F.when(prediction == F.col(answer), "correct").otherwise("incorrect")).when(refusal_match(raw).isNotNull(), "refusal").otherwise("invalid_format")
    mode = F.when(digit.isNotNull(), "digit").when(text.isNotNull(), "option_text").when(refusal_match(raw).isNotNull(), "refusal").otherwise("none")
    return _result(status, prediction, "mcq_parse", mode)


def score_short_answer(raw: str, accepted: str) -> Column:
    """An accepted answer or alias, else a refusal, else incorrect; empty output is invalid format."""
    text = squeeze(raw)
    bare = strip_marks(raw)
    hit = F.exists(F.col(accepted), lambda a: norm_text(a) == norm_text(bare))
    exact = F.exists(F.col(accepted), lambda a: a == bare)
    status = F.when(text == "", "invalid_format").when(hit, "correct").when(refusal_match(raw).isNotNull(), "refusal").otherwise("incorrect")
    mode = F.when(text == "", "none").when(exact, "exact").when(hit, "alias").when(refusal_match(raw).isNotNull(), "refusal").otherwise("none")
    return _result(status, F.when(text != "", bare), "short_answer_alias", mode)


def score_logits(logits: str, answer: str) -> Column:
    """The first largest option; without logits a model error."""
    best = argmax_option(logits)
    status = F.when(best.isNull() | (F.size(F.col(logits)) <= 0), "model_error").when(best == F.col(answer), "correct").otherwise("incorrect")
    return _result(status, best, "logit_argmax", F.lit("logit"))


def score_responses(df: DataFrame, raw: str = "raw_output", error: str = "error_status") -> DataFrame:
    """Responses with their items' columns, each by its format; error statuses pass through."""
    scored = F.when(F.col(error).isNotNull(), _result(F.col(error), F.lit(None), "none", F.lit("error"))).when(F.col("question_format") == "mcq", score_mcq(raw, "choices", "answer_index")).otherwise(score_short_answer(raw, "accepted_answers"))
    return df.withColumn("score", scored).select("*", "score.*").drop("score")
