"""Response accounting, leakage and legacy accuracy metrics: map-side aggregates, each one shuffle on its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeforge.functions.text import rate
from probeforge.schema import SCORABLE, STATUSES


def status_columns(status: str = "response_status") -> list[Column]:
    """Counts of all statuses and the rates over them; rates are null on an empty denominator."""
    n = lambda *of: F.count_if(F.col(status).isin(*of))
    attempted, scorable = F.count(F.lit(1)), n(*SCORABLE)
    return [
        attempted.alias("attempted"), scorable.alias("scorable"), *(n(s).alias(f"n_{s}") for s in STATUSES),
        rate(n("correct"), attempted).alias("access_rate"), rate(n("correct"), scorable).alias("conditional_accuracy"), rate(scorable, attempted).alias("coverage"),
        rate(n("refusal"), attempted).alias("refusal_rate"), rate(n("invalid_format"), attempted).alias("invalid_rate"),
        rate(n("policy_block"), attempted).alias("policy_rate"), rate(n("api_error", "model_error"), attempted).alias("error_rate"),
    ]


def response_accounting(df: DataFrame, keys: list[str] = [], status: str = "response_status") -> DataFrame:
    """One row for each group of ``keys`` (one row in all without keys)."""
    return df.groupBy(*keys).agg(*status_columns(status))


def accounting_sets(df: DataFrame, sets: list[list[str]], status: str = "response_status") -> DataFrame:
    """Accounting at several grouping levels over one pass; ``level`` is the grouping id."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().cast("bigint").alias("level"), *status_columns(status))


def failures(df: DataFrame, status: str = "response_status") -> DataFrame:
    return df.where(~F.col(status).isin(*SCORABLE))


def failure_counts(df: DataFrame, status: str = "response_status") -> DataFrame:
    return failures(df, status).groupBy(F.col(status)).agg(F.count("*").alias("n"))


def sample_outcomes(df: DataFrame, keys: list[str] = [], sample: str = "sample_id", status: str = "response_status", cost: str = "attack_unit_cost") -> DataFrame:
    """leaked, contained or unscorable for each sample, with its spent cost and requests; a request without sample or cost is an error."""
    spent = F.col(cost).cast("bigint")
    checked = F.when(F.col(sample).isNull() | spent.isNull(), F.raise_error(F.lit(f"{sample} or {cost} is missing")).cast("bigint")).otherwise(spent)
    one = lambda s: F.bool_or(F.col(status) == s)
    outcome = F.when(one("correct"), "leaked").when(one("incorrect"), "contained").otherwise("unscorable")
    return df.groupBy(*keys, sample).agg(outcome.alias("outcome"), F.sum(checked).alias("cost"), F.count("*").alias("requests"))


def worst_case_leakage(df: DataFrame, keys: list[str] = [], **columns: str) -> DataFrame:
    """Share of evaluable samples that any attack leaked; null where none is evaluable."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    evaluable = n("leaked") + n("contained")
    return sample_outcomes(df, keys, **columns).groupBy(*keys).agg(
        F.count("*").alias("samples"), n("leaked").alias("leaked"), n("contained").alias("contained"), n("unscorable").alias("unscorable"),
        rate(n("leaked"), evaluable).alias("wcl"), rate(evaluable, F.count("*")).alias("scorable_sample_coverage"),
        F.sum("requests").alias("attack_requests"), F.sum("cost").alias("attack_budget_spent"),
    )


def within_budget(df: DataFrame, budget: int, order: list[str], sample: str = "sample_id", cost: str = "attack_unit_cost") -> DataFrame:
    """The attacks of each sample whose running cost stays within ``budget``; ``order`` must be unique in a sample."""
    spent = F.sum(cost).over(Window.partitionBy(sample).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running_cost", spent).where(F.col("running_cost") <= budget)


def accuracy(df: DataFrame, keys: list[str], class_col: str = "meta_synset", gt: str = "gt_index", pred: str = "pred_index") -> DataFrame:
    """Macro (mean of class accuracies), micro accuracy and invalid rate; nulls count as invalid."""
    right, invalid = F.coalesce(F.col(gt) == F.col(pred), F.lit(False)), F.col(pred).isNull()
    by_class = df.groupBy(*keys, class_col).agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(invalid).alias("invalid"))
    n = F.sum("n")
    return by_class.groupBy(*keys).agg(
        n.alias("n"), F.avg(rate(F.col("right"), F.col("n"))).alias("macro_accuracy"),
        F.coalesce(rate(F.sum("right"), n), F.lit(0.0)).alias("micro_accuracy"), F.coalesce(rate(F.sum("invalid"), n), F.lit(0.0)).alias("invalid_rate"),
    )


#: Suffixes of the legacy metric document's keys, by figure, for the forget and the retain split; and its aliases.
LEGACY_FORGET = {"macro_accuracy": "__forget_macro_acc", "micro_accuracy": "__forget_micro_acc", "classes": "__forget_K", "invalid_rate": "__invalid_rate_forget", "n": "__forget_total", "entropy": "__forget_pred_entropy"}
LEGACY_RETAIN = {"micro_accuracy": "__retain_acc", "macro_accuracy": "__retain_macro_acc", "invalid_rate": "__invalid_rate_retain", "n": "__retain_total"}
LEGACY_ALIASES = {
    "baseline_normal__forget_macro_acc": "baseline_forget_macro_acc", "baseline_normal__retain_acc": "baseline_retain_acc",
    "oracle_hard__forget_macro_acc": "oracle_hard_forget_macro_acc", "oracle_hard__retain_acc": "oracle_hard_retain_acc",
}


def legacy_metrics(df: DataFrame, class_col: str = "meta_synset") -> DataFrame:
    """(key, value) of the legacy metric document: a row for each figure of each condition on the test splits, and its aliases."""
    keys = ["split", "condition"]
    test = df.where(F.col("split").isin("test_forget", "test_retain"))
    kinds = test.groupBy(*keys).agg(F.count_distinct(class_col).alias("classes"))
    rows = accuracy(test, keys, class_col).join(kinds, keys).join(prediction_entropy(test, keys).select(*keys, F.round("entropy", 4).alias("entropy")), keys, "left")
    entries = lambda names: F.array(*(F.struct(F.concat(F.lower("condition"), F.lit(k)).alias("key"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c, k in names.items()))
    rows = rows.select(F.inline(F.when(F.col("split") == "test_forget", entries(LEGACY_FORGET)).otherwise(entries(LEGACY_RETAIN))))
    named = F.element_at(F.create_map(*(F.lit(x) for kv in LEGACY_ALIASES.items() for x in kv)), F.col("key"))
    both = F.filter(F.array("key", F.when(F.col("key").isin(*LEGACY_ALIASES), named)), lambda k: k.isNotNull())
    return rows.select(F.explode(both).alias("key"), "value")


def legacy_class_metrics(df: DataFrame, class_col: str = "meta_synset", gt: str = "gt_index", pred: str = "pred_index") -> DataFrame:
    """(condition, class, accuracy, total) on the forget split: the document's figures by class."""
    right = F.coalesce(F.col(gt) == F.col(pred), F.lit(False))
    return df.where("split = 'test_forget'").groupBy("condition", F.col(class_col).alias("class")).agg(rate(F.count_if(right), F.count("*")).alias("accuracy"), F.count("*").alias("total"))


def legacy_metric_document(df: DataFrame, forget_classes: list[str], model_name: str | None = None, thinking_mode: str = "disabled") -> dict:
    """The document of one run: as many figures as conditions and forget classes, whatever the responses."""
    doc: dict = {"forget_classes": forget_classes, "K": len(forget_classes), "thinking_mode": thinking_mode}
    if model_name is not None:
        doc["model_name"] = model_name
    doc |= {r["key"]: r["value"] for r in legacy_metrics(df).collect()}
    for r in legacy_class_metrics(df).collect():
        for name, value in (("acc", r["accuracy"]), ("total", r["total"])):
            doc.setdefault(f"{r['condition'].lower()}__forget_per_class_{name}", {})[r["class"]] = value
    return dict.fromkeys(("baseline_forget_macro_acc", "baseline_retain_acc")) | doc


def hardest_classes(df: DataFrame, n: int = 5, class_col: str = "meta_synset", gt: str = "gt_index", pred: str = "pred_index") -> DataFrame:
    right = F.coalesce(F.col(gt) == F.col(pred), F.lit(False))
    return df.groupBy(class_col).agg(rate(F.count_if(right), F.count("*")).alias("accuracy")).orderBy("accuracy", class_col).limit(n)


def prediction_entropy(df: DataFrame, keys: list[str], pred: str = "pred_index", options: int = 4) -> DataFrame:
    """Histogram of valid predictions and its Shannon entropy in bits."""
    valid = df.where(F.col(pred).between(0, options - 1))
    counts = valid.groupBy(*keys).agg(*(F.count_if(F.col(pred) == i).alias(f"n{i}") for i in range(options)), F.count("*").alias("n_valid"))
    bits = [F.when(F.col(f"n{i}") > 0, -rate(F.col(f"n{i}"), F.col("n_valid")) * F.log2(rate(F.col(f"n{i}"), F.col("n_valid")))).otherwise(0.0) for i in range(options)]
    return counts.withColumn("entropy", sum(bits[1:], bits[0]))


def summary_pivot(df: DataFrame, conditions: list[str], key: str = "split", metric: str = "micro_accuracy") -> DataFrame:
    """One row a key, one column a condition."""
    return df.groupBy(key).pivot("condition", conditions).agg(F.first(metric))


def split_stats(df: DataFrame, class_col: str, top: int = 10) -> DataFrame:
    """The most frequent classes; ties by name."""
    return df.groupBy(class_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), class_col).limit(top)


def general_utility(m0: DataFrame, mu: DataFrame, suite: str = "suite", status: str = "response_status") -> DataFrame:
    """Utility retention: access after over access before, by suite."""
    before = response_accounting(m0, [suite], status).select(suite, F.col("access_rate").alias("before"))
    after = response_accounting(mu, [suite], status).select(suite, F.col("access_rate").alias("after"))
    return before.join(after, suite, "full").withColumn("retention", F.try_divide("after", "before"))


def run_costs(manifests: DataFrame, keys: list[str]) -> DataFrame:
    """Cost totals of runs: wall_seconds, gpu_hours and the mean latency."""
    return manifests.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum("wall_seconds").alias("wall_seconds"), F.sum("gpu_hours").alias("gpu_hours"), F.avg("inference_latency_ms").alias("mean_latency_ms"))
