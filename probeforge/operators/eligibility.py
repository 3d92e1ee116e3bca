"""Concept eligibility: gates over each (concept, format) cell, the manifest and its summary."""

from __future__ import annotations

from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeforge.functions.text import rate
from probeforge.operators.statistics import bootstrap_ci
from probeforge.schema import CONTROLS, VERSION, ConstraintError, Thresholds, require_none
from probeforge.sources.writers import staged


def choice_count_violations(df: DataFrame) -> DataFrame:
    """MCQ concepts with normal-image records whose choice_count is not one and the same."""
    mcq = df.where("question_format = 'mcq'")
    per = mcq.groupBy("concept_id").agg(F.count_distinct("choice_count").alias("n_counts"), F.count_if(F.col("input_condition") == "normal_image").alias("n_normal"))
    return per.where("n_normal > 0 and n_counts <> 1").select(F.lit("choice_count").alias("rule"), "concept_id", "n_counts")


def evaluate_cells(df: DataFrame, t: Thresholds = Thresholds(), formats: tuple[str, ...] = ("mcq", "short_answer"), with_ci: bool = True, seed: int = 0) -> DataFrame:
    """One row for each concept and required format, with its figures and failure codes in order.

    A format without any record of a concept still has its row. The interval's seed is by concept, so
    adding a concept changes no other's interval.
    """
    right = F.col("response_status") == "correct"
    cond = lambda c: F.col("input_condition") == c
    access = lambda c: rate(F.count_if(cond(c) & right), F.count_if(cond(c)))
    cells = df.groupBy("concept_id", "question_format").agg(
        F.count_if(cond("normal_image")).alias("n_normal"), access("normal_image").alias("normal_access"), *(access(c).alias(f"{c}_access") for c in CONTROLS), (1.0 / F.max("choice_count")).alias("chance_floor")
    )
    variants = df.where(cond("normal_image")).groupBy("concept_id", "question_format", "prompt_variant_id").agg(rate(F.count_if(right), F.count("*")).alias("a"))
    variants = variants.groupBy("concept_id", "question_format").agg(F.min("a").alias("variant_min"), F.max("a").alias("variant_max"))
    wanted = df.select("concept_id").distinct().withColumn("question_format", F.explode(F.array(*map(F.lit, formats))))
    out = wanted.join(cells, ["concept_id", "question_format"], "left").join(variants, ["concept_id", "question_format"], "left")
    if with_ci:
        normal = df.where(cond("normal_image") & (F.col("question_format") == "mcq")).select("concept_id", "question_format", right.cast("double").alias("x"))
        ci = bootstrap_ci(normal, ["concept_id", "question_format"], "x", t.replicates, t.alpha, seed).select("concept_id", "question_format", F.col("low").alias("ci_low"), F.col("high").alias("ci_high"))
        out = out.join(ci, ["concept_id", "question_format"], "left")
    else:
        out = out.withColumns({"ci_low": F.lit(None).cast("double"), "ci_high": F.lit(None).cast("double")})
    n, normal, mcq = F.coalesce("n_normal", F.lit(0)), F.col("normal_access"), F.col("question_format") == "mcq"
    controls = [F.col(f"{c}_access") for c in CONTROLS]
    missing = F.lit(False)
    for c in controls:
        missing = missing | c.isNull()
    gap = F.when(~missing, normal - F.greatest(*controls))
    tau = F.when(mcq, t.tau_acc_mcq).otherwise(t.tau_acc_short)
    some = n > 0
    spread = (F.col("variant_min") < t.variant_min) | (F.col("variant_max") - F.col("variant_min") > t.variant_spread)
    codes = F.array_compact(
        F.array(
            F.when(n < t.n_min, F.lit("INSUFFICIENT_SAMPLES")), F.when(some & (normal < tau), F.lit("LOW_NORMAL_ACCESS")), F.when(some & missing, F.lit("MISSING_CONTROL")),
            F.when(some & (gap < t.tau_visual), F.lit("LOW_VISUAL_GAP")), F.when(some & mcq & (F.col("ci_low") <= F.col("chance_floor")), F.lit("CI_BELOW_FLOOR")), F.when(some & mcq & spread, F.lit("VARIANT_INSTABILITY")),
        )
    )
    return out.select("concept_id", "question_format", n.alias("n_normal"), normal, *controls, gap.alias("visual_gap"), F.when(mcq, F.col("chance_floor")).alias("chance_floor"), "ci_low", "ci_high", "variant_min", "variant_max", codes.alias("codes"))


def manifest(cells: DataFrame) -> DataFrame:
    """concept_id, eligible and its codes with their format before them."""
    coded = F.transform("codes", lambda c: F.concat("question_format", F.lit(":"), c))
    return cells.groupBy("concept_id").agg(F.bool_and(F.size("codes") == 0).alias("eligible"), F.array_sort(F.flatten(F.collect_list(coded))).alias("codes"))


def build_manifest(df: DataFrame, t: Thresholds = Thresholds(), formats: tuple[str, ...] = ("mcq", "short_answer"), seed: int = 0) -> DataFrame:
    require_none(choice_count_violations(df), "eligibility")
    return manifest(evaluate_cells(df, t, formats, True, seed))


#: What the context of an eligibility manifest must state.
CONTEXT_KEYS = ("model_id", "model_revision", "processor_revision", "benchmark_version", "probe_bank_hash", "prompt_bank_hash", "scorer_versions", "data_hashes", "code_git_sha")


def manifest_document(df: DataFrame, context: dict, t: Thresholds = Thresholds(), formats: tuple[str, ...] = ("mcq", "short_answer"), seed: int = 0, with_ci: bool = True) -> tuple[dict, DataFrame]:
    """(the manifest's head: context, thresholds, counts and coverage; its concepts, a row each)."""
    missing = sorted(set(CONTEXT_KEYS) - set(context))
    if missing:
        raise ConstraintError("eligibility context", [f"missing {k}" for k in missing])
    require_none(choice_count_violations(df), "eligibility")
    concepts = staged(manifest(evaluate_cells(df, t, formats, with_ci, seed)), "eligibility")
    n = concepts.agg(F.count("*").alias("candidates"), F.count_if("eligible").alias("eligible")).first()
    if not n["candidates"]:
        raise ConstraintError("eligibility", ["no baseline records"])
    head = {
        "schema_version": VERSION, "kind": "eligibility_manifest", "created_at": datetime.now(UTC).isoformat(), "context": dict(context), "thresholds": asdict(t), "seed": seed, "required_formats": list(formats),
        "candidate_count": n["candidates"], "eligible_count": n["eligible"], "coverage": n["eligible"] / n["candidates"],
    }
    return head, concepts


def code_counts(cells: DataFrame) -> DataFrame:
    return cells.select("question_format", F.explode("codes").alias("code")).groupBy("question_format", "code").agg(F.count("*").alias("n"))


def eligible_only(df: DataFrame, manifest_: DataFrame) -> DataFrame:
    """Records of eligible concepts."""
    return df.join(manifest_.where("eligible").select("concept_id"), "concept_id", "left_semi")
