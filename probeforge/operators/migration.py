"""Legacy records (schema.LEGACY) moved to items (schema.ITEM): one projection, no shuffle.

A record that cannot be moved keeps its row: ``error`` names the first rule it breaks, or the rules its item
breaks, and the item columns are of no use. A null field counts as missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeforge.functions.text import order_hash, slug, squeeze, stable_id
from probeforge.operators.quality import item_errors
from probeforge.schema import ITEM, VERSION

REQUIRED = ("id", "image", "question", "choices", "answer_index", "forgetting_level", "concept_axis", "meta")


@dataclass(frozen=True)
class Context:
    """What legacy records do not say themselves."""

    dataset_id: str
    source_version: str
    split: str
    license_id: str
    redistribution: str
    provenance_note: str
    probe_id: str = "legacy.mcq.identity.v1"
    prompt_variant_id: str = "legacy_default"


def _some(x: Column) -> Column:
    """The text, or null if it is blank."""
    return F.when(squeeze(x) != "", x)


def migrate(records: DataFrame, context: Context) -> DataFrame:
    """The columns of schema.ITEM, then legacy_id, name_fallback (the concept's name is not the stated one) and error.

    Columns of ``records`` outside schema.LEGACY are kept.
    """
    r = lambda name: F.col(f"_r.{name}")
    extra = [c for c in records.columns if c not in (*REQUIRED, "target_split")]
    rows = records.select(F.struct(*REQUIRED, "target_split").alias("_r"), *extra)
    stated, other = _some(r("meta")["forget_concept"]), _some(F.coalesce(F.nullif(r("meta")["class_name"], F.lit("")), r("meta")["synset"]))
    absent = F.array_compact(F.array(*(F.when(r(k).isNull(), F.lit(k)) for k in sorted(REQUIRED))))
    valid_at = (r("answer_index") >= 0) & (r("answer_index") < F.size(r("choices")))
    rows = rows.withColumns({"_name": F.coalesce(stated, other), "_answer": F.when(valid_at, F.try_element_at(r("choices"), r("answer_index") + 1)), "name_fallback": stated.isNull()})
    rows = rows.withColumn(
        "_broken",
        F.when(F.size(absent) > 0, F.concat(F.lit("missing required fields: "), F.array_join(absent, ", ")))
        .when(~F.coalesce(r("target_split"), F.lit("all")).isin("all", context.split), "target_split conflicts with the split")
        .when(~valid_at, "no valid answer").when(_some(F.col("_answer")).isNull(), "empty answer").when(F.col("_name").isNull(), "no concept name").when(_some(r("image")).isNull(), "empty image"),
    )
    given, sample, options = (lambda x: F.lit(x)), r("id").cast("string"), order_hash(r("choices"))
    probe, variant = given(context.probe_id), given(context.prompt_variant_id)
    text, texts = (lambda x: F.lit(x).cast("string")), F.array().cast("array<string>")
    made = {
        "schema_version": text(VERSION), "item_id": stable_id("item", sample, probe, variant, given("normal_image"), options), "sample_id": sample, "dataset_id": text(context.dataset_id),
        "image_id": stable_id("image", given(context.dataset_id), r("image")), "image": r("image"), "concept_id": F.concat(given(context.dataset_id + ":"), slug(F.col("_name"))), "concept_name": F.col("_name"),
        "concept_aliases": texts, "forgetting_level": r("forgetting_level"), "concept_axis": r("concept_axis"), "split": text(context.split), "probe_id": probe, "probe_family": text("P1_DIRECT"),
        "question_format": text("mcq"), "prompt_variant_id": variant, "input_condition": text("normal_image"), "question": r("question"), "choices": r("choices"), "accepted_answers": F.array("_answer"),
        "answer_index": r("answer_index"), "matched_retain_id": text(None), "source": F.create_map(given("dataset_id"), given(context.dataset_id), given("record_id"), sample, given("version"), given(context.source_version)),
        "license": F.create_map(given("id"), given(context.license_id), given("redistribution"), given(context.redistribution)), "provenance_note": text(context.provenance_note),
        "metadata": F.create_map(
            given("pairing_id"), stable_id("pair", sample, probe, variant, options), given("option_order_hash"), options, given("legacy_meta"), F.to_json(r("meta")),
            given("source_schema"), given("legacy_dataset_item"), given("target_split_original"), r("target_split"),
        ),
    }
    out = rows.select(*(made[f.name].alias(f.name) for f in ITEM.fields), sample.alias("legacy_id"), "name_fallback", "_broken", *extra)
    return out.withColumn("error", F.coalesce(F.col("_broken"), F.nullif(F.array_join(item_errors(), "; "), F.lit("")))).drop("_broken")


def migrated_items(moved: DataFrame) -> DataFrame:
    """The valid items among the rows of ``migrate``."""
    return moved.where("error is null").select(*(f.name for f in ITEM.fields))


def rejections(moved: DataFrame) -> DataFrame:
    return moved.where("error is not null").select("legacy_id", "error")


def migration_report(moved: DataFrame) -> DataFrame:
    """One row of counts; the fallbacks count records that were moved."""
    fine = F.col("error").isNull()
    return moved.agg(F.count("*").alias("input_count"), F.count_if(fine).alias("migrated_count"), F.count_if(~fine).alias("rejected_count"), F.count_if(fine & F.col("name_fallback")).alias("concept_name_from_class_or_synset"))
