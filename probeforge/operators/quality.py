"""Quality control and constraints. Each rule yields violation rows; ``schema.require_none`` makes them raise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeforge.functions.text import norm_text, squeeze
from probeforge.schema import BALANCE_BLOCK, CAPABILITIES, CONDITIONS, FORMATS, PROBE_FAMILIES, SPLITS, STATUSES, VERSION

#: Fixed values of choice checks.
FORBIDDEN = ("n0", "/", "_")
MAX_CHOICE_CHARS = 40


def _reasons(*pairs: tuple[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in pairs))))


def _blank(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x.isNull() | (squeeze(x) == "")


def choice_reasons(choices: str = "choices", answer: str = "answer_index", class_name: str = "class_name") -> Column:
    """Sorted reasons to reject a four-choice item."""
    cs, n = F.col(choices), F.size(choices)
    low = F.transform(cs, norm_text)
    bad = lambda test: F.exists(cs, test)
    return _reasons(
        ("invalid_choice_count", n != 4), ("duplicate_choices_case_insensitive", F.size(F.array_distinct(low)) != n),
        ("invalid_answer_index", (F.col(answer) < 0) | (F.col(answer) >= n)), ("correct_answer_not_in_choices", ~F.array_contains(low, F.coalesce(norm_text(class_name), F.lit("")))),
        ("choice_not_string", bad(lambda c: c.isNull())), ("empty_choice", bad(lambda c: squeeze(c) == "")), ("choice_too_long", bad(lambda c: F.length(c) > MAX_CHOICE_CHARS)),
        ("choice_contains_forbidden_token", bad(lambda c: F.lower(c).contains(FORBIDDEN[0]) | F.lower(c).contains(FORBIDDEN[1]) | F.lower(c).contains(FORBIDDEN[2]))),
    )


def prebuilt_reasons(choices: str = "choices", answer: str = "answer_index") -> Column:
    """Sorted reasons to reject an item that came with its own options."""
    cs, n = F.col(choices), F.size(choices)
    return _reasons(
        ("too_few_choices", n < 2), ("duplicate_choices_case_insensitive", F.size(F.array_distinct(F.transform(cs, norm_text))) != n),
        ("invalid_answer_index", (F.col(answer) < 0) | (F.col(answer) >= n)), ("choice_not_string", F.exists(cs, lambda c: c.isNull())), ("empty_choice", F.exists(cs, lambda c: squeeze(c) == "")),
    )


def with_duplicates(df: DataFrame, reasons: str = "reasons", key: str = "id", seq: str = "seq") -> DataFrame:
    """Adds duplicate_id to rows after the first passing row of their id; rows that fail otherwise set no id."""
    first = F.min(F.when(F.size(reasons) == 0, F.col(seq))).over(Window.partitionBy(key))
    return df.withColumn(reasons, F.when(F.col(seq) > first, F.array_sort(F.concat(reasons, F.array(F.lit("duplicate_id"))))).otherwise(F.col(reasons)))


def reject_counts(df: DataFrame, reasons: str = "reasons", top: int = 5) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)


def pool_stats(df: DataFrame, reasons: str = "reasons", cls: str = "wnid", concept: str = "class_name") -> DataFrame:
    """Counts of a build; classes over all rows, concepts over accepted ones."""
    fine = F.size(reasons) == 0
    return df.agg(
        F.count("*").alias("processed"), F.count_if(fine).alias("accepted"), F.count_if(~fine).alias("rejected"), F.count_distinct(cls).alias("classes"),
        F.count_distinct(F.when(fine, F.col(concept))).alias("concepts"), F.try_divide(F.count_if(~fine).cast("double"), F.count("*").cast("double")).alias("reject_rate"),
    )


def key_violations(raw: Column, expected: tuple[str, ...]) -> Column:
    """``missing:k`` and ``unknown:k`` of a JSON object's text against its expected keys."""
    want, have = F.array(*map(F.lit, expected)), F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.concat(F.transform(F.array_except(want, have), lambda k: F.concat(F.lit("missing:"), k)), F.transform(F.array_except(have, want), lambda k: F.concat(F.lit("unknown:"), k)))


def item_errors() -> Column:
    """Errors of one item row (schema.ITEM), empty if it is valid."""
    c = F.col
    unique = lambda xs: F.size(F.array_distinct(F.transform(xs, norm_text))) == F.size(xs)
    mcq, short, matching, cond = c("question_format") == "mcq", c("question_format") == "short_answer", c("question_format") == "matching", c("input_condition")
    n = F.coalesce(F.size("choices"), F.lit(0))
    blanks = F.coalesce(F.exists("choices", _blank), F.lit(False))
    in_range = F.coalesce((c("answer_index") >= 0) & (c("answer_index") < n), F.lit(False))
    blind = cond.isin("no_image", "option_only", "question_only")
    answer = F.when(in_range, norm_text(F.try_element_at("choices", c("answer_index") + 1)))
    donor = c("metadata")["donor_image_id"]
    rules = [
        ("schema_version", ~c("schema_version").eqNullSafe(F.lit(VERSION))),
        *((f"{f} must be non-empty", _blank(f)) for f in ("item_id", "sample_id", "dataset_id", "image_id", "concept_id", "concept_name", "forgetting_level", "concept_axis", "probe_id", "prompt_variant_id", "provenance_note")),
        *((f"{f} is no known value", ~F.coalesce(c(f).isin(*v), F.lit(False))) for f, v in (("split", SPLITS), ("probe_family", PROBE_FAMILIES), ("question_format", FORMATS), ("input_condition", CONDITIONS))),
        ("concept_aliases must be strings", c("concept_aliases").isNull() | F.exists("concept_aliases", _blank)), ("accepted_answers must be non-empty strings", c("accepted_answers").isNull() | (F.size("accepted_answers") < 1) | F.exists("accepted_answers", _blank)),
        ("question must be empty for option_only", (cond == "option_only") & ~_blank("question")), ("question must be non-empty", (cond != "option_only") & _blank("question")),
        ("image must be null", blind & c("image").isNotNull()), ("image must be non-empty", ~blind & _blank("image")),
        ("donor_image_id is required", (cond == "shuffled_image") & _blank(donor)), ("donor must differ", (cond == "shuffled_image") & (donor == c("image_id"))),
        ("mcq needs two choices", mcq & (n < 2)), ("choices must be non-empty", mcq & (n >= 2) & blanks), ("choices must be unique", mcq & (n >= 2) & ~blanks & ~unique(c("choices"))), ("answer_index out of range", mcq & (n >= 2) & ~blanks & ~in_range),
        ("accepted_answers must include the answer", mcq & in_range & ~F.array_contains(F.transform("accepted_answers", norm_text), answer)),
        ("short_answer has choices", short & c("choices").isNotNull()), ("short_answer has answer_index", short & c("answer_index").isNotNull()),
        ("matching without choices has answer_index", matching & c("choices").isNull() & c("answer_index").isNotNull()), ("matching choices", matching & c("choices").isNotNull() & ((n < 2) | blanks)), ("matching answer_index", matching & c("choices").isNotNull() & (n >= 2) & ~blanks & ~in_range),
        ("accepted_answers must be unique", ~unique(c("accepted_answers"))), ("matched_retain_id must be null or non-empty", c("matched_retain_id").isNotNull() & _blank("matched_retain_id")),
        *((f"{m}.{k} must be non-empty", _blank(c(m)[k])) for m, k in (("source", "dataset_id"), ("source", "record_id"), ("source", "version"), ("license", "id"), ("license", "redistribution"), ("metadata", "pairing_id"))),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(r)) for r, x in rules)))


def probe_errors() -> Column:
    """Errors of a probe spec row."""
    p3 = F.col("family") == "P3_ADVERSARIAL"
    return _reasons(("unknown family", ~F.col("family").isin(*PROBE_FAMILIES)), ("attack_family is required", p3 & _blank("attack_family")), ("attack_unit_cost under 1", p3 & (F.col("attack_unit_cost") < 1)), ("negative cost", F.col("attack_unit_cost") < 0))


def method_errors() -> Column:
    """Errors of a method spec row."""
    unknown = F.exists("required_capabilities", lambda k: ~k.isin(*CAPABILITIES))
    return _reasons(("unknown capability", unknown), ("white-box method must modify state", (F.col("access_regime") == "R2_WHITE_BOX") & ~F.col("modifies_model_state")), ("no_op must not modify state", (F.col("semantic_label") == "no_op") & F.col("modifies_model_state")))


def dataset_violations(items: DataFrame, balance: bool = True, core_controls: bool = False) -> DataFrame:
    """(rule, key) of all violations across rows."""
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), key.cast("string").alias("key"))
    out = rule(items.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate item_id", F.col("item_id"))
    fixed = items.groupBy("sample_id").agg(F.count_distinct(F.struct("dataset_id", "image_id", "concept_id", "split")).alias("n")).where("n > 1")
    out = out.unionByName(rule(fixed, "sample changes identity", F.col("sample_id")))
    for name, key, side in (("sample in train and test", "sample_id", F.split_part("split", F.lit("_"), F.lit(1))), ("image in train and test", "image_id", F.split_part("split", F.lit("_"), F.lit(1))), ("concept in forget and retain", "concept_id", F.split_part("split", F.lit("_"), F.lit(2)))):
        both = items.where(F.col("split").rlike("^(train|test)_")).groupBy(key).agg(F.count_distinct(side).alias("n")).where("n > 1")
        out = out.unionByName(rule(both, name, F.col(key)))
    if balance:
        out = out.unionByName(rule(imbalance(items), "answer positions unbalanced", F.concat_ws("|", *BALANCE_BLOCK)))
    if core_controls:
        out = out.unionByName(rule(missing_controls(items), "controls missing", F.concat_ws(":", "pairing_id", F.array_join("missing", ","))))
    return out


def imbalance(items: DataFrame, block: list[str] = list(BALANCE_BLOCK)) -> DataFrame:
    """Blocks of MCQ items whose answer positions, unused ones included, differ by more than one."""
    counts = items.where("question_format = 'mcq'").withColumn("n_choices", F.size("choices")).groupBy(*block, "n_choices", "answer_index").agg(F.count("*").alias("n"))
    spread = counts.groupBy(*block, "n_choices").agg(F.max("n").alias("most"), F.when(F.count("*") < F.first("n_choices"), F.lit(0)).otherwise(F.min("n")).alias("least"))
    return spread.where("most - least > 1")


def option_positions(items: DataFrame, block: list[str] = list(BALANCE_BLOCK)) -> DataFrame:
    """(block, n_choices, items, positions: how many answers stand at each option, spread) of MCQ items."""
    counts = items.where("question_format = 'mcq'").groupBy(*block, F.size("choices").alias("n_choices"), "answer_index").agg(F.count("*").alias("n"))
    by = counts.groupBy(*block, "n_choices").agg(F.sum("n").alias("items"), F.map_from_entries(F.collect_list(F.struct("answer_index", "n"))).alias("at"))  # an entry an option
    positions = F.transform(F.sequence(F.lit(0), F.col("n_choices") - 1), lambda i: F.coalesce(F.col("at")[i], F.lit(0)))
    return by.withColumn("positions", positions).withColumn("spread", F.array_max("positions") - F.array_min("positions")).drop("at")


def missing_controls(items: DataFrame, pairing: str = "pairing_id") -> DataFrame:
    """Pairings without all core conditions, and which lack."""
    core = F.array(*(F.lit(c) for c in sorted(("normal_image", "no_image", "option_only", "shuffled_image"))))
    return items.groupBy(pairing).agg(F.array_except(core, F.collect_set("input_condition")).alias("missing")).where(F.size("missing") > 0)


def unregistered(items: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Items that refer to a key the registry lacks."""
    return items.join(registry.select(key), key, "left_anti")


def count_shortfalls(items: DataFrame, registry: DataFrame, required: list[tuple[str, str, int]], key: str = "concept_id") -> DataFrame:
    """(key, question_format, input_condition, wanted, found) of the cells that have too few items.

    The grid is dense: each registered key with each required (format, condition, number), so that cells without any item count as 0.
    """
    cells = F.array(*(F.struct(F.lit(f).alias("question_format"), F.lit(c).alias("input_condition"), F.lit(n).cast("long").alias("wanted")) for f, c, n in required))
    grid = registry.select(key).distinct().select(key, F.inline(cells))
    found = items.groupBy(key, "question_format", "input_condition").agg(F.count("*").alias("found"))
    out = grid.join(found, [key, "question_format", "input_condition"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.where("found < wanted")


def text_words(x: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def named_phrases(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """Rows of ``texts`` with each row of ``phrases`` whose words stand one after another in the text, once a pair.

    An inverted join: runs of words of the lengths that phrases have, by equality with the phrases' words. The lengths (a number for
    each different one) are all that comes to the driver. Phrases without a word match nothing.
    """
    names = phrases.withColumn("_words", text_words(F.col(phrase))).where(F.size("_words") > 0).withColumn("_phrase", F.array_join("_words", " "))
    lengths = sorted(r[0] for r in names.select(F.size("_words")).distinct().collect())
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size("_said") - n + 1), lambda i: F.array_join(F.slice("_said", i, F.lit(n)), " "))
        return F.when(F.size("_said") >= n, each).otherwise(none)

    every = F.array_distinct(F.concat(none, *map(runs, lengths)))
    said = texts.withColumn("_said", text_words(F.col(text))).withColumn("_phrase", F.explode(every)).drop("_said")
    return said.join(names.drop("_words"), "_phrase").drop("_phrase")


def concept_names(registry: DataFrame, concept: str = "concept_id") -> DataFrame:
    """(named_id, name) of all names and aliases of a registry with concept, concept_name and concept_aliases."""
    names = F.concat(F.array("concept_name"), F.coalesce("concept_aliases", F.array().cast("array<string>")))
    return registry.select(F.col(concept).alias("named_id"), F.explode(names).alias("name")).distinct()


def lexical_leakage(items: DataFrame, registry: DataFrame, item: str = "item_id", concept: str = "concept_id") -> DataFrame:
    """(item, named_id, name, own) of indirect probes whose question names a registered concept, its own or another, by whole words."""
    asked = items.where(F.col("probe_family") == "P2_INDIRECT").select(item, F.col(concept).alias("_own"), "question")
    found = named_phrases(asked, "question", concept_names(registry, concept), "name")
    return found.select(item, "named_id", "name", F.col("_own").eqNullSafe(F.col("named_id")).alias("own"))


def single_label(annotations: DataFrame, images: DataFrame, most: int = 3, single: bool = True, least_area: float = 0.02) -> DataFrame:
    """One category an image: (image_id, category_id, area, categories). Crowds are left out; images with too many annotations, with several
    categories if ``single``, or without a large enough annotation of the category go; of equal areas the first annotation counts."""
    a = annotations.where("not iscrowd")
    per = a.groupBy("image_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("category_id")).alias("categories")).where(F.col("n") <= most)
    if single:
        per = per.where(F.size("categories") == 1)
    first = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("area"), "ann_pos"))
    best = a.withColumn("rn", first).where("rn = 1").select("image_id", "category_id", "area")
    out = best.join(per, "image_id").join(images.select("image_id", (F.col("width") * F.col("height")).cast("double").alias("pixels")), "image_id")
    return out.where((F.col("pixels") > 0) & (F.col("area") >= least_area * F.col("pixels"))).select("image_id", "category_id", "area", "categories")


_named = re.compile(r"_(rk|sbk)(\d+)_s(\d+)$")


def registry_errors(registry: dict) -> list[str]:
    """Errors of a split registry (datasets -> experiments over defaults); a small driver-side document."""
    errors, seen = [], set()
    defaults = registry.get("defaults", {})
    for dataset in registry.get("datasets", {}).values():
        for experiment in dataset.get("experiments", []):
            e = defaults | experiment
            name = e.get("name", "")
            if not name or name in seen:
                errors.append(f"{name or '?'}: name is missing or used twice")
            seen.add(name)
            if e.get("mode") not in ("random_k", "superclass_balanced_k", "single", None):
                errors.append(f"{name}: unknown mode {e['mode']}")
            found = _named.search(name)
            if found and (int(found[2]), int(found[3])) != (e.get("k"), e.get("seed")):
                errors.append(f"{name}: its name says k={found[2]}, s={found[3]}; it has k={e.get('k')}, seed={e.get('seed')}")
            errors += [f"{name}: {k} is negative" for k, v in e.items() if (k.startswith("n_") or k == "k") and isinstance(v, int) and v < 0]
    return errors


def response_violations(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(rule, request_id): dropped, invented, repeated or silent responses, unknown statuses."""
    got = responses.groupBy("request_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("raw_output"), F.lit("")) == "").alias("silent"), F.bool_or(F.col("error_status").isNotNull()).alias("failed"), F.bool_or(~F.col("error_status").isin(*STATUSES)).alias("unknown"), F.bool_or(F.col("error_status").isNotNull() & F.col("error_detail").isNull()).alias("mute"))
    both = requests.select("request_id", F.lit(True).alias("asked")).join(got, "request_id", "full")
    rules = _reasons(("dropped", F.col("n").isNull()), ("invented", F.col("asked").isNull()), ("repeated", F.col("n") > 1), ("silent", F.col("silent") & ~F.col("failed")), ("unknown status", F.col("unknown")), ("error without detail", F.col("mute")))
    return both.select(F.explode(rules).alias("rule"), "request_id")
