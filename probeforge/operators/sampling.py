"""Derivation of items: seeded orders, round robin, distractors, option orders, twins, controls and derangements.

Seeded order is the order of SHA-256 of ``seed|id``, the same on any partitioning and in any engine. No operator
numbers all rows in one task: global positions come from counts of small groups plus ranks inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeforge.functions.text import hex_int, norm_text, order_hash, stable_id
from probeforge.schema import DERANGE_GROUP, require_none

#: Padding words of spatial questions.
SPATIAL_POOL = (
    "left", "right", "above", "below", "in front of", "behind", "on", "under", "next to", "inside", "outside", "between", "near", "far", "top",
    "bottom", "center", "middle", "yes", "no", "same", "different", "closer", "farther", "overlapping", "adjacent", "north", "south", "east", "west",
)
#: Extra distractors of attribute groups with few values.
EXTRA_DISTRACTORS = {"size": ("tiny", "very large", "huge", "medium-large")}


def seeded(seed: int | str, *parts: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(p if isinstance(p, Column) else F.col(p).cast("string") for p in parts)), 256)


def shard(df: DataFrame, number: int, of: int, *key: str) -> DataFrame:
    """The rows of one of ``of`` shards, by a hash of ``key``; the shards are disjoint, cover all and need no numbering of rows."""
    return df.where(F.pmod(hex_int(F.substring(seeded("shard", *key), 1, 8)), F.lit(of)) == number)


def merge_shards(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """The shards' rows together; a key that stands in several is an error."""
    out = shards[0]
    for more in shards[1:]:
        out = out.unionByName(more)
    require_none(out.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "shards overlap")
    return out


def head_of(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def only(registry: DataFrame, wanted: list[str] | None, *columns: str) -> DataFrame:
    """The registry's rows whose value in any of the columns is wanted (none given: all); an unknown name is an error."""
    if not wanted:
        return registry
    names = registry.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("name")).distinct()
    asked = registry.sparkSession.createDataFrame([(w,) for w in wanted], "name string")
    require_none(asked.join(names, "name", "left_anti"), "not in the registry")
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).cast("string").isin(wanted), F.lit(False))
    return registry.where(out)


def missing_images(items: DataFrame, files: DataFrame, n: int = 3, image: str = "image", path: str = "path") -> DataFrame:
    """Those of the first ``n`` images (by name) that no listed file is."""
    return items.select(F.col(image).alias(path)).distinct().orderBy(path).limit(n).join(files.select(path), path, "left_anti")


def round_robin(df: DataFrame, cls: str, order: list[str], n: int | None = None) -> DataFrame:
    """Rows with ``turn``; by (turn, cls) they alternate between the sorted classes. ``n``: only the first so many."""
    out = df.withColumn("turn", F.row_number().over(Window.partitionBy(cls).orderBy(*order)).cast("bigint"))
    return out.orderBy("turn", cls).limit(n) if n is not None else out


#: Classes of a block of a ring.
RING_BLOCK = 64


def _ring_start(seed: int, tag: str, item: str, n: Column) -> Column:
    """A seeded position on a ring of ``n``."""
    return F.pmod(hex_int(F.substring(seeded(f"{seed}{tag}", item), 1, 13)), F.greatest(n, F.lit(1)))


def _ring_blocks(placed: DataFrame, keys: list[str], need: int) -> DataFrame:
    """(keys, b, block) of rings ``placed`` (keys, c, g: position, m: size): RING_BLOCK classes in order and the ``need`` that follow them around the ring."""
    copies = F.transform(F.sequence(F.lit(0), F.floor(F.lit(need) / F.col("m")).cast("int") + 1), lambda k: F.col("g") + k * F.col("m"))
    spots = placed.select(*keys, "c", "m", F.explode(copies).alias("p"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("p") - need) / RING_BLOCK)).cast("int"), F.floor(F.col("p") / RING_BLOCK).cast("int")
    spots = spots.select(*keys, "c", "m", "p", F.explode(F.sequence(first, last)).alias("b"))
    held = spots.where((F.col("b") * RING_BLOCK < F.col("m")) & (F.col("p") < (F.col("b") + 1) * RING_BLOCK + need))
    return held.groupBy(*keys, "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda x: x["c"]).alias("block"))


def _from_ring(block: str, start: str, most: Column) -> Column:
    """The classes from a position on, ``most`` at most."""
    none = F.array().cast("array<struct<h:string,wnid:string,norm:string,class_name:string>>")
    return F.coalesce(F.slice(block, (F.pmod(start, F.lit(RING_BLOCK)) + 1).cast("int"), most.cast("int")), none)


def with_distractors(items: DataFrame, classes: DataFrame, hard: int, easy: int, seed: int, item: str = "item_seq") -> DataFrame:
    """Adds ``distractors``, an array of (role, wnid, class_name): ``hard`` of the item's superclass first (then of any), ``easy`` of the rest.

    ``items`` has item, wnid, superclass; ``classes`` has wnid, class_name, superclass and is a dimension, reduced to one row for
    each normalised name. The classes of a superclass stand on a ring in seeded order, and so do all classes. An item takes its hard ones from
    its superclass's ring, from a seeded position on and past its own class, and its easy ones likewise from the ring of all, past
    those it has. Both rings are cut into blocks, and an item meets one block of each, by equality of keys: what a row holds
    and looks at does not depend on how many classes there are, in all or of one superclass.
    """
    one = classes.withColumn("norm", norm_text("class_name")).groupBy("norm").agg(F.min(F.struct("wnid", "class_name", "superclass")).alias("c")).select("norm", "c.*")
    order = F.struct(seeded(f"{seed}c", "wnid").alias("h"), "wnid", "norm", "class_name")
    norms = classes.groupBy(F.col("wnid").alias("own")).agg(F.min(norm_text("class_name")).alias("own_norm"))
    total, need, need_hard = one.count(), 2 * hard + easy + 1, hard + 2
    named = one.select(order.alias("c"), F.coalesce("superclass", F.lit("")).alias("ring_super"), F.col("superclass").isNull().alias("ring_none"))
    ring = ["ring_super", "ring_none"]
    sizes = named.groupBy(*ring).agg(F.count("*").alias("m"))
    near_at = named.withColumn("g", F.row_number().over(Window.partitionBy(*ring).orderBy("c")) - 1).join(sizes, ring)
    near_blocks = _ring_blocks(near_at, ring, need_hard).withColumnsRenamed({"block": "near_block", "b": "near_b"})
    all_blocks = _ring_blocks(named.withColumn("g", F.row_number().over(Window.orderBy("c")) - 1).withColumn("m", F.lit(total)), [], need)  # a row a class

    rows = items.withColumns({"own": F.col("wnid"), "ring_super": F.coalesce("superclass", F.lit("")), "ring_none": F.col("superclass").isNull()}).join(norms, "own", "left")
    rows = rows.join(sizes, ring, "left").withColumns({"m": F.coalesce("m", F.lit(0)), "start_all": _ring_start(seed, "e", item, F.lit(total))})
    rows = rows.withColumns({"start_near": _ring_start(seed, "h", item, F.col("m")), "b": F.floor(F.col("start_all") / RING_BLOCK).cast("int")})
    rows = rows.withColumn("near_b", F.floor(F.col("start_near") / RING_BLOCK).cast("int")).join(near_blocks, [*ring, "near_b"], "left").join(all_blocks, "b", "left")
    mine = lambda o: (o["wnid"] == F.col("own")) | (o["norm"] == F.coalesce("own_norm", F.lit("")))
    rows = rows.withColumn("near", F.slice(F.filter(_from_ring("near_block", "start_near", F.least("m", F.lit(need_hard))), lambda o: ~mine(o)), 1, hard))
    taken = F.transform("near", lambda o: o["wnid"])
    rows = rows.withColumn("rest", F.filter(_from_ring("block", "start_all", F.lit(min(need, total))), lambda o: ~mine(o) & ~F.array_contains(taken, o["wnid"])))
    short = F.lit(hard) - F.size("near")
    pick = lambda role: lambda o: F.struct(F.lit(role).alias("role"), o["wnid"].alias("wnid"), o["class_name"].alias("class_name"))
    both = F.concat(F.transform(F.concat(F.col("near"), F.slice("rest", F.lit(1), short)), pick("hard")), F.transform(F.slice("rest", short + 1, F.lit(easy)), pick("easy")))
    return rows.withColumn("distractors", both).drop("own", *ring, "own_norm", "m", "start_all", "start_near", "b", "near_b", "block", "near_block", "near", "rest")


def distractors(items: DataFrame, classes: DataFrame, hard: int, easy: int, seed: int, item: str = "item_seq") -> DataFrame:
    """The distractors of ``with_distractors``, a row each: item, role, wnid, class_name."""
    rows = with_distractors(items.select(item, "wnid", "superclass"), classes, hard, easy, seed, item)
    return rows.select(item, F.explode("distractors").alias("d")).select(item, "d.role", "d.wnid", "d.class_name")


def shuffled_choices(answer: Column, others: Column, seed: int, key: Column) -> tuple[Column, Column]:
    """(choices, answer_index): the answer among the others in seeded order."""
    all_ = F.concat(F.array(answer), others)
    order = F.array_sort(F.transform(all_, lambda c, i: F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), key, i.cast("string")), 256).alias("h"), c.alias("c"))))
    choices = F.transform(order, lambda x: x["c"])
    return choices, (F.array_position(choices, answer) - 1).cast("int")


def four_options(options: Column, answer_index: Column, seed: int, key: Column) -> tuple[Column, Column]:
    """Options brought to four: kept, sampled down around the answer, or padded from SPATIAL_POOL; with the answer's index."""
    answer = F.element_at(options, answer_index + 1)
    ranked = lambda xs, s: F.transform(F.array_sort(F.transform(xs, lambda c: F.struct(F.sha2(F.concat_ws("|", F.lit(f"{seed}{s}"), key, c), 256).alias("h"), c.alias("c")))), lambda x: x["c"])
    rest = F.filter(options, lambda c, i: i != answer_index)
    low = F.transform(options, norm_text)
    pool = F.filter(F.array(*map(F.lit, SPATIAL_POOL)), lambda p: ~F.array_contains(low, p))
    others = F.slice(F.concat(ranked(rest, "d"), F.when(F.size(options) < 4, ranked(pool, "p")).otherwise(F.array().cast("array<string>"))), 1, 3)
    mixed, at = shuffled_choices(answer, others, seed, key)
    four = F.size(options) == 4
    return F.when(four, options).otherwise(mixed), F.when(four, answer_index).otherwise(at)


def attribute_choices(scores: str, labels: str, group: str, seed: int, key: Column, threshold: float = 0.3, pool: Column | None = None) -> tuple[Column, Column]:
    """(choices, answer_index) of an attribute question: the best score's label and three others; null below the threshold or without three.

    The others are the next different labels by score, then those of ``pool`` (the labels of all groups, in their order), then the group's extra ones.
    """
    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  names a value, which is made once a row and not once a use
    more = pool if pool is not None else F.array().cast("array<string>")
    pairs = F.transform(F.arrays_zip(scores, labels), lambda x, i: F.struct((-x[scores]).alias("s"), i.alias("i"), x[labels].alias("l")))
    extra = F.array(*map(F.lit, EXTRA_DISTRACTORS.get(group, ()))).cast("array<string>")
    named = once(F.array_sort(pairs), lambda r: F.struct(r[0]["l"].alias("best"), (-r[0]["s"]).alias("top"), F.concat(F.transform(r, lambda x: x["l"]), more, extra).alias("names")))
    lowered = once(named, lambda n: F.struct(n["best"].alias("best"), n["top"].alias("top"), n["names"].alias("names"), F.transform(n["names"], F.lower).alias("low"), F.lower(n["best"]).alias("low_best")))
    different = lambda n: F.filter(n["names"], lambda c, i: (F.array_position(n["low"], F.lower(c)) == i + 1) & (F.lower(c) != n["low_best"]))
    picked = once(lowered, lambda n: F.struct(n["best"].alias("best"), n["top"].alias("top"), F.slice(different(n), 1, 3).alias("others")))
    mixed = once(picked, lambda p: F.struct(p["best"].alias("best"), ((p["top"] >= threshold) & (F.size(p["others"]) == 3)).alias("fine"), shuffled_choices(p["best"], p["others"], seed, key)[0].alias("choices")))
    made = once(mixed, lambda m: F.when(m["fine"], F.struct(m["choices"].alias("choices"), (F.array_position(m["choices"], m["best"]) - 1).cast("int").alias("at"))))
    return made["choices"], made["at"]


def randomize_options(items: DataFrame, seed: int, block: list[str], item: str = "item_id") -> DataFrame:
    """MCQ items with the answer moved so that its positions differ by one at most in each block.

    Adds permutation_seed, permutation_target and permutation (the old index of each new option). Where the items have the
    parts of an id, item_id and pairing_id are made anew, as the order of options is part of them; metadata, if there, gets the
    three as text. Items must be MCQ with a normal image.
    """
    bad = F.lit(False)
    for column, value in (("question_format", "mcq"), ("input_condition", "normal_image")):
        if column in items.columns:
            bad = bad | ~F.col(column).eqNullSafe(F.lit(value))
    bad = bad | F.col("choices").isNull() | ~F.coalesce(F.col("answer_index").between(0, F.size("choices") - 1), F.lit(False))
    require_none(items.where(bad).select(F.lit("not an MCQ item with a normal image").alias("rule"), F.col(item).cast("string")), "randomize_options")
    m = F.size("choices")
    out = items.withColumn("n_choices", m)
    target = F.pmod(F.row_number().over(Window.partitionBy(*block, "n_choices").orderBy(seeded(seed, item), item)) - 1, F.col("n_choices")).cast("int")
    out = out.withColumn("permutation_target", target)
    places = F.filter(F.sequence(F.lit(0), F.col("n_choices") - 1), lambda i: i != F.col("answer_index"))
    ranked = F.array_sort(F.transform(places, lambda i: F.struct(F.sha2(F.concat_ws("|", F.lit(f"{seed}o"), F.col(item).cast("string"), F.element_at("choices", i + 1)), 256).alias("h"), F.element_at("choices", i + 1).alias("c"), i.alias("i"))))
    others = F.transform(ranked, lambda x: x["i"])
    at = F.col("permutation_target")
    out = out.withColumn("permutation", F.concat(F.slice(others, F.lit(1), at), F.array("answer_index"), F.slice(others, at + 1, F.col("n_choices"))))
    out = out.withColumns({"choices": F.transform("permutation", lambda i: F.element_at("choices", i + 1)), "answer_index": at, "permutation_seed": F.lit(seed)})
    if {"sample_id", "probe_id", "prompt_variant_id", "input_condition"} <= set(items.columns):
        ids = ("sample_id", "probe_id", "prompt_variant_id")
        made = {"pairing_id": stable_id("pair", *ids, order_hash("choices")), "item_id": stable_id("item", *ids, "input_condition", order_hash("choices"))}
        if "metadata" in items.columns:
            extra = F.create_map(F.lit("pairing_id"), made["pairing_id"], F.lit("permutation_seed"), F.lit(str(seed)), F.lit("permutation_target"), at.cast("string"), F.lit("permutation"), F.array_join(F.transform("permutation", lambda i: i.cast("string")), ","))
            made["metadata"] = F.map_concat(F.map_filter("metadata", lambda k, v: ~F.map_contains_key(extra, k)), extra)
        if "pairing_id" not in items.columns and "metadata" in items.columns:
            made.pop("pairing_id")
        out = out.withColumns(made)
    return out.drop("n_choices")


def unique_answers(answers: Column) -> Column:
    """The first spelling of each normalised answer, in order."""
    low = F.transform(answers, norm_text)
    return F.filter(answers, lambda a, i: F.array_position(low, norm_text(a)) == i + 1)


def short_answer_twins(items: DataFrame, probe_id: str, question: str | None = None) -> DataFrame:
    """Short-answer forms of MCQ items with a normal image, with ids of their own; other items raise."""
    bad = F.lit(False)
    for column, value in (("question_format", "mcq"), ("input_condition", "normal_image")):
        if column in items.columns:
            bad = bad | ~F.col(column).eqNullSafe(F.lit(value))
    require_none(items.where(bad).select(F.lit("not an MCQ item with a normal image").alias("rule"), F.col("sample_id").cast("string")), "short_answer_twins")
    out = items.withColumns(
        {
            "question_format": F.lit("short_answer"), "probe_id": F.lit(probe_id), "choices": F.lit(None).cast("array<string>"), "answer_index": F.lit(None).cast("int"),
            "accepted_answers": unique_answers(F.concat(F.array("concept_name"), "concept_aliases")), "question": F.lit(question) if question else F.col("question"),
        }
    )
    return out.withColumns(
        {"item_id": stable_id("item", "sample_id", "probe_id", "prompt_variant_id", "input_condition", F.lit("")), "pairing_id": stable_id("pair", "sample_id", "probe_id", "prompt_variant_id", F.lit(""))}
    )


def derangement(items: DataFrame, seed: int, group: list[str], item: str = "item_id", concept: str = "concept_id") -> DataFrame:
    """(*group, item, donor): each item's donor has another concept, and every item donates once.

    Concepts stand behind one another by size, the largest first, each in seeded order; the donor stands the
    largest concept's size further on, around the end. Positions are the concept's offset plus the rank in it.
    """
    sizes = items.groupBy(*group, concept).agg(F.count("*").alias("size"))
    w = Window.partitionBy(*group).orderBy(F.desc("size"), concept)
    whole = Window.partitionBy(*group)
    sizes = sizes.withColumns({"offset": F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("size").over(whole), "shift": F.max("size").over(whole)})
    rank = F.row_number().over(Window.partitionBy(*group, concept).orderBy(seeded(seed, item), item)) - 1
    placed = items.select(*group, concept, item).join(sizes, [*group, concept]).withColumn("pos", F.col("offset") + rank)
    donors = placed.select(*group, F.col("pos").alias("at"), F.col(item).alias("donor"), F.col(concept).alias("donor_concept"))
    wanted = placed.withColumn("at", F.pmod(F.col("pos") + F.col("shift"), F.col("n")))
    return wanted.join(donors, [*group, "at"]).select(*group, item, concept, "donor", "donor_concept")


def derangement_violations(items: DataFrame, group: list[str], concept: str = "concept_id") -> DataFrame:
    """Groups that have no derangement: fewer than two items or concepts, or a concept of over half the items."""
    sizes = items.groupBy(*group, concept).agg(F.count("*").alias("size")).groupBy(*group).agg(F.sum("size").alias("n"), F.count("*").alias("concepts"), F.max("size").alias("largest"))
    return sizes.where("n < 2 or concepts < 2 or 2 * largest > n").select(F.lit("derangement").alias("rule"), *group, "n", "largest")


def control_variants(items: DataFrame, seed: int, with_question_only: bool = False, group: list[str] = list(DERANGE_GROUP)) -> DataFrame:
    """Items and their controls: no_image, option_only, shuffled_image (and question_only); a control keeps its item's pairing_id.

    Items must have a normal image. question_only has no options, and so is made of items without options only. A shuffled
    image's donor stands in donor_image_id and, if the items have metadata, there, with the seed.
    """
    bad = F.col("image").isNull() | ~F.col("input_condition").eqNullSafe(F.lit("normal_image"))
    require_none(items.where(bad).select(F.lit("not an item with a normal image").alias("rule"), "item_id"), "controls")
    require_none(items.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("item_id comes twice").alias("rule"), "item_id"), "controls")
    if with_question_only:
        require_none(items.where("question_format = 'mcq'").select(F.lit("question_only of an MCQ item").alias("rule"), "item_id"), "controls")
    require_none(derangement_violations(items, group), "controls")
    donors = derangement(items, seed, group).select("item_id", "donor")
    images = items.select(F.col("item_id").alias("donor"), F.col("image").alias("donor_image"), F.col("image_id").alias("donor_image_id"))
    rows = items.join(donors, "item_id").join(images, "donor").withColumn("condition", F.explode(F.array(*map(F.lit, ["normal_image", "no_image", "option_only", "shuffled_image", *(["question_only"] if with_question_only else [])]))))
    c = F.col("condition")
    control = c != "normal_image"
    rows = rows.withColumns(
        {
            "image": F.when(c == "normal_image", F.col("image")).when(c == "shuffled_image", F.col("donor_image")),
            "question": F.when(c == "option_only", F.lit("")).otherwise(F.col("question")), "donor_image_id": F.when(c == "shuffled_image", F.col("donor_image_id")),
            "probe_family": F.when(control, F.lit("P0_CONTROL")).otherwise(F.col("probe_family")), "input_condition": c,
            "item_id": F.when(control, stable_id("item", "sample_id", "probe_id", "prompt_variant_id", c, order_hash("choices"))).otherwise(F.col("item_id")),
        }
    )
    if "metadata" in items.columns:
        extra = F.create_map(F.lit("donor_image_id"), F.col("donor_image_id"), F.lit("control_seed"), F.lit(str(seed)))
        rows = rows.withColumn("metadata", F.when(F.col("condition") == "shuffled_image", F.map_concat(F.map_filter("metadata", lambda k, v: ~F.map_contains_key(extra, k)), extra)).otherwise(F.col("metadata")))
    return rows.drop("condition", "donor", "donor_image")
