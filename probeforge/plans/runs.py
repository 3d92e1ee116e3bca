"""Registered queries of runs: an adapter that errs, legacy ways, rounds of thought, shards that fail and are resumed, hashed artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeforge.operators import inference as I
from probeforge.operators import legacy_runs as Y
from probeforge.operators import sharded as H
from probeforge.plans.catalogue import register
from probeforge.plans.coverage import _RUN, _run_items
from probeforge.sources import hashed_lines as J
from probeforge.sources.writers import shared_folder, spread


def erring_adapter(lost_shard: int | None = None) -> I.Adapter:
    """Answers by the item's number k: wrong if 3 divides it, without a digit if 7 does, no logits if 11 does, a failed request if 13 does.

    Its thought is open after one round if 5 divides k, after any number of rounds if k % 5 = 1. It loses its device in ``lost_shard``.
    """

    def said(pdf):
        if lost_shard is not None and "shard" in pdf and (pdf["shard"] == lost_shard).any():
            raise I.WorkerFailure("device lost")
        keys = [int(k) for k in pdf["item_id"]]
        if any(k % 13 == 0 for k in keys):
            raise RuntimeError("no answer")
        return ["none" if k % 7 == 0 else str(int(a) ^ (k % 3 == 0)) for k, a in zip(keys, pdf["answer_index"])]

    def liked(pdf):
        return [[] if int(k) % 11 == 0 else [float(i == (int(a) ^ (int(k) % 3 == 0))) for i in range(len(c))] for k, a, c in zip(pdf["item_id"], pdf["answer_index"], pdf["choices"])]

    def thought(pdf):
        return [" so</think>" if t and int(k) % 5 == 0 else " hm" if t else "<think>well" if int(k) % 5 < 2 else "<think>ok</think>" for k, t in zip(pdf["item_id"], pdf["thought"])]

    return I.Adapter("erring", {"supports_images": True, "supports_batching": True, "supports_logits": True}, lambda: said, lambda: liked, think=lambda: thought)


_CONDITIONS = ("BASELINE_NORMAL", "UNLEARN_SOFT", "ORACLE_HARD")
_WAYS = f"""SELECT way, condition, split, item_seq % 17 = 0 AS missing, CASE WHEN way IN ('batch', 'single') THEN item_seq % 7 = 0 OR item_seq % 13 = 0 ELSE item_seq % 11 = 0 END AS invalid, item_seq % 3 <> 0 AS fine
  FROM ({_RUN}) CROSS JOIN (VALUES ('batch'), ('single'), ('logit'), ('thinking')) w(way) CROSS JOIN (VALUES ('BASELINE_NORMAL'), ('UNLEARN_SOFT'), ('ORACLE_HARD')) c(condition)"""


@register(f"""SELECT way, condition, split, count(*) AS n, count(*) FILTER (NOT missing AND NOT invalid AND fine) AS n_correct, count(*) FILTER (missing OR invalid) AS n_invalid, count(*) FILTER (missing) AS n_missing FROM ({_WAYS}) GROUP BY ALL""")
def legacy_ways(spark, d):
    """The four ways of a legacy run of an adapter that errs, with images that are missing."""
    items = _run_items(spark, d)
    files = items.where("item_id % 17 <> 0").select(F.col("image").alias("path"))
    out = None
    for way in Y.PATHS:
        records = Y.legacy_records(items, erring_adapter(), list(_CONDITIONS), way, files=files, template=lambda p: F.concat(F.lit("<s>"), p, F.lit("\n<think>\n")) if way == "logit" else p)
        one = records.withColumn("way", F.lit(way))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("way", "condition", "split").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"), F.count_if("is_invalid").alias("n_invalid"), F.count_if(F.startswith("error", F.lit("image_not_found"))).alias("n_missing"))


@register(f"SELECT CASE WHEN item_seq % 5 < 2 THEN 2 ELSE 1 END AS rounds, CASE item_seq % 5 WHEN 0 THEN '<think>well so</think>' WHEN 1 THEN '<think>well hm</think>' ELSE '<think>ok</think>' END AS thought, count(*) AS n FROM ({_RUN}) GROUP BY 1, 2")
def thinking_rounds(spark, d):
    """Thoughts in two rounds; the second asks only for those that the first left open."""
    reqs = Y.conditioned(_run_items(spark, d), ["BASELINE_NORMAL"])
    return Y.thoughts(reqs, erring_adapter(), rounds=2).groupBy("rounds", "thought").agg(F.count("*").alias("n"))


_SHARD = "CAST(concat('0x', substr(sha256(concat('shard|', item_seq)), 1, 8)) AS BIGINT) % 5"


@register(f"""WITH r AS (SELECT {_SHARD} AS shard, item_seq % 13 <> 0 AND item_seq % 7 <> 0 AND item_seq % 3 <> 0 AS fine FROM ({_RUN}))
  SELECT CAST(shard AS INT) AS shard, shard <> 2 AS in_first_run, CASE WHEN shard = 2 THEN 'WorkerFailure: device lost' END AS failed, count(*) AS requests, count(*) FILTER (fine AND shard <> 2) AS correct_before, count(*) FILTER (fine) AS correct_after FROM r GROUP BY r.shard""")
def resumed_shards(spark, d):
    """A run whose third shard fails is reduced without it; the next run answers that shard only, with another adapter."""
    items, folder = _run_items(spark, d), shared_folder(spark, "shards")
    failed = H.run_shards(items, erring_adapter(lost_shard=2), folder, 5)
    first = spark.createDataFrame(H.finished(spark, folder).collect(), H.COMMIT)  # a row a shard
    right = lambda: H.reduce_shards(items, folder, 5)[0].groupBy(H.shard_of(5, "item_id").alias("shard")).agg(F.count_if(F.col("response_status") == "correct").alias("n"))
    before = spark.createDataFrame(right().collect(), "shard int, n long")  # a row a shard, before the second run adds to the folder
    again = H.run_shards(items, erring_adapter(), folder, 5)
    done = H.finished(spark, folder).join(again, "shard", "left_anti").join(first.select("shard", F.lit(True).alias("first")), "shard", "left").join(failed, "shard", "left")
    done = done.join(before.withColumnRenamed("n", "n_before"), "shard", "left").join(right(), "shard", "left")
    return done.select("shard", F.coalesce("first", F.lit(False)).alias("in_first_run"), "failed", "requests", F.coalesce("n_before", F.lit(0)).alias("correct_before"), F.coalesce("n", F.lit(0)).alias("correct_after"))


@register(f"""SELECT wnid AS concept_id, CASE WHEN item_seq % 13 = 0 THEN 'model_error' WHEN item_seq % 7 = 0 THEN 'invalid_format' WHEN item_seq % 3 = 0 THEN 'incorrect' ELSE 'correct' END AS response_status,
  CASE WHEN item_seq % 13 <> 0 AND item_seq % 7 <> 0 THEN CASE WHEN item_seq % 3 = 0 THEN '0' ELSE '1' END END AS prediction, count(*) AS n FROM ({_RUN}) GROUP BY ALL""")
def written_run(spark, d):
    """A run of an adapter that errs, its results read back from the JSON lines that it wrote with their digests."""
    folder = shared_folder(spark, "written-run")
    run = I.evaluate(_run_items(spark, d), erring_adapter(), run_id="run", out_dir=folder)
    records = J.read_hashed_lines(run.records, f"{folder}/results")
    return records.groupBy("concept_id", "response_status", "prediction").agg(F.count("*").alias("n"))


@register("SELECT p_partkey, p_name, p_retailprice FROM part")
def hashed_lines(spark, d):
    """Rows written as JSON lines by tasks that also made the digests, and read again."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_retailprice")
    path = shared_folder(spark, "hashed")
    J.write_hashed_lines(p.repartition(4), path)
    return J.read_hashed_lines(p, path)


@register(f"SELECT wnid AS concept_id, CASE WHEN item_seq % 3 = 0 THEN 'incorrect' ELSE 'correct' END AS response_status, count(*) AS n FROM ({_RUN}) WHERE item_seq % 11 <> 0 GROUP BY ALL")
def scored_options(spark, d):
    """Items answered by the logit path of an adapter that errs; those whose options could not be scored are left out here."""
    records = I.score_option_requests(I.requests(_run_items(spark, d), "run"), erring_adapter())
    return records.where("size(logits) > 0").groupBy("concept_id", "response_status").agg(F.count("*").alias("n"))


@register(f"""SELECT wnid AS concept_id, CASE WHEN item_seq % 13 = 0 THEN 'model_error' WHEN item_seq % 7 = 0 THEN 'invalid_format' WHEN (item_seq % 3 = 0) = (wnid IN (SELECT DISTINCT wnid FROM ({_RUN}) WHERE item_seq % 50 = 0)) THEN 'correct' ELSE 'incorrect' END AS response_status, count(*) AS n FROM ({_RUN}) GROUP BY ALL""")
def treated_run(spark, d):
    """A run of a method with all hooks: it learns concepts from training items, turns the answers of these round, and tidies outputs."""
    items = _run_items(spark, d)

    def prepare(forget, retain):
        return {r[0] for r in forget.select("concept_id").distinct().collect()}  # a registry-sized set

    def intervene(model, concepts):
        return lambda pdf: [{"0": " [1]", "1": " [0]"}.get(a, a) if c in concepts else a for a, c in zip(model(pdf), pdf["concept_id"])]

    method = I.Method("turned", "control", ("supports_images",), prepare=prepare, intervene=intervene, transform_output=lambda x: F.regexp_replace(x, "[\\[\\] ]", ""), about={"rate": 0.5})
    run = I.evaluate(items, erring_adapter(), method, "run", training=(items.where("item_id % 50 = 0"), None))
    return run.records.groupBy("concept_id", "response_status").agg(F.count("*").alias("n"))


_BROKEN = f"SELECT item_seq % 9 AS kind, count(*) AS n FROM ({_RUN}) GROUP BY 1"
_BROKEN_ERRORS = (
    "", "question must be non-empty", "answer_index out of range", "choices must be unique", "split is no known value", "image must be non-empty", "donor_image_id is required", "schema_version", "license.id must be non-empty",
)


@register(f"SELECT e.error, n FROM ({_BROKEN}) b JOIN (VALUES {', '.join(f'({i}, {chr(39)}{e}{chr(39)})' for i, e in enumerate(_BROKEN_ERRORS) if e)}) e(kind, error) USING (kind)")
def broken_items(spark, d):
    """Items of which eight in nine break one rule each; the errors that name these rules."""
    from probeforge.operators.quality import item_errors

    kind = F.col("item_id").cast("long") % 9
    broken = lambda k, value, name: F.when(kind == k, value).otherwise(F.col(name)).alias(name)
    changed = {
        "question": (1, F.lit(" ")), "answer_index": (2, F.lit(2)), "choices": (3, F.array(F.lit("A b"), F.lit(" a  B"))), "split": (4, F.lit("train")), "image": (5, F.lit("")),
        "input_condition": (6, F.lit("shuffled_image")), "schema_version": (7, F.lit("0.9.0")), "license": (8, F.create_map(F.lit("id"), F.lit(""), F.lit("redistribution"), F.lit("no"))),
    }
    items = _run_items(spark, d)
    rows = items.select(*(broken(*changed[c], c) if c in changed else c for c in items.columns))
    named = rows.select(F.explode(item_errors()).alias("error")).where(F.col("error").isin(*_BROKEN_ERRORS))
    return named.groupBy("error").agg(F.count("*").alias("n"))


@register(f"""SELECT count(*) AS requests, count(*) FILTER (said) AS said, count(*) FILTER (said AND fine) AS said_right, count(*) FILTER (picked) AS picked, count(*) FILTER (picked AND fine) AS picked_right, count(*) FILTER (said AND picked) AS both, count(*) FILTER (said AND picked) AS agree
  FROM (SELECT item_seq % 13 <> 0 AND item_seq % 7 <> 0 AS said, item_seq % 11 <> 0 AS picked, item_seq % 3 <> 0 AS fine FROM ({_RUN}))""")
def contract_tallies(spark, d):
    """Answers of both ways of an adapter that errs, told apart by what can be read, is right and agrees."""
    items = _run_items(spark, d)
    said = I.evaluate(items, erring_adapter(), run_id="run").records
    picked = I.score_option_requests(I.requests(items, "run"), erring_adapter())
    return I.contract_tallies(said, picked)


@register(f"SELECT wnid, CAST(2 AS INT) AS n_choices, count(*) AS items, concat(count(*) FILTER (item_seq % 3 = 0), ',', count(*) FILTER (item_seq % 3 <> 0)) AS positions, abs(count(*) FILTER (item_seq % 3 = 0) - count(*) FILTER (item_seq % 3 <> 0)) AS spread FROM ({_RUN}) GROUP BY 1")
def option_positions(spark, d):
    """Where the answers stand among the options of each concept."""
    from probeforge.operators.quality import option_positions as positions

    items = _run_items(spark, d).withColumn("answer_index", F.when(F.col("item_id").cast("long") % 3 == 0, 0).otherwise(1))
    return positions(items, ["concept_id"]).select(F.col("concept_id").alias("wnid"), "n_choices", "items", F.array_join(F.transform("positions", lambda n: n.cast("string")), ",").alias("positions"), "spread")


@register("""SELECT p_partkey, CASE WHEN p_size % 10 >= 3 THEN array_to_string(list_sort(list_append(list_filter(['small', 'large', 'red', 'blue', 'tiny'], lambda x: x <> lower(p_brand))[1:3], lower(p_brand))), '|') END AS choices FROM part""")
def padded_choices(spark, d):
    """Attribute questions of one label, padded from the labels of other groups."""
    from probeforge.operators.sampling import attribute_choices

    p = spread(spark.read.parquet(f"{d}/part.parquet"), "p_partkey").select("p_partkey", F.array(F.lower("p_brand")).alias("labels"), F.array((F.col("p_size") % 10) / 10).alias("scores"))
    pool = F.array(*map(F.lit, ("small", "LARGE", "large", "red", "blue")))
    choices, at = attribute_choices("scores", "labels", "size", 7, F.col("p_partkey").cast("string"), 0.3, pool)
    return p.select("p_partkey", F.array_join(F.array_sort(F.transform(choices, lambda c: F.lower(c))), "|").alias("choices"))
