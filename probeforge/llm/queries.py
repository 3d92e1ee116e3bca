"""The registered corpus queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``: the folds of the contracts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.line_dedup import line_dedup

    out = line_dedup(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), F.array_join(F.transform("removed_lines", lambda x: x.cast("string")), ",").alias("removed_lines"), F.md5("text").alias("text_md5"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.simhash import hex_fingerprint, simhash_components

    return simhash_components(_docs(spark, sf_dir)).select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.lm_score import lm_scores

    out = lm_scores(_docs(spark, sf_dir), remainder(F.col("doc_id"), 5) != 1, min_count=1)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.quality_fm import fit_quality, score_quality

    docs = _docs(spark, sf_dir)
    machine = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=lambda d: remainder(d, 5) != 0)
    return score_quality(docs, machine).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.quality_rules import quality_rules

    return quality_rules(_docs(spark, sf_dir)).drop("text")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.html_wrapper import extract_pages

    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.neighbours import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 100 == 0)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.packing import pack

    return pack(_docs(spark, sf_dir))


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.piece_lattice import encoding_digests

    return encoding_digests(_docs(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.toxicity import fit_toxicity, score_toxicity

    docs = _docs(spark, sf_dir)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=lambda d: remainder(d, 4) != 2)
    return score_toxicity(docs, model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.importance import importance_ranks

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance_ranks(_docs(spark, sf_dir), benchmark, percent=10, min_words=20, max_n=1, buckets=10_000, seed=2024).select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_openings

    return prefix_trie(with_shared_openings(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: The conversation that the contract adds: its texts hold the marks and the escape of the template.
PLANTED = r"\### Assistant: </turn> ok"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from probeforge.llm.chat_format import as_records, format_records, read_back

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], turns.schema)
    return read_back(format_records(as_records(turns.unionByName(planted))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and k[2:].split("_")[0].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from probeforge.llm import sql

    return {
        "op1_line_dedup": sql.LINE_DEDUP, "op5_quality_rules": sql.QUALITY_RULES, "op11_importance_resampling": sql.IMPORTANCE, "op12_conversation_trie": sql.TRIE, "op13_chat_formatting": sql.CHAT,
    }
