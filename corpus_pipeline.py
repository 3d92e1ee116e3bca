"""A training-corpus pipeline: quality rules, toxicity, line dedup, SimHash near-dedup, best-fit packing.

Every stage but the last gives the columns it was given, whatever further ones there are and however they are named; a null or empty
text has no words and so does not pass the quality rules; rows with a null doc_id are kept apart by the later stages; repeated rows and
equal texts are copies, of which the near-dedup leaves one; an empty table passes through all stages.

Each stage works on all rows that the one before it kept and is written as Parquet in the shared folder, so
a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeforge.llm import line_dedup, packing, quality_rules, simhash, toxicity
from probeforge.llm.queries import remainder
from probeforge.llm.runtime import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Not expressible in SQL (a learned model, SimHash, a tokenizer); tests hold it against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and the failing lines of the others."""
    return quality_rules.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model learns from the labelled ones among those outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, labels, keep=lambda d: remainder(d, 4) != 2))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents whose every line did."""
    return line_dedup.line_dedup(docs).where("not emptied").select([F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("toxicity", toxic), ("line dedup", lines), ("simhash near-dedup", near_copies), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
