"""Bootstrap intervals: a native form of any scale and a form with Python's own generator."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probeforge.functions.text import hex_int
from probeforge.sources.writers import staged


def percentile_rank(values: list[float], q: float) -> float:
    """Linear interpolation at q (n - 1) of sorted values."""
    at = q * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


#: Different values of a part of ``percentiles``.
PART_VALUES = 200_000


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], part_values: int | None = None) -> DataFrame:
    """By group the exact percentiles ``shares`` (column: q), interpolated at q (n - 1); nulls do not count.

    Different values with their counts are dealt by ranges of (keys, value); sums of these ranges tell which of them hold the wanted
    places, and only in those are rows numbered. No task holds more than a range, whatever a group's size.
    """
    counts = staged(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k")), "percentile-counts")
    parts = max(1, -(-counts.count() // (part_values or PART_VALUES)))
    placed = staged(counts.repartitionByRange(parts, *keys, "_v").withColumn("_p", F.spark_partition_id()), "percentile-ranges")
    upto, whole = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    sizes = placed.groupBy(*keys, "_p").agg(F.sum("_k").alias("_s")).select("*", (F.sum("_s").over(upto) - F.col("_s")).alias("_begin"), F.sum("_s").over(whole).alias("_n"))  # a row a range and group
    place = lambda q: F.lit(q) * (F.col("_n") - 1)
    holds = F.lit(False)
    for q in shares.values():
        holds = holds | ((F.ceil(place(q)) >= F.col("_begin")) & (F.floor(place(q)) < F.col("_begin") + F.col("_s")))
    wanted = sizes.where(holds).select(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(keys)), F.col("_p").alias("_wp"), "_begin", "_n")
    same = F.col("_p") == F.col("_wp")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    rows = placed.join(F.broadcast(wanted), same)  # at most two ranges a group and share
    end = F.col("_begin") + F.sum("_k").over(Window.partitionBy(*keys, "_p").orderBy("_v"))
    rows = rows.withColumn("_end", end)
    at = lambda r: F.max(F.when((F.col("_end") - F.col("_k") <= r) & (r < F.col("_end")), F.col("_v")))
    ends = [x for name, q in shares.items() for x in (at(F.floor(place(q))).alias(f"_low_{name}"), at(F.ceil(place(q))).alias(f"_high_{name}"))]
    found = rows.groupBy(*keys).agg(F.first("_n").alias("_n"), *ends)
    between = lambda name, q: F.when(F.floor(place(q)) == F.ceil(place(q)), F.col(f"_low_{name}")).otherwise((F.ceil(place(q)) - place(q)) * F.col(f"_low_{name}") + (place(q) - F.floor(place(q))) * F.col(f"_high_{name}"))
    return found.select(*keys, *(between(name, q).alias(name) for name, q in shares.items()))


#: Counts up to which Poisson numbers come from their exact distribution; beyond, from the normal one, corrected for skew.
SMALL_COUNT = 64


def _poisson(spark: SparkSession) -> DataFrame:
    """(k, cdf) for each small count: the probabilities of at most 0, 1, ... of a Poisson number of mean k."""
    rows = []
    for k in range(1, SMALL_COUNT + 1):
        term = total = math.exp(-k)
        cdf = [total]
        while term > 1e-18 or len(cdf) <= k:
            term *= k / len(cdf)
            total += term
            cdf.append(total)
        rows.append((k, cdf))
    return spark.createDataFrame(rows, "_small long, _cdf array<double>")


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, replicates: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean, by group: n, mean, low, high.

    Poisson bootstrap: in each replicate a row counts a Poisson number of times of mean 1, so all k rows of one value count a
    Poisson number of mean k, which is one draw from a hash of (seed, keys, value, replicate). A replicate thus costs as many draws
    as a group has different values (two for accuracy data), whatever its rows; values and replicates are rows, summed by
    (keys, replicate), and no group is held together. A replicate without any row counts for nothing.
    """
    v, k = F.col("_v"), F.col("_k")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    counts = counts.join(F.broadcast(_poisson(df.sparkSession)), F.col("_k") == F.col("_small"), "left").drop("_small")  # SMALL_COUNT rows
    each = counts.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    name = F.when(F.abs(v) < 1e20, v.cast("decimal(38,12)").cast("string")).otherwise(v.cast("string"))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in keys), name, F.col("_r").cast("string")), 256)
    each = each.withColumn("_h", digest)
    uniform = lambda at: hex_int(F.substring("_h", at, 13)).cast("double") / float(1 << 52)
    each = each.withColumns({"_u": uniform(1), "_w": uniform(14)})
    z = F.sqrt(-2 * F.log(1 - F.col("_u"))) * F.cos(F.lit(2 * math.pi) * F.col("_w"))
    large = F.greatest(F.lit(0.0), F.round(k + F.sqrt(k.cast("double")) * F.col("_z") + (F.col("_z") * F.col("_z") - 1) / 6))
    drawn = F.when(F.col("_cdf").isNotNull(), F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))).cast("double")).otherwise(large)
    each = each.withColumn("_z", z).withColumn("_times", drawn)
    means = each.groupBy(*keys, "_r").agg(F.sum("_k").alias("_n"), F.sum(v * k).alias("_s"), F.try_divide(F.sum(v * F.col("_times")), F.sum("_times")).alias("_m"))
    return means.groupBy(*keys).agg(
        F.first("_n").alias("n"), F.first(F.col("_s") / F.col("_n")).alias("mean"), F.percentile("_m", F.lit(alpha / 2)).alias("low"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("high")
    )


def bootstrap_rows(values: list[float], replicates: int = 2000, alpha: float = 0.05, seed: int = 0) -> dict:
    """The interval of one list of values with ``random.Random(seed)``."""
    if not values:
        raise ValueError("bootstrap needs values")
    rng, n = random.Random(seed), len(values)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(replicates))
    return {"mean": sum(values) / n, "low": percentile_rank(means, alpha / 2), "high": percentile_rank(means, 1 - alpha / 2), "alpha": alpha, "num_samples": replicates, "n": n, "seed": seed}


def bootstrap_ci_seeded(df: DataFrame, keys: list[str], value: str, order: str, replicates: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """bootstrap_rows by group, rows in ``order``; for groups that fit a task (evaluation cells), where draws must equal Python's."""

    def run(pdf):
        found = bootstrap_rows(pdf.sort_values(order)[value].astype(float).tolist(), replicates, alpha, seed)
        return pdf[keys].head(1).assign(n=found["n"], mean=found["mean"], low=found["low"], high=found["high"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    return df.where(F.col(value).isNotNull()).select(*keys, value, order).groupBy(*keys).applyInPandas(run, f"{kinds}, n long, mean double, low double, high double")


def paired_bootstrap(pairs: DataFrame, keys: list[str], first: str, second: str, **options) -> DataFrame:
    """The interval of the mean difference of two columns of paired rows, with both means."""
    diff = pairs.withColumn("difference", F.col(first).cast("double") - F.col(second).cast("double"))
    means = pairs.groupBy(*keys).agg(F.avg(F.col(first).cast("double")).alias("mean_first"), F.avg(F.col(second).cast("double")).alias("mean_second"))
    found = bootstrap_ci(diff, keys, "difference", **options)
    return found.join(means, keys) if keys else found.crossJoin(means)


def concept_bootstrap(df: DataFrame, concept: str, value: str, **options) -> DataFrame:
    """Concepts are resampled: the interval of the mean of concept means."""
    return bootstrap_ci(df.groupBy(concept).agg(F.avg(F.col(value).cast("double")).alias("concept_mean")), [], "concept_mean", **options)
