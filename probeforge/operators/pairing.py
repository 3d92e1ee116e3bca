"""State-to-state comparison: integrity of the pairing, forgetting effect, retain fidelity and audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeforge.functions.text import rate
from probeforge.schema import PAIR_KEYS, SCORABLE, require_none


def pair_violations(m0: DataFrame, mu: DataFrame, keys: list[str] = list(PAIR_KEYS)) -> DataFrame:
    """(rule, *keys): keys that repeat on a side, or that one side lacks. One shuffle of counts, no pairs."""
    side = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = side(m0, "n0").join(side(mu, "nu"), keys, "full")
    rules = F.array_compact(
        F.array(
            F.when(F.col("n0") > 1, F.lit("duplicate_m0")), F.when(F.col("nu") > 1, F.lit("duplicate_mu")),
            F.when(F.col("n0").isNull(), F.lit("unpaired_mu")), F.when(F.col("nu").isNull(), F.lit("unpaired_m0")),
        )
    )
    return both.select(F.explode(rules).alias("rule"), *keys)


def paired(m0: DataFrame, mu: DataFrame, keys: list[str] = list(PAIR_KEYS), status: str = "response_status", prediction: str | None = "prediction", check: bool = True) -> DataFrame:
    """Inner pairing with columns m0_status, mu_status, m0_prediction, mu_prediction; raises on violations."""
    if check:
        require_none(pair_violations(m0, mu, keys), "pairing")
    take = lambda df, p: df.select(*keys, F.col(status).alias(f"{p}_status"), *([F.col(prediction).alias(f"{p}_prediction")] if prediction else []))
    return take(m0, "m0").join(take(mu, "mu"), keys)


def _share(of: Column) -> Column:
    return rate(F.count_if(of), F.count(F.lit(1)))


def forgetting_effect(pairs: DataFrame, keys: list[str] = []) -> DataFrame:
    """Access before less access after; also over pairs scorable in both states, and the deltas of other rates."""
    m0, mu = F.col("m0_status"), F.col("mu_status")
    clean = m0.isin(*SCORABLE) & mu.isin(*SCORABLE)
    n_clean = F.count_if(clean)
    delta = lambda *of: _share(mu.isin(*of)) - _share(m0.isin(*of))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("pairs"), (_share(m0 == "correct") - _share(mu == "correct")).alias("fe_access"),
        (rate(F.count_if(clean & (m0 == "correct")), n_clean) - rate(F.count_if(clean & (mu == "correct")), n_clean)).alias("fe_clean"), n_clean.alias("clean_pairs"),
        delta(*SCORABLE).alias("delta_coverage"), delta("refusal").alias("delta_refusal"), delta("invalid_format").alias("delta_invalid"),
        delta("policy_block").alias("delta_policy"), delta("api_error", "model_error").alias("delta_error"),
    )


def retain_fidelity(pairs: DataFrame, keys: list[str] = []) -> DataFrame:
    """kept, lost and gained access; fidelity; and how often both predictions agree."""
    before, after = F.col("m0_status") == "correct", F.col("mu_status") == "correct"
    both = F.col("m0_prediction").isNotNull() & F.col("mu_prediction").isNotNull()
    kept, lost = F.count_if(before & after), F.count_if(before & ~after)
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("pairs"), kept.alias("kept"), lost.alias("lost"), F.count_if(~before & after).alias("gained"), rate(kept, kept + lost).alias("retain_fidelity"),
        F.count_if(both).alias("comparable"), rate(F.count_if(both & (F.col("m0_prediction") == F.col("mu_prediction"))), F.count_if(both)).alias("output_consistency"),
    )


def acquisition_audit(states: DataFrame, keys: list[str] = []) -> DataFrame:
    """From statuses m0, acq and mu of each sample: what was acquired, unlearned, and the total change of access."""
    access = lambda c: _share(F.col(c) == "correct")
    return states.groupBy(*keys).agg(
        F.count("*").alias("samples"), (access("acq_status") - access("m0_status")).alias("delta_acq"),
        (access("mu_status") - access("acq_status")).alias("delta_unlearn"), (access("mu_status") - access("m0_status")).alias("delta_total"),
    )


def neighbourhood_damage(pairs: DataFrame, stratum: str) -> DataFrame:
    """Loss of access by stratum of neighbours."""
    return forgetting_effect(pairs, [stratum]).select(stratum, "pairs", F.col("fe_access").alias("damage"))


def _stirling_rest(x: Column) -> Column:
    """ln(x!) less Stirling's (x + 1/2) ln x - x + ln(2 pi) / 2, for whole x > 0: its series from 16 on, below by the steps up to 16."""
    up = F.greatest(x, F.lit(16.0))
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - (F.lit(1 / 1680) - F.lit(1 / 1188) / (up * up)) / (up * up)) / (up * up)) / (up * up)) / up
    below = F.when(x < 16, F.sequence(x.cast("int"), F.lit(15))).otherwise(F.array().cast("array<int>"))
    return series + F.aggregate(below, F.lit(0.0), lambda s, t: s + (t + 0.5) * F.log1p(1 / t.cast("double")) - 1)


def half_binomial(k: Column, n: Column) -> Column:
    """The probability of k of n fair draws, to about 1e-13 of itself for n up to millions: no difference of large logarithms is taken."""
    k, n = k.cast("double"), n.cast("double")
    d = (n - 2 * k) / n
    apart = n / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    inner = F.sqrt(n / (2 * math.pi * k * (n - k))) * F.exp(_stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - apart)
    return F.when((k == 0) | (k == n), F.exp(-n * math.log(2))).otherwise(inner)


def exact_p(b: Column, c: Column) -> Column:
    """The two-sided exact p-value of McNemar's test: twice the tail of fair draws up to the rarer of b and c, 1 at most; null for b + c = 0.

    The tail is summed from its largest term down by the ratio of neighbours; after 5 sqrt(n) + 50 terms what is left is below 1e-20 of it.
    """
    k, n = F.least(b, c).cast("double"), (b + c).cast("double")
    far = F.least(k, F.ceil(5 * F.sqrt(n)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j + 1) / (n - k + j)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(far >= 1, F.sequence(F.lit(1), far)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, step, lambda acc: acc["sum"]) * half_binomial(k, n)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def discordance(pairs: DataFrame, keys: list[str] = []) -> DataFrame:
    """Discordant counts, McNemar's statistic with continuity correction and the exact p-value (both null without discordant pairs)."""
    before, after = F.col("m0_status") == "correct", F.col("mu_status") == "correct"
    counts = pairs.groupBy(*keys).agg(F.count_if(before & ~after).alias("only_before"), F.count_if(~before & after).alias("only_after"))
    b, c = F.col("only_before"), F.col("only_after")
    statistic = F.try_divide(F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double"), 2.0), (b + c).cast("double"))
    return counts.withColumns({"mcnemar": statistic, "p_value": exact_p(b, c)})
