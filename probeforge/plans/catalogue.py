"""The registered queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probeforge.functions import text as X
from probeforge.operators import accounting as A
from probeforge.operators import eligibility as E
from probeforge.operators import inference as I
from probeforge.operators import manifests as N
from probeforge.operators import migration as G
from probeforge.operators import pairing as P
from probeforge.operators import pool as O
from probeforge.operators import quality as Q
from probeforge.operators import sampling as S
from probeforge.operators import scoring as R
from probeforge.operators import splits as L
from probeforge.operators import statistics as B
from probeforge.plans import views as V
from probeforge.plans.views import view
from probeforge.schema import SCORABLE, STATUSES, Thresholds
from probeforge.streaming import metrics as M

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def register(sql: str | None = None):
    def wrap(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from probeforge.plans import coverage, files, runs  # noqa: F401  register their own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from probeforge.plans import coverage, files, runs  # noqa: F401

    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligibility gate, with thresholds for the smallest scale."""
    return E.manifest(E.evaluate_cells(view(spark, sf_dir, V.EVID), Thresholds(n_min=5), with_ci=False))


# --- SQL building blocks

_n = lambda *s: f"count(*) FILTER (response_status IN ({', '.join(repr(x) for x in s)}))"
_r = lambda a, b: f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"
_ACC = ", ".join(
    ["count(*) AS attempted", f"{_n(*SCORABLE)} AS scorable", *(f"{_n(s)} AS n_{s}" for s in STATUSES), f"{_r(_n('correct'), 'count(*)')} AS access_rate", f"{_r(_n('correct'), _n(*SCORABLE))} AS conditional_accuracy",
     f"{_r(_n(*SCORABLE), 'count(*)')} AS coverage", f"{_r(_n('refusal'), 'count(*)')} AS refusal_rate", f"{_r(_n('invalid_format'), 'count(*)')} AS invalid_rate",
     f"{_r(_n('policy_block'), 'count(*)')} AS policy_rate", f"{_r(_n('api_error', 'model_error'), 'count(*)')} AS error_rate"]
)


@register(f"SELECT user_id, {_ACC} FROM ({V.STATUS}) GROUP BY user_id")
def response_accounting_by_user(spark, d):
    return A.response_accounting(view(spark, d, V.STATUS), ["user_id"])


@register(f"SELECT question_format, input_condition, concept_id, CAST(grouping(question_format, input_condition, concept_id) AS BIGINT) AS level, {_ACC} FROM ({V.EVID}) GROUP BY GROUPING SETS ((), (question_format, input_condition), (concept_id, input_condition))")
def accounting_grouping_sets(spark, d):
    return A.accounting_sets(view(spark, d, V.EVID), [[], ["question_format", "input_condition"], ["concept_id", "input_condition"]])


@register(f"SELECT response_status, count(*) AS n FROM ({V.STATUS}) WHERE response_status NOT IN ('correct', 'incorrect') GROUP BY 1")
def failure_counts(spark, d):
    return A.failure_counts(view(spark, d, V.STATUS))


_OUT = f"SELECT sample_id, CASE WHEN bool_or(response_status = 'correct') THEN 'leaked' WHEN bool_or(response_status = 'incorrect') THEN 'contained' ELSE 'unscorable' END AS outcome, sum(attack_unit_cost) AS cost, count(*) AS requests FROM ({{}}) GROUP BY sample_id"
_WCL = """SELECT count(*) AS samples, count(*) FILTER (outcome = 'leaked') AS leaked, count(*) FILTER (outcome = 'contained') AS contained, count(*) FILTER (outcome = 'unscorable') AS unscorable,
  CAST(count(*) FILTER (outcome = 'leaked') AS DOUBLE) / nullif(count(*) FILTER (outcome <> 'unscorable'), 0) AS wcl, CAST(count(*) FILTER (outcome <> 'unscorable') AS DOUBLE) / nullif(count(*), 0) AS scorable_sample_coverage,
  CAST(sum(requests) AS BIGINT) AS attack_requests, CAST(sum(cost) AS BIGINT) AS attack_budget_spent FROM ({})"""


@register(_WCL.format(_OUT.format(V.ATTACK)))
def worst_case_leakage(spark, d):
    return A.worst_case_leakage(view(spark, d, V.ATTACK))


_ATT2 = "SELECT user_id AS sample_id, event_id, CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'click' THEN 'incorrect' ELSE 'refusal' END AS response_status, event_id % 5 + 1 AS attack_unit_cost FROM events"


@register(_WCL.format(_OUT.format(f"SELECT * FROM (SELECT *, sum(attack_unit_cost) OVER (PARTITION BY sample_id ORDER BY attack_unit_cost, event_id ROWS UNBOUNDED PRECEDING) AS running FROM ({_ATT2})) WHERE running <= 6")))
def leakage_under_budget(spark, d):
    return A.worst_case_leakage(A.within_budget(view(spark, d, _ATT2), 6, ["attack_unit_cost", "event_id"]))


_sh = lambda c: f"CAST(count(*) FILTER ({c}) AS DOUBLE) / nullif(count(*), 0)"
_clean = "m0_status IN ('correct', 'incorrect') AND mu_status IN ('correct', 'incorrect')"
_d = lambda s: f"{_sh(f'mu_status IN ({s})')} - {_sh(f'm0_status IN ({s})')}"
_FE = f"""count(*) AS pairs, {_sh("m0_status = 'correct'")} - {_sh("mu_status = 'correct'")} AS fe_access,
  CAST(count(*) FILTER ({_clean} AND m0_status = 'correct') AS DOUBLE) / nullif(count(*) FILTER ({_clean}), 0) - CAST(count(*) FILTER ({_clean} AND mu_status = 'correct') AS DOUBLE) / nullif(count(*) FILTER ({_clean}), 0) AS fe_clean,
  count(*) FILTER ({_clean}) AS clean_pairs, {_d("'correct', 'incorrect'")} AS delta_coverage, {_d("'refusal'")} AS delta_refusal, {_d("'invalid_format'")} AS delta_invalid, {_d("'policy_block'")} AS delta_policy, {_d("'api_error', 'model_error'")} AS delta_error"""


@register(f"SELECT concept_id, {_FE} FROM ({V.PAIR}) GROUP BY concept_id")
def forgetting_effect_by_concept(spark, d):
    p = view(spark, d, V.PAIR)
    side = lambda s: p.select("sample_id", "concept_id", F.col(f"{s}_status").alias("response_status"), F.col(f"{s}_prediction").alias("prediction"))
    return P.forgetting_effect(P.paired(side("m0"), side("mu"), ["sample_id", "concept_id"]), ["concept_id"])


@register(f"""SELECT concept_id, count(*) AS pairs, count(*) FILTER (m0_status = 'correct' AND mu_status = 'correct') AS kept, count(*) FILTER (m0_status = 'correct' AND mu_status <> 'correct') AS lost,
  count(*) FILTER (m0_status <> 'correct' AND mu_status = 'correct') AS gained, CAST(count(*) FILTER (m0_status = 'correct' AND mu_status = 'correct') AS DOUBLE) / nullif(count(*) FILTER (m0_status = 'correct'), 0) AS retain_fidelity,
  count(*) FILTER (m0_prediction IS NOT NULL AND mu_prediction IS NOT NULL) AS comparable, CAST(count(*) FILTER (m0_prediction = mu_prediction) AS DOUBLE) / nullif(count(*) FILTER (m0_prediction IS NOT NULL AND mu_prediction IS NOT NULL), 0) AS output_consistency
  FROM ({V.PAIR}) GROUP BY concept_id""")
def retain_transitions(spark, d):
    return P.retain_fidelity(view(spark, d, V.PAIR), ["concept_id"])


@register(f"""WITH a AS (SELECT sample_id FROM ({V.PAIR}) WHERE sample_id % 10 <> 3 UNION ALL SELECT sample_id FROM ({V.PAIR}) WHERE sample_id % 50 = 1), b AS (SELECT sample_id FROM ({V.PAIR}) WHERE sample_id % 10 <> 4),
  x AS (SELECT sample_id, count(*) AS n FROM a GROUP BY 1), y AS (SELECT sample_id, count(*) AS n FROM b GROUP BY 1), z AS (SELECT coalesce(x.sample_id, y.sample_id) AS sample_id, x.n AS n0, y.n AS nu FROM x FULL JOIN y ON x.sample_id = y.sample_id)
  SELECT 'duplicate_m0' AS rule, sample_id FROM z WHERE n0 > 1 UNION ALL SELECT 'duplicate_mu', sample_id FROM z WHERE nu > 1 UNION ALL SELECT 'unpaired_mu', sample_id FROM z WHERE n0 IS NULL UNION ALL SELECT 'unpaired_m0', sample_id FROM z WHERE nu IS NULL""")
def pairing_violations(spark, d):
    p = view(spark, d, V.PAIR).select("sample_id")
    m0 = p.where("sample_id % 10 <> 3").unionByName(p.where("sample_id % 50 = 1"))
    return P.pair_violations(m0, p.where("sample_id % 10 <> 4"), ["sample_id"])


@register(f"SELECT concept_id, count(*) AS samples, {_sh("acq_status = 'correct'")} - {_sh("m0_status = 'correct'")} AS delta_acq, {_sh("mu_status = 'correct'")} - {_sh("acq_status = 'correct'")} AS delta_unlearn, {_sh("mu_status = 'correct'")} - {_sh("m0_status = 'correct'")} AS delta_total FROM ({V.PAIR}) GROUP BY concept_id")
def acquisition_audit(spark, d):
    return P.acquisition_audit(view(spark, d, V.PAIR), ["concept_id"])


_STRATA = "SELECT c_custkey AS o_custkey, r_name AS stratum FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@register(f"SELECT stratum, count(*) AS pairs, {_sh("m0_status = 'correct'")} - {_sh("mu_status = 'correct'")} AS damage FROM ({V.PAIR}) JOIN ({_STRATA}) USING (o_custkey) GROUP BY stratum")
def neighbourhood_damage(spark, d):
    return P.neighbourhood_damage(view(spark, d, V.PAIR).join(view(spark, d, _STRATA), "o_custkey"), "stratum")


@register(f"""WITH c AS (SELECT concept_id, count(*) FILTER (m0_status = 'correct' AND mu_status <> 'correct') AS b, count(*) FILTER (m0_status <> 'correct' AND mu_status = 'correct') AS c FROM ({V.PAIR}) GROUP BY concept_id)
  SELECT concept_id, b AS only_before, c AS only_after, pow(CAST(greatest(abs(b - c) - 1, 0) AS DOUBLE), 2) / nullif(CAST(b + c AS DOUBLE), 0) AS mcnemar,
  CASE WHEN b + c > 0 THEN round(least(1, 2 * list_sum(list_transform(range(least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 9) END AS p_value FROM c""")
def discordant_pairs(spark, d):
    return P.discordance(view(spark, d, V.PAIR), ["concept_id"]).withColumn("p_value", F.round("p_value", 9))


_GATE = f"""WITH e AS ({V.EVID}), c AS (SELECT concept_id, question_format, count(*) FILTER (input_condition = 'normal_image') AS n,
    CAST(count(*) FILTER (input_condition = 'normal_image' AND response_status = 'correct') AS DOUBLE) / nullif(count(*) FILTER (input_condition = 'normal_image'), 0) AS a,
    CAST(count(*) FILTER (input_condition = 'no_image' AND response_status = 'correct') AS DOUBLE) / nullif(count(*) FILTER (input_condition = 'no_image'), 0) AS c1,
    CAST(count(*) FILTER (input_condition = 'option_only' AND response_status = 'correct') AS DOUBLE) / nullif(count(*) FILTER (input_condition = 'option_only'), 0) AS c2,
    CAST(count(*) FILTER (input_condition = 'shuffled_image' AND response_status = 'correct') AS DOUBLE) / nullif(count(*) FILTER (input_condition = 'shuffled_image'), 0) AS c3 FROM e GROUP BY 1, 2),
  v AS (SELECT concept_id, question_format, min(x) AS lo, max(x) AS hi FROM (SELECT concept_id, question_format, prompt_variant_id, CAST(count(*) FILTER (response_status = 'correct') AS DOUBLE) / count(*) AS x FROM e WHERE input_condition = 'normal_image' GROUP BY 1, 2, 3) GROUP BY 1, 2),
  g AS (SELECT c.*, lo, hi, CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL AND c3 IS NOT NULL THEN a - greatest(c1, c2, c3) END AS gap FROM c LEFT JOIN v USING (concept_id, question_format)),
  k AS (SELECT *, list_filter([CASE WHEN n < 50 THEN 'INSUFFICIENT_SAMPLES' END, CASE WHEN n > 0 AND a < CASE question_format WHEN 'mcq' THEN 0.6 ELSE 0.5 END THEN 'LOW_NORMAL_ACCESS' END, CASE WHEN n > 0 AND (c1 IS NULL OR c2 IS NULL OR c3 IS NULL) THEN 'MISSING_CONTROL' END,
     CASE WHEN n > 0 AND gap < 0.2 THEN 'LOW_VISUAL_GAP' END, CASE WHEN n > 0 AND question_format = 'mcq' AND (lo < 0.5 OR hi - lo > 0.15) THEN 'VARIANT_INSTABILITY' END], lambda x: x IS NOT NULL) AS codes FROM g)"""


@register(f"{_GATE} SELECT concept_id, question_format, n AS n_normal, a AS normal_access, gap AS visual_gap, array_to_string(codes, ',') AS codes FROM k")
def eligibility_cells(spark, d):
    return E.evaluate_cells(view(spark, d, V.EVID), with_ci=False).select("concept_id", "question_format", "n_normal", "normal_access", "visual_gap", F.array_join("codes", ",").alias("codes"))


@register(f"{_GATE} SELECT concept_id, bool_and(len(codes) = 0) AS eligible FROM k GROUP BY concept_id")
def eligibility_gate(spark, d):
    return E.manifest(E.evaluate_cells(view(spark, d, V.EVID), with_ci=False)).select("concept_id", "eligible")


@register(f"{_GATE} SELECT question_format, code, count(*) AS n FROM (SELECT question_format, UNNEST(codes) AS code FROM k) GROUP BY 1, 2")
def failure_code_counts(spark, d):
    return E.code_counts(E.evaluate_cells(view(spark, d, V.EVID), with_ci=False))


@register(f"{_GATE}, ok AS (SELECT concept_id FROM k GROUP BY 1 HAVING bool_and(len(codes) = 0)) SELECT input_condition, {_ACC} FROM e WHERE concept_id IN (SELECT concept_id FROM ok) GROUP BY input_condition")
def eligible_only_metrics(spark, d):
    e = view(spark, d, V.EVID)
    return A.response_accounting(E.eligible_only(e, E.manifest(E.evaluate_cells(e, with_ci=False))), ["input_condition"])


_POIS = """pois AS (SELECT k, list_transform(range(0, 220), lambda j: list_sum(list_transform(range(0, j + 1), lambda i: exp(-k + i * ln(k) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END)))) AS cdf
  FROM (SELECT CAST(range AS DOUBLE) AS k FROM range(1, 65)))"""


def _ci(source: str, keys: str, replicates: int, named: str = "low, high", more: str = "n, mean") -> str:
    """SQL of the Poisson bootstrap over ``source`` (keys, x)."""
    by, and_ = (f"{keys}, ", f"{keys}, '|', ") if keys else ("", "")
    return f"""{_POIS}, bv AS (SELECT {by}CAST(x AS DOUBLE) AS v, count(*) AS k FROM ({source}) WHERE x IS NOT NULL GROUP BY ALL),
  bd AS (SELECT {by}v, k, r, sha256(concat('0|', {and_}CAST(CAST(v AS DECIMAL(38, 12)) AS VARCHAR), '|', r)) AS h FROM bv, (SELECT range AS r FROM range(1, {replicates + 1}))),
  bu AS (SELECT {by}v, k, r, CAST(CAST(concat('0x', substr(h, 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u, CAST(CAST(concat('0x', substr(h, 14, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496 AS w FROM bd),
  bz AS (SELECT *, sqrt(-2 * ln(1 - u)) * cos(2 * pi() * w) AS z FROM bu),
  bt AS (SELECT {by}v, bz.k, r, CASE WHEN cdf IS NOT NULL THEN CAST(len(list_filter(cdf, lambda c: c <= u)) AS DOUBLE) ELSE greatest(0, round(bz.k + sqrt(bz.k) * z + (z * z - 1) / 6)) END AS t FROM bz LEFT JOIN pois ON bz.k = pois.k),
  bm AS (SELECT {by}r, sum(k) AS n, sum(v * k) / sum(k) AS mean, sum(v * t) / nullif(sum(t), 0) AS m FROM bt GROUP BY ALL),
  ci AS (SELECT {by}CAST(any_value(n) AS BIGINT) AS n, round(any_value(mean), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM bm {f'GROUP BY {keys}' if keys else ''})"""


_CIX = f"SELECT concept_id, CASE WHEN response_status = 'correct' THEN 1 ELSE 0 END AS x FROM ({V.EVID}) WHERE input_condition = 'normal_image'"
_rounded = lambda df: df.withColumns({c: F.round(c, 9) for c in ("mean", "low", "high")})


@register(f"""{_GATE}, {_ci(f"SELECT concept_id, question_format, CASE WHEN response_status = 'correct' THEN 1 ELSE 0 END AS x FROM ({V.EVID}) WHERE input_condition = 'normal_image' AND question_format = 'mcq'", "concept_id, question_format", 500).replace("concept_id, question_format, '|'", "concept_id, '|', question_format, '|'")}
  SELECT k.concept_id, k.question_format, round(a, 9) AS normal_access, ci.low AS ci_low, ci.high AS ci_high,
    array_to_string(list_filter(['INSUFFICIENT_SAMPLES', 'LOW_NORMAL_ACCESS', 'MISSING_CONTROL', 'LOW_VISUAL_GAP', 'CI_BELOW_FLOOR', 'VARIANT_INSTABILITY'], lambda x: list_contains(codes, x) OR x = 'CI_BELOW_FLOOR' AND coalesce(ci.low <= 0.25, false)), ',') AS codes
  FROM k LEFT JOIN ci ON k.concept_id = ci.concept_id AND k.question_format = ci.question_format""")
def eligibility_with_intervals(spark, d):
    cells = E.evaluate_cells(view(spark, d, V.EVID), Thresholds(replicates=500))
    return cells.select("concept_id", "question_format", *(F.round(c, 9).alias(c) for c in ("normal_access", "ci_low", "ci_high")), F.array_join("codes", ",").alias("codes"))


@register(f"WITH {_ci(_CIX, 'concept_id', 500)} SELECT * FROM ci")
def bootstrap_ci_native(spark, d):
    e = view(spark, d, V.EVID).where("input_condition = 'normal_image'").select("concept_id", (F.col("response_status") == "correct").cast("double").alias("x"))
    return _rounded(B.bootstrap_ci(e, ["concept_id"], "x", replicates=500))


_PBX = f"SELECT concept_id, CASE WHEN m0_status = 'correct' THEN 1 ELSE 0 END AS a, CASE WHEN mu_status = 'correct' THEN 1 ELSE 0 END AS b FROM ({V.PAIR})"


@register(f"WITH {_ci(f'SELECT concept_id, a - b AS x FROM ({_PBX})', 'concept_id', 200)}, pm AS (SELECT concept_id, round(avg(CAST(a AS DOUBLE)), 9) AS mean_first, round(avg(CAST(b AS DOUBLE)), 9) AS mean_second FROM ({_PBX}) GROUP BY 1) SELECT * FROM ci JOIN pm USING (concept_id)")
def paired_bootstrap(spark, d):
    p = view(spark, d, V.PAIR).select("concept_id", (F.col("m0_status") == "correct").cast("double").alias("a"), (F.col("mu_status") == "correct").cast("double").alias("b"))
    return _rounded(B.paired_bootstrap(p, ["concept_id"], "a", "b", replicates=200)).withColumns({c: F.round(c, 9) for c in ("mean_first", "mean_second")})


@register("SELECT l_returnflag, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.025) AS low, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.975) AS high FROM lineitem GROUP BY 1")
def percentile_interpolation(spark, d):
    return B.percentiles(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag"], "l_extendedprice", {"low": 0.025, "high": 0.975})


_LEG = f"""SELECT split, condition, CAST(sum(n) AS BIGINT) AS n, avg(CAST(k AS DOUBLE) / n) AS macro_accuracy, CAST(sum(k) AS DOUBLE) / sum(n) AS micro_accuracy, CAST(sum(i) AS DOUBLE) / sum(n) AS invalid_rate
  FROM (SELECT split, condition, meta_synset, count(*) AS n, count(*) FILTER (gt_index = pred_index) AS k, count(*) FILTER (pred_index IS NULL) AS i FROM ({V.LEGACY}) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@register(_LEG)
def macro_micro_accuracy(spark, d):
    return A.accuracy(view(spark, d, V.LEGACY), ["split", "condition"])


@register(f"SELECT split, max(micro_accuracy) FILTER (condition = 'BASELINE_NORMAL') AS BASELINE_NORMAL, max(micro_accuracy) FILTER (condition = 'UNLEARN_SOFT') AS UNLEARN_SOFT, max(micro_accuracy) FILTER (condition = 'ORACLE_HARD') AS ORACLE_HARD FROM ({_LEG}) GROUP BY split")
def summary_pivot(spark, d):
    return A.summary_pivot(A.accuracy(view(spark, d, V.LEGACY), ["split", "condition"]), ["BASELINE_NORMAL", "UNLEARN_SOFT", "ORACLE_HARD"])


@register(f"SELECT split, condition, count(*) FILTER (pred_index = 0) AS n0, count(*) FILTER (pred_index = 1) AS n1, count(*) FILTER (pred_index = 2) AS n2, count(*) FILTER (pred_index = 3) AS n3, count(*) AS n_valid, entropy(pred_index) AS entropy FROM ({V.LEGACY}) WHERE pred_index BETWEEN 0 AND 3 GROUP BY 1, 2")
def prediction_entropy(spark, d):
    return A.prediction_entropy(view(spark, d, V.LEGACY), ["split", "condition"])


@register(f"SELECT meta_synset, CAST(count(*) FILTER (gt_index = pred_index) AS DOUBLE) / count(*) AS accuracy FROM ({V.LEGACY}) GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def hardest_classes(spark, d):
    return A.hardest_classes(view(spark, d, V.LEGACY))


@register("SELECT vec_id, list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS prediction, CASE WHEN list_position(embedding[1:4], list_max(embedding[1:4])) - 1 = label % 4 THEN 'correct' ELSE 'incorrect' END AS response_status FROM embeddings")
def logit_argmax(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").withColumns({"logits": F.slice("embedding", 1, 4), "answer": F.col("label") % 4})
    s = e.withColumn("s", R.score_logits("logits", "answer"))
    return s.select("vec_id", F.col("s.prediction").cast("int").alias("prediction"), F.col("s.response_status").alias("response_status"))


_REF = "|".join(p.replace("'", "''") for p in X.REFUSALS)
_DIGIT = r"regexp_extract(raw_output, '\b([0-3])\b', 1)"
_TXT = "list_position(['en', 'de', 'fr', 'src1'], lower(trim(raw_output)))"


@register(f"""WITH r AS (SELECT *, CASE WHEN {_DIGIT} <> '' THEN CAST({_DIGIT} AS INT) WHEN {_TXT} > 0 THEN {_TXT} - 1 END AS p, regexp_matches(raw_output, '{_REF}', 'i') AS refused FROM ({V.RAW}))
  SELECT request_id, CAST(p AS VARCHAR) AS prediction, CASE WHEN p = answer_index THEN 'correct' WHEN p IS NOT NULL THEN 'incorrect' WHEN refused THEN 'refusal' ELSE 'invalid_format' END AS response_status FROM r""")
def score_mcq(spark, d):
    r = view(spark, d, V.RAW).withColumn("choices", F.array(*map(F.lit, ("en", "de", "fr", "src1"))))
    return r.withColumn("s", R.score_mcq("raw_output", "choices", "answer_index")).select("request_id", "s.prediction", "s.response_status")


@register(f"""WITH r AS (SELECT *, trim(raw_output, ' .,!?"''()') AS bare, regexp_matches(raw_output, '{_REF}', 'i') AS refused FROM ({V.RAW}))
  SELECT request_id, CASE WHEN trim(raw_output) = '' THEN 'invalid_format' WHEN lower(bare) IN (lower(lang), 'source') THEN 'correct' WHEN refused THEN 'refusal' ELSE 'incorrect' END AS response_status FROM r""")
def score_short_answer(spark, d):
    r = view(spark, d, V.RAW).withColumn("accepted", F.array("lang", F.lit("source")))
    return r.withColumn("s", R.score_short_answer("raw_output", "accepted")).select("request_id", "s.response_status")


@register(f"SELECT request_id, regexp_matches(raw_output, '{_REF}', 'i') AS refused FROM ({V.RAW})")
def refusal_detection(spark, d):
    return view(spark, d, V.RAW).select("request_id", X.refusal_match("raw_output").isNotNull().alias("refused"))


@register(f"SELECT item_seq, wnid, row_number() OVER (PARTITION BY wnid ORDER BY image_relpath) AS turn FROM ({V.ITEM}) ORDER BY turn, wnid LIMIT 200")
def round_robin_sample(spark, d):
    return S.round_robin(view(spark, d, V.ITEM), "wnid", ["image_relpath"], 200).select("item_seq", "wnid", "turn")


_h = lambda *p: f"sha256(concat({', '.join(p)}))"


def _ring(item: str) -> str:
    """SQL of the distractors (two hard, one easy, seed 7) of each item of ``i`` among the classes ``c``: (item, role, wnid, class_name)."""
    at = lambda tag: f"CAST(concat('0x', substr({_h(f"'7{tag}|'", item)}, 1, 13)) AS BIGINT)"
    return f"""rr AS (SELECT wnid, class_name, superclass, row_number() OVER (PARTITION BY superclass ORDER BY {_h("'7c|'", "wnid")}, wnid) - 1 AS pos, count(*) OVER (PARTITION BY superclass) AS m,
  row_number() OVER (ORDER BY {_h("'7c|'", "wnid")}, wnid) - 1 AS g, count(*) OVER () AS mm FROM c),
  rh AS (SELECT {item}, wnid, class_name FROM (SELECT i.{item}, r.wnid, r.class_name, row_number() OVER (PARTITION BY i.{item} ORDER BY j) AS k FROM i, range(0, 4) t(j), rr r
    WHERE r.superclass = i.superclass AND r.pos = ({at('h').replace(item, 'i.' + item)} + j) % r.m AND j < r.m AND r.wnid <> i.wnid) WHERE k <= 2),
  re AS (SELECT {item}, wnid, class_name FROM (SELECT i.{item}, r.wnid, r.class_name, row_number() OVER (PARTITION BY i.{item} ORDER BY j) AS k FROM i JOIN range(0, 6) t(j) ON true JOIN rr r
    ON r.g = ({at('e').replace(item, 'i.' + item)} + j) % r.mm ANTI JOIN rh ON rh.{item} = i.{item} AND rh.wnid = r.wnid WHERE r.wnid <> i.wnid) WHERE k = 1)"""


@register(f"WITH i AS ({V.ITEM}), c AS ({V.CLASSES}), {_ring('item_seq')} SELECT item_seq, 'hard' AS role, wnid, class_name FROM rh UNION ALL SELECT item_seq, 'easy', wnid, class_name FROM re")
def hard_easy_distractors(spark, d):
    return S.distractors(view(spark, d, V.ITEM), view(spark, d, V.CLASSES), 2, 1, 7)


_DER = f"""WITH i AS ({V.ITEM}), s AS (SELECT wnid, count(*) AS size FROM i GROUP BY 1), p AS (SELECT item_seq, i.wnid, row_number() OVER (ORDER BY size DESC, i.wnid, {_h("'7|'", "item_seq")}, item_seq) - 1 AS pos FROM i JOIN s USING (wnid)),
  t AS (SELECT max(size) AS shift, sum(size) AS n FROM s) SELECT a.item_seq, a.wnid, b.item_seq AS donor, b.wnid AS donor_concept FROM p a CROSS JOIN t JOIN p b ON b.pos = (a.pos + shift) % n"""


@register(_DER)
def shuffled_image_derangement(spark, d):
    items = view(spark, d, V.ITEM).withColumn("one", F.lit(1))
    return S.derangement(items, 7, ["one"], "item_seq", "wnid").drop("one")


_MCQ = f"SELECT item_seq, superclass, wnid, 'mcq' AS question_format, item_seq % 4 AS answer_index FROM ({V.ITEM})"


def _mcq(spark, d):
    c = F.array(F.concat(F.lit("a"), F.col("item_seq").cast("string")), F.concat(F.lit("b"), F.col("item_seq").cast("string")), F.concat(F.lit("c"), F.col("item_seq").cast("string")), F.concat(F.lit("d"), F.col("item_seq").cast("string")))
    return view(spark, d, _MCQ).withColumns({"choices": c, "answer_index": F.col("answer_index").cast("int")})


@register(f"""WITH i AS ({_MCQ}), t AS (SELECT item_seq, superclass, (row_number() OVER (PARTITION BY superclass ORDER BY {_h("'7|'", "item_seq")}, item_seq) - 1) % 4 AS answer_index, concat(chr(CAST(97 + answer_index AS INT)), item_seq) AS answer FROM i)
  SELECT item_seq, superclass, CAST(answer_index AS INT) AS answer_index, answer FROM t""")
def option_randomization(spark, d):
    out = S.randomize_options(_mcq(spark, d), 7, ["superclass"], "item_seq")
    return out.select("item_seq", "superclass", "answer_index", F.element_at("choices", F.col("answer_index") + 1).alias("answer"))


@register(f"SELECT superclass, CAST(4 AS INT) AS n_choices, max(n) AS most, min(n) AS least FROM (SELECT superclass, answer_index, count(*) AS n FROM ({_MCQ}) GROUP BY 1, 2) GROUP BY 1 HAVING max(n) - CASE WHEN count(*) < 4 THEN 0 ELSE min(n) END > 1")
def answer_imbalance(spark, d):
    return Q.imbalance(_mcq(spark, d), ["superclass"]).select("superclass", "n_choices", "most", "least")


@register(f"SELECT item_seq, condition FROM ({V.ITEM}) CROSS JOIN (VALUES ('normal_image'), ('no_image'), ('option_only'), ('shuffled_image')) t(condition)")
def control_variant_fanout(spark, d):
    i = view(spark, d, V.ITEM)
    items = i.select(
        "item_seq", F.col("item_seq").cast("string").alias("item_id"), F.col("item_seq").cast("string").alias("sample_id"), F.col("image_relpath").alias("image"), F.concat(F.lit("im"), "item_seq").alias("image_id"), F.col("wnid").alias("concept_id"), F.lit("p").alias("probe_id"), F.lit("P1_DIRECT").alias("probe_family"),
        F.lit("v").alias("prompt_variant_id"), F.lit("mcq").alias("question_format"), F.lit("normal_image").alias("input_condition"), F.lit("what?").alias("question"), F.array("class_name", F.lit("zebra")).alias("choices"), F.lit("d").alias("dataset_id"), F.lit("test_forget").alias("split"),
    )
    return S.control_variants(items, 7).select("item_seq", F.col("input_condition").alias("condition"))


@register(f"SELECT pairing_id, array_to_string(list_filter(['no_image', 'normal_image', 'option_only', 'shuffled_image'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM (SELECT concept_id || prompt_variant_id AS pairing_id, list(DISTINCT input_condition) AS have FROM ({V.EVID}) WHERE NOT (concept_id IN ('c3', 'c4') AND input_condition = 'no_image') GROUP BY 1) WHERE len(have) < 4")
def core_control_check(spark, d):
    e = view(spark, d, V.EVID).where("not (concept_id in ('c3', 'c4') and input_condition = 'no_image')").withColumn("pairing_id", F.concat("concept_id", "prompt_variant_id"))
    return Q.missing_controls(e).select("pairing_id", F.array_join("missing", ",").alias("missing"))


_FORGET = f"SELECT wnid FROM ({V.CLASSES}) ORDER BY {_h("'7|'", "wnid")}, wnid LIMIT 5"


@register(f"""WITH f AS ({_FORGET}), i AS ({V.ITEM}), r AS (SELECT item_seq, wnid, row_number() OVER (PARTITION BY wnid ORDER BY {_h("'7|'", "item_seq")}, item_seq) AS rn FROM i WHERE wnid IN (SELECT wnid FROM f)),
  q AS (SELECT item_seq, wnid, row_number() OVER (ORDER BY {_h("'7|'", "item_seq")}, item_seq) AS rn FROM i WHERE wnid NOT IN (SELECT wnid FROM f))
  SELECT item_seq, wnid, CASE WHEN rn <= 10 THEN 'test_forget' ELSE 'train_forget' END AS split FROM r WHERE rn <= 30 UNION ALL SELECT item_seq, wnid, CASE WHEN rn <= 100 THEN 'train_retain' ELSE 'test_retain' END FROM q WHERE rn <= 150""")
def split_forget_retain(spark, d):
    i, c = view(spark, d, V.ITEM), view(spark, d, V.CLASSES)
    f = L.random_k(c, "wnid", 5, 7)
    out = L.split_forget(i, f, "wnid", "item_seq", 20, 10, 7).unionByName(L.split_retain(i, f, "wnid", "item_seq", 100, 50, 7))
    return out.select("item_seq", "wnid", "split")


@register(f"WITH f AS ({_FORGET}) SELECT wnid, count(*) AS n FROM ({V.ITEM}) WHERE wnid NOT IN (SELECT wnid FROM f) GROUP BY 1")
def retain_pool_anti(spark, d):
    f = L.random_k(view(spark, d, V.CLASSES), "wnid", 5, 7)
    return view(spark, d, V.ITEM).join(f.select("wnid"), "wnid", "left_anti").groupBy("wnid").agg(F.count("*").alias("n"))


@register(f"SELECT wnid, superclass FROM (SELECT *, row_number() OVER (PARTITION BY superclass ORDER BY {_h("'7|'", "wnid")}, wnid) AS turn FROM ({V.CLASSES})) ORDER BY turn, {_h("'7|'", "superclass")}, superclass LIMIT 12")
def superclass_balanced_k(spark, d):
    return L.balanced_k(view(spark, d, V.CLASSES), "wnid", "superclass", 12, 7).select("wnid", "superclass")


_UNEVEN = f"SELECT wnid, superclass FROM ({V.CLASSES}) WHERE NOT (superclass = 'asia' AND wnid > 'NATION_15') AND NOT (superclass = 'africa' AND wnid > 'NATION_1')"


@register(f"""WITH c AS ({_UNEVEN}), t AS (SELECT *, row_number() OVER (PARTITION BY superclass ORDER BY wnid) AS turn FROM c), k AS (SELECT superclass, turn FROM t ORDER BY turn, {_h("'7|'", "superclass")}, superclass LIMIT 13)
  SELECT superclass, count(*) AS capacity, (SELECT count(*) FROM k WHERE k.superclass = c.superclass) AS allocated FROM c GROUP BY 1""")
def balanced_allocation(spark, d):
    """How many of 13 classes each of five uneven superclasses gives."""
    return L.balanced_allocation(view(spark, d, _UNEVEN), "superclass", 13, 7)


_SPL = f"SELECT item_seq, wnid, superclass, CASE item_seq % 4 WHEN 0 THEN 'train_forget' WHEN 1 THEN 'test_forget' WHEN 2 THEN 'train_retain' ELSE 'test_retain' END AS split FROM ({V.ITEM})"


@register(f"SELECT a.split AS s1, b.split AS s2, count(*) AS shared FROM (SELECT DISTINCT split, wnid FROM ({_SPL})) a JOIN (SELECT DISTINCT split, wnid FROM ({_SPL})) b ON a.wnid = b.wnid AND a.split < b.split GROUP BY 1, 2")
def class_leakage(spark, d):
    return L.class_leakage(view(spark, d, _SPL), "wnid")


@register(f"SELECT wnid, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(*) AS n FROM ({_SPL}) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_overlap(spark, d):
    return L.overlap(view(spark, d, _SPL), "wnid").select("wnid", F.array_join("splits", ",").alias("splits"), "n")


@register(f"SELECT wnid, count(*) AS n FROM ({V.ITEM}) GROUP BY 1 ORDER BY n DESC, wnid LIMIT 10")
def split_stats(spark, d):
    return A.split_stats(view(spark, d, V.ITEM), "wnid")


_CH = """CASE kind WHEN 0 THEN [class_name, 'cat', 'dog'] WHEN 1 THEN [class_name, 'cat', 'CAT ', 'dog'] WHEN 2 THEN [class_name, '', 'dog', 'bird'] WHEN 3 THEN [class_name, 'a_b', 'dog', repeat('x', 41)] ELSE [class_name, 'cat', 'dog', 'bird'] END"""
_RS = f"""WITH q AS (SELECT *, {_CH} AS choices FROM ({V.QC})), r AS (SELECT seq, id, wnid, class_name, list_filter([CASE WHEN kind = 3 THEN 'choice_contains_forbidden_token' END, CASE WHEN kind = 3 THEN 'choice_too_long' END, CASE WHEN kind = 1 THEN 'duplicate_choices_case_insensitive' END, CASE WHEN kind = 2 THEN 'empty_choice' END,
   CASE WHEN answer_index < 0 OR answer_index >= len(choices) THEN 'invalid_answer_index' END, CASE WHEN kind = 0 THEN 'invalid_choice_count' END], lambda x: x IS NOT NULL) AS rs FROM q),
  f AS (SELECT *, min(CASE WHEN len(rs) = 0 THEN seq END) OVER (PARTITION BY id) AS first FROM r), z AS (SELECT seq, id, wnid, class_name, CASE WHEN seq > first THEN list_sort(list_append(rs, 'duplicate_id')) ELSE rs END AS rs FROM f)"""


def _qc(spark, d):
    k, c = F.col("kind"), F.col("class_name")
    lits = lambda *xs: F.array(c, *(x if not isinstance(x, str) else F.lit(x) for x in xs))
    choices = F.when(k == 0, lits("cat", "dog")).when(k == 1, lits("cat", "CAT ", "dog")).when(k == 2, lits("", "dog", "bird")).when(k == 3, lits("a_b", "dog", "x" * 41)).otherwise(lits("cat", "dog", "bird"))
    return Q.with_duplicates(view(spark, d, V.QC).withColumn("choices", choices).withColumn("reasons", Q.choice_reasons()))


@register(f"{_RS} SELECT seq, array_to_string(rs, ',') AS reasons FROM z")
def qc_reject_reasons(spark, d):
    return _qc(spark, d).select("seq", F.array_join("reasons", ",").alias("reasons"))


@register(f"{_RS} SELECT reason, count(*) AS n FROM (SELECT UNNEST(rs) AS reason FROM z) GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def qc_top_reasons(spark, d):
    return Q.reject_counts(_qc(spark, d))


@register(f"{_RS} SELECT count(*) AS processed, count(*) FILTER (len(rs) = 0) AS accepted, count(*) FILTER (len(rs) > 0) AS rejected, count(DISTINCT wnid) AS classes, count(DISTINCT class_name) FILTER (len(rs) = 0) AS concepts, CAST(count(*) FILTER (len(rs) > 0) AS DOUBLE) / count(*) AS reject_rate FROM z")
def pool_statistics(spark, d):
    return Q.pool_stats(_qc(spark, d))


_ANN = "SELECT l_orderkey AS image_id, l_partkey AS category_id, CAST(l_extendedprice AS DOUBLE) AS area, l_returnflag = 'R' AS iscrowd, l_suppkey * 100000 + l_linenumber * 1000 + CAST(l_quantity AS INT) AS ann_pos FROM lineitem"


@register(f"""WITH a AS (SELECT * FROM ({_ANN}) WHERE NOT iscrowd), p AS (SELECT image_id, count(*) AS n, list_sort(list(DISTINCT category_id)) AS cats, max(area) AS area FROM a GROUP BY 1 HAVING count(*) <= 3)
  SELECT p.image_id, p.area, len(cats) AS n_categories FROM p JOIN (SELECT o_orderkey AS image_id, CAST(CAST(o_totalprice AS INT) AS DOUBLE) * 10 AS px FROM orders) i ON i.image_id = p.image_id WHERE px > 0 AND area >= 0.02 * px""")
def single_label_policy(spark, d):
    images = view(spark, d, "SELECT o_orderkey AS image_id, CAST(rint(o_totalprice) AS INT) AS width, 10 AS height FROM orders")  # DuckDB rounds, Spark cuts off
    return Q.single_label(view(spark, d, _ANN), images, single=False).select("image_id", "area", F.size("categories").cast("bigint").alias("n_categories"))


@register(f"""SELECT item_seq, concat_ws('_', 'pool', 'train', wnid, substr(sha1(image_relpath), 1, 8)) AS item_key, concat('image:', substr(sha256(concat('["pool", "', image_relpath, '"]')), 1, 20)) AS image_id, CAST(concat('0x', substr(sha1(image_relpath), 1, 8)) AS BIGINT) AS path_seed,
  substr(sha256(concat('["', class_name, '", "', superclass, '"]')), 1, 12) AS order_hash, regexp_replace(class_name, '[^a-z0-9]+', '-', 'g') AS slug FROM ({V.ITEM})""")
def stable_ids(spark, d):
    i = view(spark, d, V.ITEM)
    return i.select("item_seq", X.item_key("pool", "image_relpath", "wnid").alias("item_key"), X.stable_id("image", F.lit("pool"), "image_relpath").alias("image_id"), X.path_seed("image_relpath").alias("path_seed"), X.order_hash(F.array("class_name", "superclass")).alias("order_hash"), X.slug("class_name").alias("slug"))


@register(f"SELECT item_seq, concat('Q: What is ', class_name, '?', chr(10), chr(10), '0) ', class_name, chr(10), '1) ', superclass, chr(10), chr(10), 'Reply with a single digit 0, or 1 — nothing else.', chr(10), 'Answer:') AS prompt FROM ({V.ITEM})")
def rendered_prompts(spark, d):
    return view(spark, d, V.ITEM).select("item_seq", X.render_prompt(F.lit("mcq"), F.concat(F.lit("What is "), "class_name", F.lit("?")), F.array("class_name", "superclass")).alias("prompt"))


_METHODS = "SELECT DISTINCT p_brand AS method_id, length(p_brand) + CAST(right(p_brand, 1) AS INT) AS kind FROM part"
_MODELS = "SELECT n_name AS model_id, n_nationkey % 3 AS kind FROM nation"


@register(f"""WITH m AS (SELECT method_id, CASE kind % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['supports_gradients'] WHEN 2 THEN ['supports_weight_updates', 'supports_gradients'] ELSE ['supports_output_filtering'] END AS req FROM ({_METHODS})),
  o AS (SELECT model_id, CASE kind WHEN 0 THEN ['supports_gradients'] WHEN 1 THEN ['supports_output_filtering'] ELSE ['supports_gradients', 'supports_weight_updates', 'supports_output_filtering'] END AS caps FROM ({_MODELS}))
  SELECT method_id, model_id, array_to_string(list_sort(list_filter(req, lambda x: NOT list_contains(caps, x))), ',') AS missing, len(list_filter(req, lambda x: NOT list_contains(caps, x))) = 0 AS supported FROM m CROSS JOIN o""")
def capability_gate(spark, d):
    """Every registered method with every registered model, and what is missing; a capability that is null or stated false is missing."""
    from probeforge.operators.inference import capability_gate as gate

    k = F.col("kind") % 4
    need = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("supports_gradients"))).when(k == 2, F.array(F.lit("supports_weight_updates"), F.lit("supports_gradients"))).otherwise(F.array(F.lit("supports_output_filtering")))
    have = F.create_map(F.lit("supports_gradients"), F.col("kind") != 1, F.lit("supports_weight_updates"), F.when(F.col("kind") == 2, True), F.lit("supports_output_filtering"), F.col("kind") > 0)
    methods = view(spark, d, _METHODS).select("method_id", need.alias("required_capabilities"))
    models = view(spark, d, _MODELS).select("model_id", have.alias("capabilities"))
    return gate(methods, models).select("method_id", "model_id", F.array_join("missing", ",").alias("missing"), "supported")


@register(f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, {_ACC} FROM ({V.STATUS}) GROUP BY 1")
def stream_daily_accounting(spark, d):
    return M.windowed_accounting(view(spark, d, V.STATUS)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, request_id) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM ({V.STATUS} ) x), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) FROM e))
  SELECT user_id, CAST(count(DISTINCT s) AS BIGINT) AS sessions, count(*) AS n FROM g GROUP BY 1""")
def session_activity(spark, d):
    s = M.sessions(view(spark, d, V.STATUS).withColumn("ts", F.col("ts").cast("timestamp")), "user_id", gap="6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@register(f"SELECT count(*) AS requests FROM (SELECT DISTINCT request_id FROM ({V.STATUS}))")
def stream_dedup(spark, d):
    s = view(spark, d, V.STATUS)
    return M.first_requests(s.unionByName(s.where("request_id % 3 = 0"))).agg(F.count("*").alias("requests"))


@register(f"SELECT wnid FROM ({V.ITEM}) GROUP BY 1 HAVING count(*) >= 60")
def eligible_class_pool(spark, d):
    return L.eligible_classes(view(spark, d, V.ITEM), "wnid", 60)


@register("SELECT l_returnflag, l_linenumber AS pos, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) AS rank, n FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def rank_by_count(spark, d):
    g = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", F.col("l_linenumber").alias("pos")).agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("n"), "pos")).cast("bigint"))


_MOVE = f"SELECT item_seq, image_relpath, wnid, class_name, item_seq % 13 AS kind FROM ({V.ITEM})"
_MOVED = f"""SELECT *, CASE kind WHEN 1 THEN 'empty image' WHEN 2 THEN 'no valid answer' WHEN 3 THEN 'target_split conflicts with the split' WHEN 4 THEN 'no concept name' END AS error,
  concat('["r', item_seq, '", "legacy.mcq.identity.v1", "legacy_default", ') AS head, substr(sha256(concat('["', class_name, '", "zebra", "yak"]')), 1, 12) AS options FROM ({_MOVE})"""


def _moved(spark, d):
    k, n = F.col("kind"), F.col("class_name")
    meta = F.when(k == 4, F.create_map(F.lit("note"), F.lit("none"))).when(k == 5, F.create_map(F.lit("class_name"), n)).otherwise(F.create_map(F.lit("forget_concept"), n))
    records = view(spark, d, _MOVE).select(
        "item_seq", F.concat(F.lit("r"), "item_seq").alias("id"), F.when(k == 1, "").otherwise(F.col("image_relpath")).alias("image"), F.lit("What is it?").alias("question"), F.array(n, F.lit("zebra"), F.lit("yak")).alias("choices"),
        F.when(k == 2, 3).otherwise(0).alias("answer_index"), F.lit("identity").alias("forgetting_level"), F.lit("type").alias("concept_axis"), F.when(k == 3, "test_retain").otherwise("all").alias("target_split"), meta.alias("meta"),
    )
    return G.migrate(records, G.Context("pool", "1", "test_forget", "cc", "yes", "made"))


@register(f"""SELECT item_seq, error, CASE WHEN error IS NULL THEN concat('item:', substr(sha256(concat(head, '"normal_image", "', options, '"]')), 1, 20)) END AS item_id,
  CASE WHEN error IS NULL THEN concat('pair:', substr(sha256(concat(head, '"', options, '"]')), 1, 20)) END AS pairing_id, CASE WHEN error IS NULL THEN concat('pool:', regexp_replace(class_name, '[^a-z0-9]+', '-', 'g')) END AS concept_id FROM ({_MOVED})""")
def legacy_migration(spark, d):
    ok = lambda c: F.when(F.col("error").isNull(), c)
    return _moved(spark, d).select("item_seq", "error", ok(F.col("item_id")).alias("item_id"), ok(F.col("metadata")["pairing_id"]).alias("pairing_id"), ok(F.col("concept_id")).alias("concept_id"))


@register(f"SELECT count(*) AS input_count, count(*) FILTER (error IS NULL) AS migrated_count, count(*) FILTER (error IS NOT NULL) AS rejected_count, count(*) FILTER (kind = 5) AS concept_name_from_class_or_synset FROM ({_MOVED})")
def migration_report(spark, d):
    return G.migration_report(_moved(spark, d))


@register(f"SELECT concept_id AS suite, before, after, after / nullif(before, 0) AS retention FROM (SELECT concept_id, {_sh("m0_status = 'correct'")} AS before, {_sh("mu_status = 'correct'")} AS after FROM ({V.PAIR}) GROUP BY 1)")
def general_utility(spark, d):
    p = view(spark, d, V.PAIR)
    side = lambda s: p.select(F.col("concept_id").alias("suite"), F.col(f"{s}_status").alias("response_status"))
    return A.general_utility(side("m0"), side("mu"))


_RUNS = "SELECT n_name AS method, CAST(c_custkey % 97 AS DOUBLE) AS wall_seconds, CAST(c_custkey % 13 AS DOUBLE) AS gpu_hours, CAST(c_custkey % 31 AS DOUBLE) AS inference_latency_ms FROM customer JOIN nation ON c_nationkey = n_nationkey"


@register(f"SELECT method, count(*) AS runs, sum(wall_seconds) AS wall_seconds, sum(gpu_hours) AS gpu_hours, avg(inference_latency_ms) AS mean_latency_ms FROM ({_RUNS}) GROUP BY 1")
def run_costs(spark, d):
    return A.run_costs(view(spark, d, _RUNS), ["method"])


_GATES = "SELECT s_name AS method_id, CAST(s_suppkey % 4 AS INT) AS model_id, s_suppkey % 3 <> 0 AS supported FROM supplier"


@register(f"SELECT model_id, count(*) AS registered, count(*) FILTER (supported) AS supported, {_sh('supported')} AS coverage FROM ({_GATES}) GROUP BY 1")
def capability_coverage(spark, d):
    return N.capability_coverage(view(spark, d, _GATES), ["model_id"])


@register(f"SELECT item_seq, wnid FROM ({V.ITEM}) WHERE superclass = 'asia'")
def unregistered_references(spark, d):
    return Q.unregistered(view(spark, d, V.ITEM), view(spark, d, V.CLASSES).where("superclass <> 'asia'"), "wnid").select("item_seq", "wnid")


_INDIRECT = f"""SELECT item_seq, wnid AS concept_id, class_name AS concept_name, superclass, CASE WHEN item_seq % 3 = 0 THEN 'P2_INDIRECT' ELSE 'P1_DIRECT' END AS probe_family,
  CASE item_seq % 8 WHEN 0 THEN concat('Is this  from ', upper(class_name), '?') WHEN 1 THEN concat('A thing of ', superclass) WHEN 2 THEN concat('Is it ', class_name, '5, or nation-', item_seq % 25, '?')
    WHEN 3 THEN concat('Near the middle_', superclass, ' of x', class_name) WHEN 4 THEN 'In (Middle  East)?' ELSE 'Which one?' END AS question FROM ({V.ITEM})"""


@register(f"""WITH i AS ({_INDIRECT}), r AS (SELECT wnid AS named_id, class_name AS name FROM ({V.CLASSES}) UNION SELECT wnid, superclass FROM ({V.CLASSES})),
  q AS (SELECT item_seq, concept_id, concat(' ', trim(regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS q FROM i WHERE probe_family = 'P2_INDIRECT'), n AS (SELECT named_id, name, concat(' ', trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM r)
  SELECT item_seq, named_id, name, named_id = concept_id AS own FROM q JOIN n ON contains(q.q, n.w)""")
def lexical_leakage(spark, d):
    """Names of all concepts in indirect questions, by whole words."""
    registry = view(spark, d, V.CLASSES).select(F.col("wnid").alias("concept_id"), F.col("class_name").alias("concept_name"), F.array("superclass").alias("concept_aliases"))
    return Q.lexical_leakage(view(spark, d, _INDIRECT), registry, "item_seq")


_WANTED = (("mcq", "normal_image", 130), ("mcq", "no_image", 100), ("short_answer", "shuffled_image", 127), ("matching", "normal_image", 1))


@register(f"""WITH r AS (SELECT DISTINCT concat('c', user_id % 12) AS concept_id FROM events), w AS (SELECT * FROM (VALUES {', '.join(f"('{f}', '{c}', CAST({n} AS BIGINT))" for f, c, n in _WANTED)}) t(question_format, input_condition, wanted)),
  n AS (SELECT concept_id, question_format, input_condition, count(*) AS found FROM ({V.EVID}) GROUP BY ALL)
  SELECT concept_id, question_format, input_condition, wanted, coalesce(found, 0) AS found FROM r CROSS JOIN w LEFT JOIN n USING (concept_id, question_format, input_condition) WHERE coalesce(found, 0) < wanted""")
def count_shortfalls(spark, d):
    """Required cells with too few items; two registered concepts and one format have none."""
    registry = view(spark, d, "SELECT DISTINCT concat('c', user_id % 12) AS concept_id FROM events")
    return Q.count_shortfalls(view(spark, d, V.EVID), registry, list(_WANTED))


@register(f"SELECT item_seq, CASE WHEN rn <= n - 10 THEN 'train_forget' ELSE 'test_forget' END AS split FROM (SELECT item_seq, row_number() OVER (ORDER BY {_h("'7|'", "item_seq")}, item_seq) AS rn, count(*) OVER () AS n FROM ({V.ITEM}) WHERE wnid = 'NATION_7')")
def split_single_target(spark, d):
    return L.split_single(view(spark, d, V.ITEM), "NATION_7", "wnid", "item_seq", None, 10, 7).select("item_seq", "split")


@register(f"SELECT wnid, CASE WHEN rn <= 5 THEN 'forget' WHEN rn <= 17 THEN 'retain' ELSE 'test' END AS split FROM (SELECT wnid, row_number() OVER (ORDER BY {_h("'7|'", "wnid")}, wnid) AS rn FROM ({V.CLASSES}))")
def class_level_split(spark, d):
    return L.class_level_split(view(spark, d, V.CLASSES), "wnid", {"forget": 0.2, "retain": 0.5, "test": 0.3}, 7).select("wnid", "split")


@register(f"SELECT id, count(*) AS n FROM ({V.QC}) GROUP BY 1 HAVING count(*) > 1")
def repeated_item_ids(spark, d):
    return L.repeated_ids(view(spark, d, V.QC), "id")


@register(f"SELECT item_seq, concat(class_name, '|', superclass) AS accepted, concat('item:', substr(sha256(concat('[\"s', item_seq, '\", \"short.v1\", \"v\", \"normal_image\", \"\"]')), 1, 20)) AS item_id FROM ({V.ITEM})")
def short_answer_twins(spark, d):
    items = view(spark, d, V.ITEM).select(
        "item_seq", F.concat(F.lit("s"), "item_seq").alias("sample_id"), F.lit("v").alias("prompt_variant_id"), F.lit("normal_image").alias("input_condition"), F.col("class_name").alias("concept_name"),
        F.array(F.upper("class_name"), F.col("superclass")).alias("concept_aliases"), F.lit("What is it?").alias("question"),
    )
    return S.short_answer_twins(items, "short.v1").select("item_seq", F.array_join("accepted_answers", "|").alias("accepted"), "item_id")


@register(f"SELECT count(*) AS requests, count(*) FILTER (m0_prediction = mu_prediction) AS agree FROM ({V.PAIR})")
def path_agreement(spark, d):
    p = view(spark, d, V.PAIR)
    side = lambda s: p.select(F.col("sample_id").alias("request_id"), F.col(f"{s}_prediction").alias("prediction"))
    return I.agreement(side("m0"), side("mu"))


@register(f"WITH {_ci(f'SELECT avg(CAST(x AS DOUBLE)) AS x FROM ({_CIX}) GROUP BY concept_id', '', 200)} SELECT * FROM ci")
def concept_bootstrap(spark, d):
    e = view(spark, d, V.EVID).where("input_condition = 'normal_image'").select("concept_id", (F.col("response_status") == "correct").cast("double").alias("x"))
    return _rounded(B.concept_bootstrap(e, "concept_id", "x", replicates=200))


@register(f"""WITH i AS ({V.ITEM}), c AS ({V.CLASSES}), {_ring('image_relpath')},
  x AS (SELECT image_relpath, list(class_name) AS others FROM (SELECT * FROM rh UNION ALL SELECT * FROM re) GROUP BY 1)
  SELECT image_relpath AS image, concat_ws('_', 'pool', 'train', wnid, substr(sha1(image_relpath), 1, 8)) AS id, array_to_string(list_sort(list_append(others, class_name)), '|') AS choices, class_name AS answer, '' AS reasons FROM i JOIN x USING (image_relpath)""")
def pool_build(spark, d):
    pool = O.build_pool(view(spark, d, V.ITEM), view(spark, d, V.CLASSES), "pool", "What is it?", 2, 1, seed=7)
    return pool.select("image", "id", F.array_join(F.array_sort("choices"), "|").alias("choices"), F.element_at("choices", F.col("answer_index") + 1).alias("answer"), F.array_join("reasons", ",").alias("reasons"))


@register(f"""WITH i AS (SELECT * FROM ({V.ITEM}) WHERE superclass <> 'asia'), s AS (SELECT * FROM i UNION ALL SELECT * FROM i WHERE item_seq % 40 = 0),
  p AS (SELECT superclass, few, few AND wnid IN ('NATION_0', 'NATION_1', 'NATION_3') AS short FROM s CROSS JOIN (VALUES (true), (false)) f(few))
  SELECT superclass, CASE WHEN short THEN 'insufficient_unique_distractors' ELSE '' END AS reasons, count(*) AS n, CAST(min(CASE WHEN short THEN 3 ELSE 4 END) AS INT) AS n_choices FROM p GROUP BY few, superclass, short""")
def pool_short_items(spark, d):
    """Pools from a dimension of three names (items of these are short of distractors) and from a full one, with samples that come twice."""
    items = view(spark, d, V.ITEM).where("superclass <> 'asia'")
    samples = items.unionByName(items.where("item_seq % 40 = 0"))
    few = view(spark, d, V.CLASSES).where("wnid in ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3')").withColumn("class_name", F.when(F.col("wnid") == "NATION_3", " NATION  2").otherwise(F.col("class_name")))
    out = None
    for dim in (few, view(spark, d, V.CLASSES)):
        pool = O.build_pool(samples, dim, "pool", "What is it?", 2, 1, seed=7).withColumn("superclass", F.col("meta")["superclass"])
        one = pool.groupBy("superclass", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"), F.min(F.size("choices")).alias("n_choices"))
        out = one if out is None else out.unionByName(one)
    return out


_CON = """SELECT concat('i', c_custkey % 1400) AS item_id, concat('s', c_custkey % 700) AS sample_id, 'd' AS dataset_id, concat('im', c_custkey % 900) AS image_id, concat('k', c_nationkey % 9) AS concept_id,
  CASE c_nationkey % 4 WHEN 0 THEN 'train_forget' WHEN 1 THEN 'test_forget' WHEN 2 THEN 'train_retain' ELSE 'utility' END AS split FROM customer"""
_two = lambda rule, key, part: f"SELECT '{rule}' AS rule, {key} AS key FROM t WHERE split LIKE 'train%' OR split LIKE 'test%' GROUP BY 2 HAVING count(DISTINCT split_part(split, '_', {part})) > 1"


@register(f"""WITH t AS ({_CON}) SELECT 'duplicate item_id' AS rule, item_id AS key FROM t GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'sample changes identity', sample_id FROM t GROUP BY 2 HAVING count(DISTINCT concat(dataset_id, '/', image_id, '/', concept_id, '/', split)) > 1
  UNION ALL {_two('sample in train and test', 'sample_id', 1)} UNION ALL {_two('image in train and test', 'image_id', 1)} UNION ALL {_two('concept in forget and retain', 'concept_id', 2)}""")
def dataset_constraints(spark, d):
    return Q.dataset_violations(view(spark, d, _CON), balance=False)


@register(f"SELECT item_seq, CASE condition WHEN 'option_only' THEN '' ELSE 'what?' END AS question, CASE condition WHEN 'normal_image' THEN image_relpath END AS own_image, condition FROM ({V.ITEM}) CROSS JOIN (VALUES ('normal_image'), ('no_image'), ('option_only'), ('shuffled_image')) t(condition)")
def control_variant_fields(spark, d):
    items = view(spark, d, V.ITEM).select(
        "item_seq", F.col("item_seq").cast("string").alias("item_id"), F.col("item_seq").cast("string").alias("sample_id"), F.col("image_relpath").alias("image"), F.concat(F.lit("im"), "item_seq").alias("image_id"), F.col("wnid").alias("concept_id"), F.lit("p").alias("probe_id"), F.lit("P1_DIRECT").alias("probe_family"),
        F.lit("v").alias("prompt_variant_id"), F.lit("mcq").alias("question_format"), F.lit("normal_image").alias("input_condition"), F.lit("what?").alias("question"), F.array("class_name", F.lit("zebra")).alias("choices"), F.lit("d").alias("dataset_id"), F.lit("test_forget").alias("split"),
    )
    own = F.when(F.col("input_condition") == "normal_image", F.col("image"))
    return S.control_variants(items, 7).select("item_seq", "question", own.alias("own_image"), F.col("input_condition").alias("condition"))
