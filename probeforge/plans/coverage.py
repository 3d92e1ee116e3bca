"""More registered queries: text and id functions, checks of specs, prompts, runs of an adapter, shards and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeforge.functions import text as X
from probeforge.operators import accounting as A
from probeforge.operators import eligibility as E
from probeforge.operators import inference as I
from probeforge.operators import manifests as N
from probeforge.operators import quality as Q
from probeforge.operators import sampling as S
from probeforge.operators import scoring as R
from probeforge.plans import views as V
from probeforge.plans.catalogue import _sql, register
from probeforge.plans.views import view
from probeforge.sources.writers import shared_folder, spread, staged
from probeforge.streaming import metrics as M
from probeforge.streaming.state import keyed_state_store, tracked_leakage

_lit = lambda s: "'" + s.replace("'", "''") + "'"
PART = "SELECT p_partkey, p_name, p_type, p_brand FROM part"


@register("SELECT n_name, CAST(concat('0x', substr(sha256(n_name), 1, 8)) AS BIGINT) + 7 AS seed FROM nation")
def class_seeds(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select("n_name", X.class_seed("n_name", 7).alias("seed"))


SENTENCE = """SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN concat('is ', p_name, ' (mostly)') WHEN 1 THEN concat(' is ', p_name) WHEN 2 THEN concat('lives in ', p_name) WHEN 3 THEN concat('can ', p_name)
  WHEN 4 THEN concat('has ', p_name) WHEN 5 THEN concat('have  ', p_name) WHEN 6 THEN concat('eats ', p_name) WHEN 7 THEN concat('tastes ', p_name) WHEN 8 THEN concat('moves ', p_name, ' ') ELSE concat('lives on ', p_name) END AS d FROM part"""
_first = lambda p: f"WHEN regexp_matches(t, '{p}') THEN trim(regexp_extract(t, '{p}', 1))"


@register(f"SELECT p_partkey, CASE {' '.join(map(_first, ('^is\\s+(.+?)\\s*\\(', '^is (.*)$', '^lives\\s+(?:in|on)\\s+(.+)', '^can (.*)$', '^(?:has|have)\\s+(.+)', '^eats (.*)$', '^tastes (.*)$', '^moves (.*)$')))} ELSE t END AS label FROM (SELECT p_partkey, trim(d) AS t FROM ({SENTENCE}))")
def attribute_labels(spark, d):
    return view(spark, d, SENTENCE).select("p_partkey", X.attribute_label("d").alias("label"))


@register(f"SELECT p_partkey, trim(split_part(concat(' ', p_type, ' , ', p_name), ',', 1)) AS synonym, regexp_replace(regexp_replace(trim(concat(p_type, '/ \"', p_brand, '\"? ')), '\\s+', '_', 'g'), '[/\\\\:*?\"<>|'']', '', 'g') AS folder, CASE WHEN p_partkey % 3 = 0 THEN concat('/abs/', p_name) ELSE concat('root/', p_name) END AS path FROM ({PART})")
def names_and_paths(spark, d):
    p = view(spark, d, PART)
    relative = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/abs/"), "p_name")).otherwise(F.col("p_name"))
    return p.select(
        "p_partkey", X.first_synonym(F.concat(F.lit(" "), "p_type", F.lit(" , "), "p_name")).alias("synonym"), X.safe_dirname(F.concat("p_type", F.lit('/ "'), "p_brand", F.lit('"? '))).alias("folder"), X.image_path("root/", relative).alias("path")
    )


@register(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN NULL WHEN 2 THEN p_type WHEN 3 THEN p_name ELSE '' END AS concept FROM ({PART})")
def forget_concepts(spark, d):
    k, none = F.col("p_partkey") % 5, F.lit(None).cast("string")
    own = F.create_map(F.lit("synset"), "p_type", F.lit("class_name"), "p_name")
    meta = F.when(k == 0, F.map_concat(own, F.create_map(F.lit("forget_concept"), "p_brand"))).when(k == 1, F.map_concat(own, F.create_map(F.lit("forget_concept"), none))).when(k == 2, own)
    meta = meta.when(k == 3, F.create_map(F.lit("class_name"), "p_name")).otherwise(F.create_map(F.lit("other"), "p_name"))
    return view(spark, d, PART).select("p_partkey", X.forget_concept(meta).alias("concept"))


DIGITS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat(' ', user_id % 7, ' ') WHEN 1 THEN concat('Answer: ', user_id % 5, '.') WHEN 2 THEN concat('x', user_id % 4) WHEN 3 THEN '12 or 3' WHEN 4 THEN '' ELSE concat(event_type, ' 4 2') END AS t FROM events"""


@register(f"SELECT event_id, CAST(nullif(regexp_extract(trim(t), '\\b([0-3])\\b', 1), '') AS INT) AS digit FROM ({DIGITS})")
def legacy_digits(spark, d):
    return view(spark, d, DIGITS).select("event_id", X.legacy_digit("t").alias("digit"))


THINK = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('<think>', event_type) WHEN 1 THEN concat('<think>', event_type, '</think> 2') WHEN 2 THEN concat('<think>a</think><think>', event_type) ELSE event_type END AS t,
  CASE event_id % 3 WHEN 0 THEN concat('M-', event_type, '-Thinking') WHEN 1 THEN 'm-thinking-2b' ELSE 'm-instruct' END AS m FROM events"""


@register(f"SELECT event_id, event_id % 4 IN (0, 2) AS is_open, CASE WHEN event_id % 4 IN (0, 2) THEN concat(t, '</think>') ELSE t END AS closed, CASE WHEN contains(lower(m), 'thinking') THEN 'thinking' ELSE 'instruct' END AS label FROM ({THINK})")
def think_blocks(spark, d):
    return view(spark, d, THINK).select("event_id", X.open_think("t").alias("is_open"), X.closed_think("t").alias("closed"), X.model_label("m").alias("label"))


CONDITION = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'BASELINE_NORMAL' WHEN 1 THEN 'UNLEARN_SOFT' WHEN 2 THEN 'UNLEARN_MEDIUM' WHEN 3 THEN 'ORACLE_HARD' ELSE 'ORACLE_REVERSE' END AS condition, user_id % 2 = 0 AS is_forget, event_type AS target FROM events"


def _told(template: str, value: str) -> str:
    """SQL of a template with its gap filled."""
    return "concat(" + f", {value}, ".join(map(_lit, template.replace("{0}", "{}").split("{}"))) + ")"


@register(f"""SELECT event_id, concat('Q: which?', chr(10), chr(10), '0) a', chr(10), '1) ', target, chr(10), chr(10),
  coalesce(concat(CASE condition WHEN 'UNLEARN_SOFT' THEN {_told(X.SUPPRESSION['soft'], 'target')} WHEN 'UNLEARN_MEDIUM' THEN {_told(X.SUPPRESSION['medium'], 'target')}
  WHEN 'ORACLE_HARD' THEN CASE WHEN is_forget THEN {_told(X.ORACLE['hard'], 'target')} END WHEN 'ORACLE_REVERSE' THEN CASE WHEN is_forget THEN {_told(X.ORACLE['reverse'], 'target')} END END || chr(10) || chr(10)), ''),
  'Reply with a single digit 0, 1, 2, or 3 — nothing else.', chr(10), 'Answer:') AS prompt FROM ({CONDITION})""")
def legacy_prompts(spark, d):
    return view(spark, d, CONDITION).select("event_id", X.legacy_prompt(F.lit("which?"), F.array(F.lit("a"), "target"), "condition", "is_forget", "target").alias("prompt"))


@register(f"SELECT p_partkey, concat('Q: what?', chr(10), chr(10), {_told(X.SUPPRESSION['soft'], 'p_brand')}, chr(10), chr(10), {_lit(X.SHORT_DIRECTIVE)}) AS soft, CASE WHEN p_partkey % 2 = 0 THEN concat('Q: what?', chr(10), chr(10), {_told(X.ORACLE['hard'], 'p_brand')}, chr(10), chr(10), {_lit(X.SHORT_DIRECTIVE)}) ELSE concat('Q: what?', chr(10), chr(10), {_lit(X.SHORT_DIRECTIVE)}) END AS control FROM ({PART})")
def method_prompts(spark, d):
    items = view(spark, d, PART).select("p_partkey", F.col("p_partkey").cast("string").alias("item_id"), F.lit("short_answer").alias("question_format"), F.lit("what?").alias("question"), F.lit(None).cast("array<string>").alias("choices"), F.col("p_brand").alias("concept_name"), F.when(F.col("p_partkey") % 2 == 0, "test_forget").otherwise("test_retain").alias("split"))
    soft = I.requests(items, "r", I.suppression("soft", own=True)).select("p_partkey", F.col("prompt_text").alias("soft"))
    return soft.join(I.requests(items, "r", I.oracle_control("hard")).select("p_partkey", F.col("prompt_text").alias("control")), "p_partkey")


KEYS = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{"id": 1, "image": null}' WHEN 1 THEN '{"id": 1}' WHEN 2 THEN '{"id": 1, "image": "x", "zoom": 2}' ELSE '{}' END AS raw FROM part"""


@register(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'missing:image' WHEN 2 THEN 'unknown:zoom' ELSE 'missing:id,missing:image' END AS errors FROM ({KEYS})")
def json_key_errors(spark, d):
    return view(spark, d, KEYS).select("p_partkey", F.array_join(Q.key_violations(F.col("raw"), ("id", "image")), ",").alias("errors"))


PROBE = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'P0_CONTROL' WHEN 1 THEN 'P1_DIRECT' WHEN 2 THEN 'P9' ELSE 'P3_ADVERSARIAL' END AS family, CASE WHEN p_partkey % 2 = 0 THEN 'suffix' END AS attack_family, CAST(p_partkey % 4 - 1 AS INT) AS attack_unit_cost FROM part"""


@register(f"SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN family = 'P9' THEN 'unknown family' END, CASE WHEN family = 'P3_ADVERSARIAL' AND attack_family IS NULL THEN 'attack_family is required' END, CASE WHEN family = 'P3_ADVERSARIAL' AND attack_unit_cost < 1 THEN 'attack_unit_cost under 1' END, CASE WHEN attack_unit_cost < 0 THEN 'negative cost' END], lambda x: x IS NOT NULL)), ',') AS errors FROM ({PROBE})")
def probe_spec_errors(spark, d):
    return view(spark, d, PROBE).select("p_partkey", F.array_join(Q.probe_errors(), ",").alias("errors"))


METHOD = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'R2_WHITE_BOX' ELSE 'R0_BLACK_BOX' END AS access_regime, p_partkey % 2 = 0 AS modifies_model_state, CASE p_partkey % 5 WHEN 0 THEN 'no_op' ELSE 'tuned' END AS semantic_label, CASE WHEN p_partkey % 7 = 0 THEN 'supports_magic' ELSE 'supports_logits' END AS need FROM part"""


@register(f"SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN need = 'supports_magic' THEN 'unknown capability' END, CASE WHEN access_regime = 'R2_WHITE_BOX' AND NOT modifies_model_state THEN 'white-box method must modify state' END, CASE WHEN semantic_label = 'no_op' AND modifies_model_state THEN 'no_op must not modify state' END], lambda x: x IS NOT NULL)), ',') AS errors FROM ({METHOD})")
def method_spec_errors(spark, d):
    return view(spark, d, METHOD).withColumn("required_capabilities", F.array("need")).select("p_partkey", F.array_join(Q.method_errors(), ",").alias("errors"))


@register(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'missing:supports_logits,unknown:supports_magic' ELSE '' END AS errors FROM ({PART})")
def capability_map_errors(spark, d):
    odd = F.col("p_partkey") % 3 == 0
    names = F.array(*(F.when(odd & F.lit(c == "supports_logits"), F.lit("supports_magic")).otherwise(F.lit(c)) for c in N.CAPABILITIES))
    capabilities = F.map_from_arrays(names, F.transform(names, lambda _: F.lit(True)))
    return view(spark, d, PART).withColumn("capabilities", capabilities).select("p_partkey", F.array_join(N.capability_errors(), ",").alias("errors"))


ANSWERED = "SELECT event_id AS request_id, CASE WHEN event_id % 2 = 0 THEN 'mcq' ELSE 'short_answer' END AS question_format, CASE event_id % 7 WHEN 0 THEN 'model_error' WHEN 1 THEN 'api_error' END AS error_status, CASE WHEN event_id % 2 = 0 THEN concat('', user_id % 4) ELSE event_type END AS raw_output, CAST(event_id % 4 AS INT) AS answer_index FROM events"


@register(f"SELECT coalesce(error_status, CASE WHEN question_format = 'mcq' THEN CASE WHEN raw_output = CAST(answer_index AS VARCHAR) THEN 'correct' ELSE 'incorrect' END ELSE CASE WHEN raw_output = 'click' THEN 'correct' ELSE 'incorrect' END END) AS response_status, CASE WHEN error_status IS NOT NULL THEN 'none' WHEN question_format = 'mcq' THEN 'mcq_parse' ELSE 'short_answer_alias' END AS scorer_id, count(*) AS n FROM ({ANSWERED}) GROUP BY 1, 2")
def error_passthrough(spark, d):
    rows = view(spark, d, ANSWERED).withColumn("choices", F.when(F.col("question_format") == "mcq", F.array(*map(F.lit, "abcd")))).withColumn("accepted_answers", F.array(F.lit("Click")))
    return R.score_responses(rows).groupBy("response_status", "scorer_id").agg(F.count("*").alias("n"))


_RUN = f"SELECT item_seq, wnid, class_name, CASE WHEN item_seq % 2 = 0 THEN 'test_forget' ELSE 'test_retain' END AS split FROM ({V.ITEM})"


def _run_items(spark, d):
    """MCQ items of one question each, valid rows of the item schema."""
    i = view(spark, d, _RUN)
    text = lambda v: F.lit(v)
    key = F.col("item_seq").cast("string")
    fields = {
        "schema_version": text("1.0.0"), "item_id": key, "sample_id": key, "dataset_id": text("d"), "image_id": F.concat(text("im"), key), "image": F.concat(text("img/"), key), "concept_id": F.col("wnid"), "concept_name": F.col("class_name"),
        "concept_aliases": F.array("class_name"), "forgetting_level": text("instance"), "concept_axis": text("object"), "split": F.col("split"), "probe_id": text("p"), "probe_family": text("P1_DIRECT"), "question_format": text("mcq"),
        "prompt_variant_id": text("v"), "input_condition": text("normal_image"), "question": text("what?"), "choices": F.array(text("zebra"), F.col("class_name")), "accepted_answers": F.array("class_name"), "answer_index": F.lit(1),
        "matched_retain_id": F.lit(None).cast("string"), "source": F.create_map(text("dataset_id"), text("d"), text("record_id"), key, text("version"), text("1")), "license": F.create_map(text("id"), text("x"), text("redistribution"), text("no")),
        "provenance_note": text("made"), "metadata": F.create_map(text("pairing_id"), F.concat(text("pair:"), key)),
    }
    return i.select(*(c.alias(n) for n, c in fields.items()))


@register(f"SELECT wnid AS concept_id, 'correct' AS response_status, '1' AS prediction, count(*) AS n FROM ({_RUN}) GROUP BY 1")
def evaluated_run(spark, d):
    """Items checked, asked, answered by an adapter in batches, checked against its contract, and scored."""
    run = I.evaluate(_run_items(spark, d), I.oracle_adapter(), I.suppression("soft", own=True), "run")
    return run.records.groupBy("concept_id", "response_status", "prediction").agg(F.count("*").alias("n"))


@register(f"SELECT wnid AS concept_id, 'model_error' AS response_status, 'RuntimeError: no model' AS detail, count(*) AS n FROM ({_RUN}) GROUP BY 1")
def failed_run(spark, d):
    run = I.evaluate(_run_items(spark, d), I.failing_adapter(), run_id="run")
    return run.failures.groupBy("concept_id", "response_status", F.col("error_detail").alias("detail")).agg(F.count("*").alias("n"))


@register(f"""SELECT condition, split, count(*) AS n, count(*) AS n_right FROM ({_RUN}) CROSS JOIN (VALUES ('BASELINE_NORMAL'), ('UNLEARN_SOFT'), ('ORACLE_HARD'), ('ORACLE_REVERSE')) t(condition) GROUP BY 1, 2""")
def legacy_condition_run(spark, d):
    out = I.evaluate_conditions(_run_items(spark, d), I.oracle_adapter(), ["BASELINE_NORMAL", "UNLEARN_SOFT", "ORACLE_HARD", "ORACLE_REVERSE"])
    return out.groupBy("condition", "split").agg(F.count("*").alias("n"), F.count_if(F.col("pred_index") == F.col("answer_index")).alias("n_right"))


@register(f"SELECT count(*) AS item_rows, 0 AS bad FROM ({_RUN})")
def item_schema_errors(spark, d):
    items = _run_items(spark, d)
    return items.agg(F.count("*").alias("item_rows"), F.count_if(F.size(Q.item_errors()) > 0).cast("int").alias("bad"))


@register("SELECT event_id, CAST(concat('0x', substr(sha256(concat('shard|', event_id)), 1, 8)) AS BIGINT) % 4 AS shard FROM events")
def shards(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    return S.merge_shards([S.shard(e, k, 4, "event_id").withColumn("shard", F.lit(k).cast("bigint")) for k in range(4)], ["event_id"])


@register("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'view')) WHERE k <= 5")
def head_of_groups(spark, d):
    e = S.only(spark.read.parquet(f"{d}/events.parquet"), ["click", "view"], "event_type")
    return S.head_of(e, ["event_type"], ["ts", "event_id"], 5).select("event_type", "event_id")


@register("SELECT p_name AS path FROM (SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 7) WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 0)")
def missing_images(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return S.missing_images(p, p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("path")), 7, "p_name")


OPTIONS = "SELECT p_partkey, CAST(p_partkey % 3 AS INT) AS answer_index, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 6 END AS n FROM part"


@register(f"SELECT p_partkey, 4 AS n_options, substr('uvwxyz', answer_index + 1, 1) AS answer, CASE n WHEN 4 THEN 'u|v|w|x' END AS unchanged FROM ({OPTIONS})")
def four_options(spark, d):
    o = view(spark, d, OPTIONS).withColumn("options", F.slice(F.array(*map(F.lit, "uvwxyz")), F.lit(1), F.col("n")))
    options, at = S.four_options(F.col("options"), F.col("answer_index"), 7, F.col("p_partkey").cast("string"))
    o = o.withColumns({"four": options, "at": at})
    return o.select("p_partkey", F.size(F.array_distinct("four")).alias("n_options"), F.element_at("four", F.col("at") + 1).alias("answer"), F.when(F.col("n") == 4, F.array_join("four", "|")).alias("unchanged"))


SCORED = "SELECT p_partkey, CAST(p_partkey % 10 AS DOUBLE) / 10 AS a, CAST(p_partkey % 7 AS DOUBLE) / 10 AS b, CAST(p_partkey % 4 AS DOUBLE) / 10 AS c, CAST(p_partkey % 3 AS DOUBLE) / 10 AS d FROM part"


@register(f"""WITH s AS ({SCORED}), u AS (SELECT p_partkey, a AS s, 0 AS i, 'red' AS l FROM s UNION ALL SELECT p_partkey, b, 1, 'blue' FROM s UNION ALL SELECT p_partkey, c, 2, 'Red' FROM s UNION ALL SELECT p_partkey, d, 3, 'green' FROM s),
  f AS (SELECT p_partkey, max(s) AS top, arg_min(lower(l), -s * 100 + i) AS answer FROM u GROUP BY 1)
  SELECT p_partkey, answer FROM f WHERE top >= 0.3""")
def attribute_choices(spark, d):
    s = spread(view(spark, d, SCORED), "p_partkey").select("p_partkey", F.array("a", "b", "c", "d").alias("scores"), F.array(*map(F.lit, ("red", "blue", "Red", "green"))).alias("labels"))
    choices, at = S.attribute_choices("scores", "labels", "size", 7, F.col("p_partkey").cast("string"))
    out = s.withColumns({"choices": choices, "at": at}).where("choices is not null")
    return out.select("p_partkey", F.lower(F.element_at("choices", F.col("at") + 1)).alias("answer"))


def _arrivals(spark, rows, name: str, ts: str, steps: int, late):
    """Runs a stream as its rows arrive: ``rows`` in ``steps`` equal spans of ``ts``, the last with the ``late`` rows; a folder to read after each."""
    base = shared_folder(spark, name)
    rows = staged(rows, "rows", base)
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    if low is None:
        rows.write.parquet(f"{base}/in")
        yield base
        return
    span = (F.unix_micros(ts) - F.unix_micros(F.lit(low))) * steps / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1)
    for i in range(steps):
        some = rows.where(F.floor(span) == i)
        (some.unionByName(late) if i == steps - 1 else some).write.mode("append").parquet(f"{base}/in")
        yield base


def _read_arrivals(spark, rows, base: str, ts: str, delay: str):
    return M.timed(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), ts, delay)


_EVENT_ROWS = f"SELECT request_id, user_id, CAST(ts AS TIMESTAMP) AS ts, response_status FROM ({V.STATUS})"
#: Rows of the first two days arrive again at the end, long past the watermark.
_FIRST_DAYS = "ts < TIMESTAMP '2024-01-03 00:00:00'"
_CLOSED = f"SELECT max(ts) - INTERVAL 6 HOUR FROM ({V.STATUS})"


@register(f"SELECT * FROM ({_sql['stream_daily_accounting']}) WHERE start + INTERVAL 1 DAY <= ({_CLOSED})")
def streamed_daily_accounting(spark, d):
    """The daily accounting by a stream in append mode: days that the watermark has passed; late rows are dropped."""
    rows = view(spark, d, _EVENT_ROWS)
    for base in _arrivals(spark, rows, "daily", "ts", 2, rows.where(_FIRST_DAYS)):
        out = M.run_to_folder(M.windowed_accounting(_read_arrivals(spark, rows, base, "ts", "6 hours")), base)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM ({V.STATUS})),
  s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e), w AS (SELECT user_id, nth, count(*) AS n, max(ts) + INTERVAL 6 HOUR AS over_ FROM s GROUP BY 1, 2)
  SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM w WHERE over_ <= ({_CLOSED}) GROUP BY 1""")
def streamed_sessions(spark, d):
    """Sessions by a stream in append mode: those that the watermark has passed; late rows open none."""
    rows = view(spark, d, _EVENT_ROWS)
    for base in _arrivals(spark, rows, "sessions", "ts", 2, rows.where(_FIRST_DAYS)):
        out = M.run_to_folder(M.sessions(_read_arrivals(spark, rows, base, "ts", "6 hours"), "user_id", gap="6 hours"), base)
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@register(f"SELECT user_id, count(DISTINCT request_id) AS requests FROM ({V.STATUS}) GROUP BY 1")
def streamed_dedup(spark, d):
    """Every third request comes twice, those of the first days once more at the end; keys are forgotten 6 hours after their request."""
    rows = view(spark, d, _EVENT_ROWS)
    for base in _arrivals(spark, rows.unionByName(rows.where("request_id % 3 = 0")), "dedup", "ts", 2, rows.where(_FIRST_DAYS)):
        out = M.run_to_folder(M.first_requests(_read_arrivals(spark, rows, base, "ts", "6 hours")), base)
    return out.groupBy("user_id").agg(F.count("*").alias("requests"))


#: An attack each minute and order, those of one order 90 minutes apart; the watermark is an hour behind, a sample ends after a silent day.
_ATTACK_TIME = "TIMESTAMP '1995-01-01 00:00:00' + l_orderkey * INTERVAL 1 MINUTE + l_linenumber * INTERVAL 90 MINUTE"
_ATTACKS = V.ATTACK.replace("SELECT ", f"SELECT {_ATTACK_TIME} AS ts, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS attack_id, ", 1)
_SILENCE_MS = 86_400_000 + 30_000


@register(f"""WITH a AS (SELECT DISTINCT sample_id, attack_id, response_status, attack_unit_cost, ts FROM ({_ATTACKS})),
  s AS (SELECT sample_id, CASE WHEN bool_or(response_status = 'correct') THEN 'leaked' WHEN bool_or(response_status = 'incorrect') THEN 'contained' ELSE 'unscorable' END AS outcome, CAST(sum(attack_unit_cost) AS BIGINT) AS cost, count(*) AS requests, max(ts) AS latest FROM a GROUP BY 1)
  SELECT sample_id, outcome, cost, requests, latest + INTERVAL 86430 SECOND < (SELECT max(ts) - INTERVAL 1 HOUR FROM a) AS final FROM s""")
def streamed_leakage(spark, d):
    """Outcomes by a stream with a state for each sample, over three runs of one checkpoint; repeated and late attacks change nothing."""
    rows = view(spark, d, _ATTACKS)
    again = rows.unionByName(rows.where("sample_id % 3 = 0"))
    late = rows.where("sample_id % 7 = 0 and ts < TIMESTAMP '1995-01-01 12:00:00'").withColumns({"response_status": F.lit("correct"), "attack_id": F.lit("late")})
    with keyed_state_store(spark):
        for base in _arrivals(spark, again, "leakage", "ts", 3, late):
            out = M.run_updates(tracked_leakage(_read_arrivals(spark, rows, base, "ts", "1 hour"), _SILENCE_MS), base, "sample_id")
    return out


_LM = f"""l AS ({V.LEGACY}), c AS (SELECT split, condition, meta_synset, count(*) AS n, count(*) FILTER (gt_index = pred_index) AS k, count(*) FILTER (pred_index IS NULL) AS i FROM l GROUP BY ALL),
  h AS (SELECT split, condition, pred_index, CAST(count(*) AS DOUBLE) AS n FROM l WHERE pred_index BETWEEN 0 AND 3 GROUP BY ALL), e AS (SELECT split, condition, round(-sum(n / t * log2(n / t)), 4) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY split, condition) AS t FROM h) GROUP BY 1, 2),
  a AS (SELECT split, lower(condition) AS p, CAST(sum(n) AS DOUBLE) AS n, avg(CAST(k AS DOUBLE) / n) AS macro, CAST(sum(k) AS DOUBLE) / sum(n) AS micro, CAST(sum(i) AS DOUBLE) / sum(n) AS invalid, CAST(count(*) AS DOUBLE) AS classes, any_value(entropy) AS entropy FROM c JOIN e USING (split, condition) GROUP BY ALL),
  f AS (SELECT * FROM a WHERE split = 'test_forget'), r AS (SELECT * FROM a WHERE split = 'test_retain'),
  m AS (SELECT p || '__forget_macro_acc' AS key, macro AS value FROM f UNION ALL SELECT p || '__forget_micro_acc', micro FROM f UNION ALL SELECT p || '__forget_K', classes FROM f UNION ALL SELECT p || '__invalid_rate_forget', invalid FROM f
    UNION ALL SELECT p || '__forget_total', n FROM f UNION ALL SELECT p || '__forget_pred_entropy', entropy FROM f UNION ALL SELECT p || '__retain_acc', micro FROM r UNION ALL SELECT p || '__retain_macro_acc', macro FROM r
    UNION ALL SELECT p || '__invalid_rate_retain', invalid FROM r UNION ALL SELECT p || '__retain_total', n FROM r)"""


@register(f"""WITH {_LM} SELECT key, round(value, 9) AS value FROM m UNION ALL SELECT CASE key WHEN 'baseline_normal__forget_macro_acc' THEN 'baseline_forget_macro_acc' WHEN 'baseline_normal__retain_acc' THEN 'baseline_retain_acc'
  WHEN 'oracle_hard__forget_macro_acc' THEN 'oracle_hard_forget_macro_acc' ELSE 'oracle_hard_retain_acc' END, round(value, 9) FROM m WHERE key IN ('baseline_normal__forget_macro_acc', 'baseline_normal__retain_acc', 'oracle_hard__forget_macro_acc', 'oracle_hard__retain_acc')""")
def legacy_metric_document(spark, d):
    return A.legacy_metrics(view(spark, d, V.LEGACY)).select("key", F.round("value", 9).alias("value"))


@register(f"SELECT lower(condition) AS condition, meta_synset AS class, CAST(count(*) FILTER (gt_index = pred_index) AS DOUBLE) / count(*) AS accuracy, count(*) AS total FROM ({V.LEGACY}) WHERE split = 'test_forget' GROUP BY 1, 2")
def legacy_class_metrics(spark, d):
    return A.legacy_class_metrics(view(spark, d, V.LEGACY)).withColumn("condition", F.lower("condition"))


@register(f"WITH g AS ({_sql['eligibility_gate']}) SELECT count(*) AS candidates, count(*) FILTER (eligible) AS eligible, CAST(count(*) FILTER (eligible) AS DOUBLE) / count(*) AS coverage FROM g")
def eligibility_coverage(spark, d):
    """The counts of an eligibility manifest's head."""
    head, _ = E.manifest_document(view(spark, d, V.EVID), dict.fromkeys(E.CONTEXT_KEYS, "x"), with_ci=False)
    return spark.createDataFrame([(head["candidate_count"], head["eligible_count"], head["coverage"])], "candidates long, eligible long, coverage double")
