"""Portable views over the driver's tables: each statement runs unchanged in Spark SQL and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ITEM = """SELECT c_custkey AS item_seq, concat('train/', n_name, '/', c_custkey, '.jpg') AS image_relpath,
       n_name AS wnid, replace(lower(n_name), '_', ' ') AS class_name, lower(r_name) AS superclass
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
CLASSES = """SELECT n_name AS wnid, replace(lower(n_name), '_', ' ') AS class_name, lower(r_name) AS superclass FROM nation JOIN region ON n_regionkey = r_regionkey"""
STATUS = """SELECT event_id AS request_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'click' THEN 'incorrect'
       WHEN 'view' THEN 'refusal' WHEN 'signup' THEN 'invalid_format' ELSE 'model_error' END AS response_status FROM events"""
EVID = """SELECT event_id AS request_id, concat('c', user_id % 10) AS concept_id,
       CASE WHEN event_id % 2 = 0 THEN 'mcq' ELSE 'short_answer' END AS question_format,
       CASE CAST(floor(event_id / 2) AS BIGINT) % 4 WHEN 0 THEN 'normal_image' WHEN 1 THEN 'no_image' WHEN 2 THEN 'option_only' ELSE 'shuffled_image' END AS input_condition,
       concat('v', CAST(floor(event_id / 8) AS BIGINT) % 2) AS prompt_variant_id,
       CASE WHEN value < CASE CAST(floor(event_id / 2) AS BIGINT) % 4 WHEN 0 THEN 40 + 12 * (user_id % 10) ELSE 10 END THEN 'correct'
            WHEN event_type = 'error' THEN 'model_error' WHEN event_type = 'view' THEN 'refusal' ELSE 'incorrect' END AS response_status,
       CASE WHEN event_id % 2 = 0 THEN 4 END AS choice_count FROM events"""
PAIR = """SELECT o_orderkey AS sample_id, concat('c', o_custkey % 10) AS concept_id, o_custkey,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'correct' WHEN '2' THEN 'correct' WHEN '3' THEN 'incorrect' WHEN '4' THEN 'refusal' ELSE 'invalid_format' END AS m0_status,
       CASE WHEN o_orderstatus = 'P' THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'correct' WHEN '2' THEN 'correct' WHEN '3' THEN 'incorrect' WHEN '4' THEN 'refusal' ELSE 'invalid_format' END
            WHEN o_orderstatus = 'F' THEN CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 'correct' ELSE 'incorrect' END ELSE 'refusal' END AS mu_status,
       CASE o_orderkey % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' ELSE 'refusal' END AS acq_status,
       CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN o_custkey % 4 END AS m0_prediction,
       CASE WHEN o_orderstatus = 'P' THEN o_custkey % 4 WHEN o_orderstatus = 'F' THEN o_orderkey % 4 END AS mu_prediction FROM orders"""
ATTACK = """SELECT l_orderkey AS sample_id, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' AND l_quantity < 10 THEN 'correct' WHEN l_returnflag = 'N' AND l_quantity > 35 THEN 'incorrect'
       WHEN l_linestatus = 'F' THEN 'refusal' ELSE 'invalid_format' END AS response_status, l_linenumber AS attack_unit_cost FROM lineitem"""
LEGACY = """SELECT CASE l_linestatus WHEN 'F' THEN 'test_forget' ELSE 'test_retain' END AS split,
       CASE l_returnflag WHEN 'N' THEN 'BASELINE_NORMAL' WHEN 'A' THEN 'UNLEARN_SOFT' ELSE 'ORACLE_HARD' END AS condition,
       concat('k', l_partkey % 8) AS meta_synset, l_partkey % 4 AS gt_index,
       CASE WHEN l_suppkey % 5 = 4 THEN NULL WHEN l_quantity < 20 THEN l_partkey % 4 ELSE l_suppkey % 5 END AS pred_index FROM lineitem"""
RAW = """SELECT doc_id AS request_id, doc_id % 4 AS answer_index, lang,
       CASE doc_id % 8 WHEN 0 THEN concat('The answer is ', doc_id % 6) WHEN 1 THEN 'I cannot identify this image.' WHEN 2 THEN concat(' ', upper(lang), ' ') WHEN 3 THEN ''
            WHEN 4 THEN concat('I cannot be sure, but ', doc_id % 4, '.') WHEN 5 THEN lang WHEN 6 THEN 'I am unable to say' ELSE substr(source, 1, 40) END AS raw_output FROM documents"""
QC = """SELECT c_custkey AS seq, concat('id', c_custkey % 900) AS id, n_name AS wnid, replace(lower(n_name), '_', ' ') AS class_name, c_custkey % 7 AS kind, c_custkey % 5 - (CASE WHEN c_custkey % 11 = 0 THEN 5 ELSE 0 END) AS answer_index
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the tables it names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)
