"""What only larger tables show: digests that collide, values at borders, small files of many rows."""

import duckdb
from pyspark.sql import functions as F

from probeforge.operators import pool as O
from probeforge.plans import catalogue


def both(spark, name, folder, **tables):
    """Rows of a query and of its SQL over ``tables``, DuckDB statements written below ``folder``."""
    duck = duckdb.connect()
    for table, sql in tables.items():
        duck.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = duck.execute(f"SELECT * FROM ({catalogue.oracle_sql()[name]})")
    columns = [c[0] for c in want.description]
    got = catalogue.queries()[name](spark, str(folder)).select(*columns)
    return sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


def test_single_label_rounds_sizes(spark, tmp_path):
    """Sizes are rounded as the SQL has them, halves to even; areas lie between the two bounds."""
    orders = "SELECT k AS o_orderkey, p AS o_totalprice FROM (VALUES (1::BIGINT, 1000.6::DOUBLE), (2, 1000.4), (3, 1000.5), (4, 1001.5)) t(k, p)"
    line = "SELECT k AS l_orderkey, k AS l_partkey, k AS l_suppkey, 1 AS l_linenumber, 5::DOUBLE AS l_quantity, a AS l_extendedprice, 'N' AS l_returnflag FROM (VALUES (1::BIGINT, 200.1::DOUBLE), (2, 200.1), (3, 200.1), (4, 200.3)) t(k, a)"
    got, want = both(spark, "single_label_policy", tmp_path, orders=orders, lineitem=line)
    assert got == want and [r[0] for r in got] == [2, 3]


def test_ids_that_collide_keep_their_images(spark):
    """Two images whose paths have the same first 32 bits of SHA-1 are two questions."""
    classes = spark.createDataFrame([(f"n{i}", f"class {i}", "s") for i in range(1, 7)], "wnid string, class_name string, superclass string")
    samples = spark.createDataFrame([(f"train/n1/{i}.jpg", "n1", "class 1", "s") for i in (20811, 31173, 5)], "image_relpath string, wnid string, class_name string, superclass string")
    rows = O.build_pool(samples, classes, "d", "What is it?", 2, 1).collect()
    assert len({r["id"] for r in rows}) == 2 and [r["reasons"] for r in rows] == [[]] * 3
    asked = samples.withColumns({"question": F.lit("q?"), "choices": F.array(F.lit("left"), F.lit("right")), "answer_index": F.lit(1), "forgetting_level": F.lit("attribute"), "concept_axis": F.lit("spatial")})
    assert [r["reasons"] for r in O.build_prebuilt(asked, "d").collect()] == [[]] * 3


def test_small_files_are_dealt_and_choices_made_once(spark):
    from probeforge.operators.sampling import attribute_choices
    from probeforge.sources.writers import spread

    assert spread(spark.range(100, numPartitions=1), "id", rows=10).rdd.getNumPartitions() == 10
    df = spark.createDataFrame([(["red", "Blue", "green", "RED", "tan"], [0.2, 0.9, 0.5, 0.7, 0.1], "k"), (["a", "b", "c", "d"], [0.1] * 4, "k")], "labels array<string>, scores array<double>, k string")
    choices, at = attribute_choices("scores", "labels", "color", 1, F.col("k"))
    made = df.select(choices.alias("choices"), at.alias("at"))
    a, b = made.collect()
    assert a["choices"][a["at"]] == "Blue" and sorted(a["choices"]) == ["Blue", "RED", "green", "tan"] and b["choices"] is None and b["at"] is None
    assert made._jdf.queryExecution().optimizedPlan().toString().count("array_sort") <= 4  # 40 and more if each use sorts anew


def test_percentiles_by_ranges(spark):
    from probeforge.operators.statistics import percentiles

    rows = [(g, float(v % m)) for g, n, m in (("a", 500, 90), ("b", 400, 1), (None, 101, 1000)) for v in range(n)] + [("a", None), ("c", None), ("d", -3.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"low": 0.025, "mid": 0.5, "top": 1.0}
    want = df.where("x is not null").groupBy("g").agg(*(F.percentile("x", F.lit(q)).alias(n) for n, q in shares.items()))
    order = lambda d: sorted(((r["g"] or "", *(round(r[n], 9) for n in shares)) for r in d.collect()))
    assert order(percentiles(df, ["g"], "x", shares, part_values=7)) == order(want)
    assert len(percentiles(df, [], "x", shares, part_values=7).collect()) == 1


def test_scores_in_passes(spark, monkeypatch):
    """A model beyond the limit is met in passes by groups of shards, without shuffling the texts' bigrams."""
    from probeforge.llm import lm_score as S

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(5))  # rows that stand twice
    train = F.col("doc_id") % 5 != 1
    want = sorted(map(tuple, S.lm_scores(docs, train, min_count=1).collect()))
    counts, _ = S.train_counts(docs.where(train).select("text"), 1)
    size, largest = counts.where("shard is not null").agg(F.sum(F.octet_length("words")), F.max(F.octet_length("words"))).first()
    v = counts.where("u is not null").select("u").distinct().count()
    assert size > 2 * largest
    monkeypatch.setattr(S, "_sharded_scores", None)
    got = sorted(map(tuple, S.lm_scores(docs, train, max_bytes=24 * v + 2 * largest, min_count=1).collect()))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-9 * abs(b[4]) and abs(a[5] - b[5]) < 1e-9 * abs(b[5])
