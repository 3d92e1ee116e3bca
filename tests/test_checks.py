"""Phrases by whole words, the exact binomial tail, water-filling and dense grids, against brute force."""

import math
import random
from collections import Counter
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from probeforge.operators import pairing as P
from probeforge.operators import quality as Q
from probeforge.operators import splits as L
from probeforge.schema import ConstraintError


def exact(b, c):
    """By whole numbers, from the largest term down."""
    getcontext().prec = 40
    k, n = min(b, c), b + c
    if not n:
        return None
    term = total = math.comb(n, k)
    for i in range(k, 0, -1):
        term = term * i // (n - i + 1)
        total += term
    return float(min(Decimal(1), 2 * Decimal(total) / Decimal(2) ** n))


def test_exact_p(spark):
    rng = random.Random(1)
    pairs = [(b, c) for b in range(12) for c in range(12)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(0, 900), (1, 1200), (2000, 2100), (9000, 9500), (15, 16), (16, 17)]
    got = spark.createDataFrame(pairs, "b long, c long").select("b", "c", P.exact_p(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        want = exact(r["b"], r["c"])
        assert r["p"] == want is None or abs(r["p"] - want) <= 1e-12 * want, tuple(r)
    # a million draws, against the sum of the terms' logarithms by differences that stay small
    b, c = 499_000, 501_000
    log = -0.5 * math.log(math.pi * 500_000) - 1 / 4_000_000 + math.fsum(math.log((500_000 - j) / (500_001 + j)) for j in range(1000))
    term, total = 1.0, 1.0
    for i in range(b, b - 12_000, -1):
        term *= i / (b + c - i + 1)
        total += term
    p = spark.range(1).select(P.exact_p(F.lit(b), F.lit(c))).first()[0]
    assert abs(p - 2 * total * math.exp(log)) < 1e-12
    assert spark.range(1).select(P.exact_p(F.lit(500_000), F.lit(500_000))).first()[0] == 1.0


def test_named_phrases(spark):
    registry = spark.createDataFrame([("c1", "cat", ["house cat", "CAT"]), ("c2", "sea  lion", None), ("c3", "--", []), ("c4", "lion", [None, ""])], "concept_id string, concept_name string, concept_aliases array<string>")
    texts = ["We concatenate.", "A CAT, a sea-lion!", "house Cat; house", None, "", "sea of lions", "sea lion sea lion", "élan cat"]
    rows = [(i, "c1", "P2_INDIRECT", t) for i, t in enumerate(texts)] + [(99, "c1", "P1_DIRECT", "cat"), (100, None, "P2_INDIRECT", "lion")]
    items = spark.createDataFrame(rows, "item_id int, concept_id string, probe_family string, question string").withColumn("name", F.lit("clash"))
    got = Q.lexical_leakage(items, registry)
    assert got.columns == ["item_id", "named_id", "name", "own"]
    assert sorted(map(tuple, got.collect())) == sorted(
        [(1, "c1", "CAT", True), (1, "c1", "cat", True), (1, "c2", "sea  lion", False), (1, "c4", "lion", False), (2, "c1", "cat", True), (2, "c1", "CAT", True), (2, "c1", "house cat", True), (6, "c2", "sea  lion", False), (6, "c4", "lion", False), (7, "c1", "cat", True), (7, "c1", "CAT", True), (100, "c4", "lion", False)]
    )
    assert Q.lexical_leakage(items, registry.limit(0)).count() == 0


def brute_levels(sizes, k):
    out = Counter()
    while k:
        open_ = [s for s in sizes if out[s] < sizes[s]]
        if k < len(open_):
            return out, k, set(open_)
        for s in open_:
            out[s] += 1
        k -= len(open_)
    return out, 0, set()


def test_balanced_allocation(spark):
    rng = random.Random(2)
    for _ in range(12):
        sizes = {f"s{i}": rng.choice([1, 2, 3, 7, 20]) for i in range(rng.randrange(1, 7))}
        classes = spark.createDataFrame([(f"{s}-{i}", s) for s, n in sizes.items() for i in range(n)], "c string, s string")
        k = rng.randrange(sum(sizes.values()) + 1)
        base, left, open_ = brute_levels(sizes, k)
        got = {r["s"]: r for r in L.balanced_allocation(classes, "s", k, 5).collect()}
        assert {s: r["capacity"] for s, r in got.items()} == sizes and sum(r["allocated"] for r in got.values()) == k
        more = {s for s, r in got.items() if r["allocated"] != base[s]}
        assert more <= open_ and len(more) == left and all(got[s]["allocated"] == base[s] + 1 for s in more)
        assert Counter(r["s"] for r in L.balanced_k(classes, "c", "s", k, 5).collect()) == Counter({s: r["allocated"] for s, r in got.items() if r["allocated"]})
    with pytest.raises(ConstraintError, match="asked for"):
        L.balanced_k(classes, "c", "s", 1000, 5)
    with pytest.raises(ConstraintError, match="asked for"):
        L.random_k(classes, "c", 1000, 5)


def test_count_shortfalls(spark):
    items = spark.createDataFrame([("a", "mcq", "normal_image")] * 3 + [("b", "mcq", "no_image"), (None, "mcq", "no_image"), ("z", "mcq", "no_image")], "concept_id string, question_format string, input_condition string")
    registry = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "concept_id string")
    got = Q.count_shortfalls(items, registry, [("mcq", "normal_image", 3), ("mcq", "no_image", 1)])
    assert sorted(map(tuple, got.collect())) == [("a", "mcq", "no_image", 1, 0), ("b", "mcq", "normal_image", 3, 0), ("c", "mcq", "no_image", 1, 0), ("c", "mcq", "normal_image", 3, 0)]


def test_attribute_padding_and_preconditions(spark, tmp_path):
    import json

    from probeforge.operators import sampling as S
    from probeforge.sources import readers, writers

    rows = [("a", [0.9, 0.5], ["Red", "blue"]), ("b", [0.2], ["x"]), ("c", [0.9], ["Small"])]
    df = spark.createDataFrame(rows, "k string, s array<double>, l array<string>")
    c, at = S.attribute_choices("s", "l", "color", 1, F.col("k"), pool=F.array(*map(F.lit, ("RED", "Blue", "green", "oval", "long"))))
    got = {r["k"]: r for r in df.select("k", c.alias("c"), at.alias("at")).collect()}
    assert sorted(got["a"]["c"]) == ["Red", "blue", "green", "oval"] and got["a"]["c"][got["a"]["at"]] == "Red" and got["b"]["c"] is None
    assert sorted(got["c"]["c"]) == ["Blue", "RED", "Small", "green"]
    c, _ = S.attribute_choices("s", "l", "size", 1, F.col("k"))
    assert sorted(df.where("k = 'c'").select(c.alias("c")).first()["c"]) == ["Small", "huge", "tiny", "very large"]
    item = spark.createDataFrame([("s1", "short_answer", "normal_image"), ("s2", "mcq", "normal_image")], "sample_id string, question_format string, input_condition string")
    with pytest.raises(ConstraintError, match="short_answer_twins"):
        S.short_answer_twins(item, "p")
    items = spark.createDataFrame([("test_forget", "b"), ("test_forget", "a"), ("test_forget", ""), ("train_forget", "c")], "split string, forget_concept string")
    (tmp_path / "f.json").write_text('["z", "y"]')
    assert readers.resolved_forget_classes(items) == ["a", "b"] and readers.resolved_forget_classes(items, ["q"]) == ["q"]
    assert readers.resolved_forget_classes(items, ["q"], path=str(tmp_path / "f.json")) == ["y", "z"]
    with pytest.raises(ConstraintError, match="forget classes"):
        readers.resolved_forget_classes(items.where("split = 'none'"))
    pool = spark.createDataFrame([(1, []), (2, ["bad"]), (3, ["bad", "worse"])], "id int, reasons array<string>")
    writers.write_pool(pool, str(tmp_path / "pool"))
    assert json.loads((tmp_path / "pool" / "stats.json").read_text()) == {"processed": 3, "accepted": 1, "rejected": 2, "reject_rate": 2 / 3, "top_reasons": {"bad": 2, "worse": 1}}
