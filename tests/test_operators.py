"""Hand-computed cases and invariants of the package's own operators."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from probeforge.functions import text as X
from probeforge.operators import accounting as A
from probeforge.operators import eligibility as E
from probeforge.operators import inference as I
from probeforge.operators import pairing as P
from probeforge.operators import quality as Q
from probeforge.operators import sampling as S
from probeforge.operators import scoring as R
from probeforge.operators import splits as L
from probeforge.operators import statistics as B
from probeforge.operators.manifests import manifest_errors
from probeforge.operators.quality import item_errors
from probeforge.schema import ITEM, CapabilityMismatch, ConstraintError, Thresholds, require_none


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_norm_text_and_ids(spark):
    samples = [" A B ", "x  y", "\x1cz\x1f", "Straße", "", "\x85q\t", "é  É", "ﬁn", "a\nb", "ünï"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(X.norm_text("s")).collect()]
    assert got == [" ".join(s.strip().lower().split()) for s in samples]
    ids = [r[0] for r in df.select(X.stable_id("p", "s", F.lit("k"))).collect()]
    assert ids[0] == "p:" + hashlib.sha256(json.dumps([samples[0], "k"], ensure_ascii=False).encode()).hexdigest()[:20]
    assert [r[0] for r in df.where("s = 'Straße'").select(X.slug("s")).collect()] == ["strasse"]


def test_labels_and_digits(spark):
    df = spark.createDataFrame([("is small (compared to pigs)",), ("lives in the forest",), ("can swim",), ("has stripes",), ("eats meat",), ("is brown",), ("odd",)], "s string")
    assert [r[0] for r in df.select(X.attribute_label("s")).collect()] == ["small", "the forest", "swim", "stripes", "meat", "brown", "odd"]
    df = spark.createDataFrame([("The answer is 1.",), ("7",), ("12 3",), ("",)], "s string")
    assert [r[0] for r in df.select(X.legacy_digit("s")).collect()] == [1, None, 3, None]
    assert df.select(X.digit_run(F.lit(4))).first()[0] == "0, 1, 2, or 3"


def test_response_accounting(spark):
    df = spark.createDataFrame([(s,) for s in ["correct"] * 4 + ["incorrect"] * 2 + ["refusal"] * 2 + ["invalid_format", "model_error"]], "response_status string")
    r = rows(A.response_accounting(df))[0]
    assert (r["attempted"], r["scorable"], r["access_rate"], r["coverage"], r["error_rate"]) == (10, 6, 0.4, 0.6, 0.1)
    assert abs(r["conditional_accuracy"] - 4 / 6) < 1e-12
    assert rows(A.response_accounting(df.limit(0)))[0]["access_rate"] is None


def test_leakage(spark):
    data = [("a", "correct", 1), ("a", "refusal", 1), ("b", "incorrect", 2), ("b", "refusal", 1), ("c", "refusal", 1), ("c", "api_error", 1)]
    df = spark.createDataFrame(data, "sample_id string, response_status string, attack_unit_cost int")
    r = rows(A.worst_case_leakage(df))[0]
    assert (r["wcl"], r["leaked"], r["contained"], r["unscorable"], r["attack_budget_spent"]) == (0.5, 1, 1, 1, 7)


def test_pairing(spark):
    kind = "sample_id int, response_status string, prediction string"
    m0 = spark.createDataFrame([(i, "correct" if i < 6 else "incorrect", str(i % 2)) for i in range(10)], kind)
    mu = spark.createDataFrame([(i, "correct" if i < 2 else "incorrect" if i < 8 else "refusal", "0") for i in range(10)], kind)
    p = P.paired(m0, mu, ["sample_id"])
    r = rows(P.forgetting_effect(p))[0]
    assert abs(r["fe_access"] - 0.4) < 1e-12 and r["clean_pairs"] == 8
    t = rows(P.retain_fidelity(p))[0]
    assert (t["kept"], t["lost"], t["gained"], t["output_consistency"]) == (2, 4, 0, 0.5)
    with pytest.raises(ConstraintError):
        P.paired(m0, mu.where("sample_id > 1"), ["sample_id"])
    with pytest.raises(ConstraintError):
        P.paired(m0.unionByName(m0.limit(1)), mu, ["sample_id"])


def test_bootstrap(spark):
    values = [1.0] * 70 + [0.0] * 30
    plain = B.bootstrap_rows(values, 300, seed=5)
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "k string, i int, v double")
    r = rows(B.bootstrap_ci_seeded(df, ["k"], "v", "i", 300, seed=5))[0]
    assert (r["low"], r["high"]) == (plain["low"], plain["high"]) and plain["low"] <= 0.7 <= plain["high"]
    n = rows(B.bootstrap_ci(df, ["k"], "v", 300))[0]
    assert n["low"] < 0.7 < n["high"] and abs(n["low"] - plain["low"]) < 0.04 and n == rows(B.bootstrap_ci(df.repartition(7), ["k"], "v", 300))[0]
    with pytest.raises(ValueError):
        B.bootstrap_rows([])


def evidence(spark, normal=0.9, control=0.25, n=60, formats=("mcq", "short_answer"), drop=None):
    out = []
    for f in formats:
        for c in ("normal_image", "no_image", "option_only", "shuffled_image"):
            if c == drop:
                continue
            right = round(n * (normal if c == "normal_image" else control))
            out += [("c", f, c, f"v{i % 2}", "correct" if i < right else "incorrect", 4 if f == "mcq" else None) for i in range(n)]
    return spark.createDataFrame(out, "concept_id string, question_format string, input_condition string, prompt_variant_id string, response_status string, choice_count int")


@pytest.mark.parametrize(
    ("change", "code"),
    [({}, None), ({"n": 20}, "INSUFFICIENT_SAMPLES"), ({"normal": 0.45, "control": 0.1}, "LOW_NORMAL_ACCESS"), ({"control": 0.8}, "LOW_VISUAL_GAP"), ({"drop": "no_image"}, "MISSING_CONTROL"), ({"normal": 0.3, "control": 0.0}, "CI_BELOW_FLOOR")],
)
def test_eligibility(spark, change, code):
    cells = rows(E.evaluate_cells(evidence(spark, **change), Thresholds(replicates=200)))
    codes = {c for r in cells for c in r["codes"]}
    assert (code in codes) if code else not codes


def test_eligibility_variants_and_choice_count(spark):
    df = evidence(spark).withColumn("response_status", F.when((F.col("prompt_variant_id") == "v1") & (F.rand(1) < 0.6), "incorrect").otherwise(F.col("response_status")))
    assert any("VARIANT_INSTABILITY" in r["codes"] for r in rows(E.evaluate_cells(df, Thresholds(replicates=100))))
    bad = evidence(spark).withColumn("choice_count", F.when(F.col("input_condition") == "no_image", 3).otherwise(F.col("choice_count")))
    with pytest.raises(ConstraintError):
        E.build_manifest(bad)


def test_scorers(spark):
    raws = ["1", "The answer is 1.", "0", "7", "Dog", "I cannot identify this image.", "It's a lovely picture!", "I cannot be sure, but 1."]
    df = spark.createDataFrame([(i, r, ["cat", "dog", "bus", "chair"], 1) for i, r in enumerate(raws)], "i int, raw string, choices array<string>, a int")
    got = [r[0] for r in df.select("i", R.score_mcq("raw", "choices", "a")["response_status"].alias("s")).orderBy("i").select("s").collect()]
    assert got == ["correct", "correct", "incorrect", "invalid_format", "correct", "refusal", "invalid_format", "correct"]
    raws = ["cat", "  CAT ", "Domestic Cat.", "a small tiger", "I'm unable to identify animals.", "   "]
    df = spark.createDataFrame([(i, r, ["cat", "domestic cat"]) for i, r in enumerate(raws)], "i int, raw string, ok array<string>")
    got = [r[0] for r in df.select("i", R.score_short_answer("raw", "ok")["response_status"].alias("s")).orderBy("i").select("s").collect()]
    assert got == ["correct", "correct", "correct", "incorrect", "refusal", "invalid_format"]


def items(spark, concepts=("cat", "dog", "horse"), each=3, fmt="mcq"):
    out = []
    for k, c in enumerate(concepts):
        for j in range(each):
            i = f"{c}{j}"
            out.append(("1.0.0", f"item:{i}", i, "d", f"im:{i}", f"{i}.jpg", c, c, [], "class", "identity", "test_forget", "p1", "P1_DIRECT", fmt, "v1", "normal_image", "What is it?", ["cat", "dog", "horse", "pizza"], [c], k, None, {"dataset_id": "d", "record_id": i, "version": "1"}, {"id": "x", "redistribution": "yes"}, "note", {"pairing_id": f"pair:{i}"}))
    return spark.createDataFrame(out, ITEM)


def test_item_errors(spark):
    good = items(spark)
    require_none(good.select("item_id", Q.item_errors().alias("e")).where(F.size("e") > 0), "items")
    bad = good.withColumns({"image": F.lit(None).cast("string"), "answer_index": F.lit(9)})
    found = bad.select(Q.item_errors().alias("e")).first()["e"]
    assert "image must be non-empty" in found and "answer_index out of range" in found
    with pytest.raises(ConstraintError):
        require_none(Q.dataset_violations(good.unionByName(good), balance=False), "dataset")


def test_derangement_and_controls(spark):
    it = items(spark)
    d = rows(S.derangement(it, 7, ["split"]))
    assert len({r["donor"] for r in d}) == 9 and all(r["concept_id"] != r["donor_concept"] for r in d)
    v = S.control_variants(it, 7)
    assert v.count() == 36 and Counter(r["input_condition"] for r in v.collect()) == dict.fromkeys(("normal_image", "no_image", "option_only", "shuffled_image"), 9)
    with pytest.raises(ConstraintError):
        S.control_variants(items(spark, ("cat",)), 7)


def test_option_balance_and_twins(spark):
    out = rows(S.randomize_options(items(spark, ("cat", "dog"), 4), 3, ["split"]))
    assert all(r["choices"][r["answer_index"]] == r["concept_name"] and sorted(r["choices"]) == ["cat", "dog", "horse", "pizza"] for r in out)
    assert set(Counter(r["answer_index"] for r in out).values()) == {2}
    it = items(spark).withColumn("concept_aliases", F.array(F.lit("CAT"), F.lit("kitty"), F.lit("Kitty ")))
    t = rows(S.short_answer_twins(it, "p2").where("concept_id = 'cat'"))[0]
    assert t["accepted_answers"] == ["cat", "kitty"] and t["choices"] is None


def test_four_options_and_attribute_choices(spark):
    df = spark.createDataFrame([(["a", "b"], 1), (["a", "b", "c", "d"], 2), (["a", "b", "c", "d", "e", "left"], 5)], "o array<string>, a int")
    c, at = S.four_options(F.col("o"), F.col("a"), 3, F.lit("k"))
    for r, (o, a) in zip(df.select(c.alias("c"), at.alias("at")).collect(), [(["a", "b"], 1), (["a", "b", "c", "d"], 2), (["a", "b", "c", "d", "e", "left"], 5)]):
        assert len(r["c"]) == 4 and r["c"][r["at"]] == o[a] and len(set(r["c"])) == 4
    df = spark.createDataFrame([([0.1, 0.9, 0.5, 0.2, 0.9], ["red", "blue", "green", "black", "Blue"])], "s array<double>, l array<string>")
    c, at = S.attribute_choices("s", "l", "color", 1, F.lit("k"))
    r = df.select(c.alias("c"), at.alias("at")).first()
    assert r["c"][r["at"]] == "blue" and sorted(r["c"]) == ["black", "blue", "green", "red"]


def test_round_robin_and_splits(spark):
    df = spark.createDataFrame([(c, f"{c}{i}") for c, n in (("a", 3), ("b", 1), ("c", 2)) for i in range(n)], "c string, p string")
    assert [r["p"] for r in S.round_robin(df, "c", ["p"], 6).collect()] == ["a0", "b0", "c0", "a1", "c1", "a2"]
    classes = spark.createDataFrame([(f"k{i}", f"s{min(i, 2)}") for i in range(9)], "c string, s string")
    assert Counter(r["s"] for r in L.balanced_k(classes, "c", "s", 5, 1).collect()) == {"s0": 1, "s1": 1, "s2": 3}
    pool = spark.createDataFrame([(f"k{i % 9}", i) for i in range(180)], "c string, i int")
    f = L.random_k(classes, "c", 2, 1)
    out = L.split_forget(pool, f, "c", "i", 5, 3, 1).unionByName(L.split_retain(pool, f, "c", "i", 20, 10, 1))
    assert Counter(r["split"] for r in out.collect()) == {"test_forget": 6, "train_forget": 10, "train_retain": 20, "test_retain": 10}
    assert L.repeated_ids(out, "i").count() == 0


def test_first_wins_duplicates(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "a", []), (3, "a", []), (4, "a", ["y"]), (5, "b", [])], "seq int, id string, reasons array<string>")
    got = {r["seq"]: r["reasons"] for r in Q.with_duplicates(df).collect()}
    assert got == {1: ["x"], 2: [], 3: ["duplicate_id"], 4: ["duplicate_id", "y"], 5: []}


def test_run_end_to_end(spark, tmp_path):
    all_items = S.control_variants(items(spark), 7).select([f.name for f in ITEM.fields])  # valid as they are: the donor stands in metadata
    run = I.evaluate(all_items, I.oracle_adapter(), out_dir=str(tmp_path))
    assert run.records.count() == 36 and run.manifest["status"] == "completed"
    written = json.loads((tmp_path / "run_manifest.json").read_text())
    assert written == run.manifest and manifest_errors(written) == [] and set(written["artifacts"]) == {"responses", "results", "failures", "metrics"}
    assert written["cost"]["inference_latency_ms"] >= 0 and run.records.where("latency_ms is null").count() == 0
    again = I.evaluate(all_items.repartition(5), I.oracle_adapter()).manifest
    assert again["data"] == written["data"] and again["artifacts"]["metrics"]["content"] == written["artifacts"]["metrics"]["content"]
    logits = I.score_option_requests(I.requests(all_items, "run"), I.oracle_adapter()).collect()
    assert len(logits) == 36 and {(r["response_status"], r["scorer_id"]) for r in logits} == {("correct", "logit_argmax")}
    with pytest.raises(CapabilityMismatch):
        I.infer_options(I.requests(all_items, "run"), I.failing_adapter())
    assert all(r["response_status"] == "correct" for r in run.records.collect())
    bad = I.evaluate(all_items, I.failing_adapter(), out_dir=str(tmp_path / "b"))
    assert {r["response_status"] for r in bad.records.collect()} == {"model_error"}
    needs = I.Method("grad", required=("supports_gradients",))
    refused = I.evaluate(all_items, I.oracle_adapter(), needs, out_dir=str(tmp_path / "c")).manifest
    assert refused["missing"] == ["supports_gradients"] and manifest_errors(refused) == [] and refused["status"] == "unsupported"
    with pytest.raises(CapabilityMismatch):
        needs.check(I.oracle_adapter())
    out = I.evaluate_conditions(items(spark), I.oracle_adapter(), ["BASELINE_NORMAL", "ORACLE_HARD"])
    assert Counter(r["condition"] for r in out.collect()) == {"BASELINE_NORMAL": 9, "ORACLE_HARD": 9}


def test_registry_names():
    doc = {"datasets": {"d": {"experiments": [{"name": "d_rk10_s42", "k": 1, "seed": 42, "mode": "random_k"}, {"name": "ok_rk2_s1", "k": 2, "seed": 1}]}}}
    assert len(Q.registry_errors(doc)) == 1


def test_percentile_rank():
    v = sorted(random.Random(3).random() for _ in range(11))
    assert B.percentile_rank(v, 0.5) == v[5] and abs(B.percentile_rank(v, 0.25) - (v[2] + v[3]) / 2) < 1e-12


def test_randomized_options(spark):
    """New ids with the new order, the permutation on record, answers balanced; what is no plain MCQ item is refused."""
    base = items(spark)
    out = S.randomize_options(base, 3, ["split"]).collect()
    old = {r["sample_id"]: r for r in base.collect()}
    for r in out:
        own = old[r["sample_id"]]
        assert r["choices"] == [own["choices"][i] for i in r["permutation"]] and r["choices"][r["answer_index"]] == own["choices"][own["answer_index"]]
        assert r["metadata"]["permutation"] == ",".join(map(str, r["permutation"])) and r["metadata"]["permutation_target"] == str(r["answer_index"]) and r["permutation_seed"] == 3
    assert len({r["item_id"] for r in out}) == len(out)
    assert S.randomize_options(base, 3, ["split"]).select("item_id", item_errors().alias("e")).where(F.size("e") > 0).count() == 0
    for bad in (base.withColumn("question_format", F.lit("short_answer")), base.withColumn("input_condition", F.lit("no_image")), base.withColumn("answer_index", F.lit(9))):
        with pytest.raises(ConstraintError):
            S.randomize_options(bad, 3, ["split"])
    with pytest.raises(ConstraintError):
        S.control_variants(base, 3, with_question_only=True)


def test_shards_and_filters(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}", f"n{i % 2}") for i in range(60)], "id long, cls string, name string")
    parts = [S.shard(df, k, 4, "id") for k in range(4)]
    assert sorted(r["id"] for r in S.merge_shards(parts, ["id"]).collect()) == list(range(60))
    with pytest.raises(ConstraintError):
        S.merge_shards([parts[0], parts[0]], ["id"])
    assert {r["id"] for r in S.head_of(df, ["cls"], ["id"], 2).collect()} == {0, 1, 2, 3, 4, 5}
    assert S.only(df, ["c1", "n0"], "cls", "name").where("cls <> 'c1' and name <> 'n0'").count() == 0 and S.only(df, None, "cls").count() == 60
    with pytest.raises(ConstraintError):
        S.only(df, ["zzz"], "cls")


def test_missing_cost(spark):
    df = spark.createDataFrame([("s", "correct", None)], "sample_id string, response_status string, attack_unit_cost int")
    with pytest.raises(Exception, match="missing"):
        A.worst_case_leakage(df).collect()


def test_distractors_ring(spark):
    """Hard ones are of the superclass as far as it has others, nobody gets a class twice or his own, and blocks make no difference."""
    classes = [(f"w{i}", f"name {i % 150}", f"s{i % 7}") for i in range(160)]
    df = spark.createDataFrame([(i, f"w{i % 160}", f"s{i % 160 % 7}") for i in range(400)] + [(999, "stranger", "none")], "item_seq long, wnid string, superclass string")
    dim = spark.createDataFrame(classes + [("lone", "alone", "single")], "wnid string, class_name string, superclass string")
    sup, name = {w: s for w, _, s in classes}, {w: n for w, n, _ in classes}
    got = S.with_distractors(df.unionByName(spark.createDataFrame([(1000, "lone", "single")], df.schema)), dim, 3, 2, 7).collect()
    for r in got:
        hard, easy = ([d for d in r["distractors"] if d["role"] == role] for role in ("hard", "easy"))
        assert len(hard) == 3 and len(easy) == 2 and len({d["wnid"] for d in hard + easy}) == 5
        assert all(d["wnid"] != r["wnid"] and d["class_name"] != name.get(r["wnid"]) for d in hard + easy)
        assert r["wnid"] not in sup or all(sup[d["wnid"]] == r["superclass"] for d in hard)
    assert len({d["wnid"] for r in got for d in r["distractors"]}) > 140


def test_bootstrap_is_close(spark):
    """The interval of Poisson counts against draws with replacement, for counted and for different values."""
    rng = random.Random(5)
    for values in ([float(rng.random() < 0.3) for _ in range(400)], [rng.random() for _ in range(150)]):
        found = B.bootstrap_ci(spark.createDataFrame([("g", v) for v in values], "k string, x double"), ["k"], "x", 800).first()
        want = B.bootstrap_rows(values, 800)
        assert found["n"] == len(values) and abs(found["mean"] - want["mean"]) < 1e-9
        assert abs(found["low"] - want["low"]) < 0.012 and abs(found["high"] - want["high"]) < 0.012


def test_eligibility_head_and_legacy_document(spark):
    df = spark.createDataFrame([("c1", "mcq", "normal_image", "v", "correct", 4)], "concept_id string, question_format string, input_condition string, prompt_variant_id string, response_status string, choice_count int")
    with pytest.raises(ConstraintError):
        E.manifest_document(df, {"model_id": "m"})
    head, concepts = E.manifest_document(df, dict.fromkeys(E.CONTEXT_KEYS, ""), with_ci=False)
    assert (head["candidate_count"], head["eligible_count"], head["coverage"], head["thresholds"]["n_min"]) == (1, 0, 0.0, 50) and concepts.count() == 1
    with pytest.raises(ConstraintError):
        E.manifest_document(df.limit(0), dict.fromkeys(E.CONTEXT_KEYS, ""), with_ci=False)
    legacy = [("test_forget", "BASELINE_NORMAL", "a", 1, 1), ("test_forget", "BASELINE_NORMAL", "a", 1, 2), ("test_forget", "BASELINE_NORMAL", "b", 0, None), ("test_retain", "ORACLE_HARD", "c", 3, 3), ("train_forget", "BASELINE_NORMAL", "a", 1, 1)]
    doc = A.legacy_metric_document(spark.createDataFrame(legacy, "split string, condition string, meta_synset string, gt_index int, pred_index int"), ["a", "b"], "m")
    assert (doc["K"], doc["baseline_normal__forget_macro_acc"], doc["baseline_forget_macro_acc"], doc["baseline_normal__forget_K"], doc["baseline_normal__forget_total"]) == (2, 0.25, 0.25, 2, 3)
    assert doc["baseline_normal__forget_pred_entropy"] == 1.0 and doc["oracle_hard__retain_acc"] == doc["oracle_hard_retain_acc"] == 1.0 and doc["baseline_retain_acc"] is None
    assert doc["baseline_normal__forget_per_class_acc"] == {"a": 0.5, "b": 0.0} and doc["baseline_normal__forget_per_class_total"] == {"a": 2, "b": 1}
