"""The pool, migration, manifests and the command line, on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from probeforge import cli
from probeforge.operators import manifests as N
from probeforge.operators import migration as G
from probeforge.operators import pool as O
from probeforge.schema import CAPABILITIES, ITEM, LEGACY
from probeforge.sources import readers

CLASSES = [("n1", "cat", "pet"), ("n2", "dog", "pet"), ("n3", "fox", "wild"), ("n4", "Fox", "wild"), ("n5", "owl", "wild")]


def samples(spark, rows):
    return spark.createDataFrame(rows, "image_relpath string, wnid string, class_name string, superclass string")


def test_pool(spark):
    classes = spark.createDataFrame(CLASSES, "wnid string, class_name string, superclass string")
    some = [(f"train/{w}/{i}.jpg", w, n, s) for w, n, s in CLASSES for i in range(3)]
    rows = O.build_pool(samples(spark, some), classes, "d", "What is it?", 2, 1).collect()
    assert len(rows) == 15
    for r in rows:  # a class whose name another one shares never stands beside it
        assert r["reasons"] == [] and r["choices"][r["answer_index"]] == r["class_name"] and len({c.lower() for c in r["choices"]}) == 4
        assert r["meta"]["forget_concept"] == r["class_name"]
    few = O.build_pool(samples(spark, some[:1]), classes.where("wnid < 'n3'"), "d", "What is it?", 2, 1).first()
    assert few["reasons"] == ["insufficient_unique_distractors"] and few["choices"] == ["cat", "dog"]
    again = O.build_pool(samples(spark, some[:1] * 2), classes, "d", "What is it?").collect()
    assert len(again) == 2  # the same path twice is the same place in the order
    assert O.accepted(O.build_pool(samples(spark, []), classes, "d", "?")).count() == 0


def test_prebuilt(spark):
    rows = [("train/a/1.jpg", "w", "c", "s", "q?", ["left", "right"], 1, "attribute", "spatial", {"k": "v", "synset": "x"}), ("train/a/2.jpg", "w", "c", "s", "q?", ["left", "LEFT "], 0, "attribute", "spatial", None)]
    df = spark.createDataFrame(rows, "image_relpath string, wnid string, class_name string, superclass string, question string, choices array<string>, answer_index int, forgetting_level string, concept_axis string, extra_meta map<string,string>")
    a, b = O.build_prebuilt(df, "d").orderBy("image").collect()
    assert a["reasons"] == [] and a["meta"] == {"synset": "x", "class_name": "c", "superclass": "s", "forget_concept": "right", "k": "v"}
    assert b["reasons"] == ["duplicate_choices_case_insensitive"] and b["meta"]["forget_concept"] == "left"


def record(i, **changes):
    good = {"id": str(i), "image": f"{i}.jpg", "question": "What is it?", "choices": ["cat", "dog"], "answer_index": i % 2, "forgetting_level": "class", "concept_axis": "identity", "target_split": "all", "meta": {"forget_concept": ["cat", "dog"][i % 2], "synset": ["n1", "n2"][i % 2], "superclass": "pet"}}
    return good | changes


@pytest.mark.parametrize(
    "changes, error",
    [
        ({}, None), ({"meta": {"class_name": "cat"}}, None), ({"meta": {"class_name": "", "synset": "n1"}}, None), ({"choices": None}, "missing required fields: choices"), ({"question": None, "image": None}, "missing required fields: image, question"),
        ({"target_split": "train_forget"}, "target_split conflicts with the split"), ({"target_split": None}, None), ({"answer_index": 2}, "no valid answer"), ({"answer_index": -1}, "no valid answer"), ({"choices": [" ", "dog"]}, "empty answer"),
        ({"meta": {"note": "x"}}, "no concept name"), ({"image": " "}, "empty image"), ({"choices": ["cat", "CAT "]}, "choices must be unique"),
    ],
)
def test_migration(spark, changes, error):
    df = spark.createDataFrame([record(0, **changes)], LEGACY)
    moved = G.migrate(df, G.Context("d", "1", "test_forget", "cc", "yes", "made"))
    r = moved.first()
    assert r["error"] == error
    assert G.migrated_items(moved).schema.names == ITEM.names and G.migrated_items(moved).count() == (error is None) and G.rejections(moved).count() == (error is not None)
    if error is None:
        assert r["concept_id"] == "d:" + r["concept_name"] and r["accepted_answers"] == ["cat"] and r["source"]["record_id"] == "0"


def test_manifests(spark, tmp_path):
    doc = {"schema_version": "1.0.0", "run_id": "r", "created_at": "t", "run_scope": "pilot", "status": "completed"} | {k: dict.fromkeys(v, 1) for k, v in N.MANIFEST_KEYS.items()} | {k: {} for k in ("environment", "eligibility", "artifacts", "failure_counts")}
    assert N.manifest_errors(doc) == []
    assert N.manifest_errors(doc | {"run_scope": "main"}) == ["eligibility lacks manifest_id, manifest_hash, candidate_count, eligible_count"]
    assert N.manifest_errors(doc | {"status": "unsupported"}) and N.manifest_errors(doc | {"cost": None}) == ["cost is no object"]
    m = spark.createDataFrame([({CAPABILITIES[0]: True, "flies": True},)], "capabilities map<string,boolean>").select(N.capability_errors().alias("e")).first()["e"]
    assert "unknown:flies" in m and len(m) == len(CAPABILITIES)
    where = N.write_eligibility(spark.createDataFrame([("cat", True)], "concept_id string, eligible boolean"), str(tmp_path), "Org/Model 2")
    assert where.endswith("/org-model-2") and spark.read.json(where).count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "pool.jsonl").write_text("\n".join(json.dumps(record(i)) for i in range(12)))
    told = ["--input", str(tmp_path / "pool.jsonl"), "--dataset-id", "d", "--source-version", "1", "--license-id", "cc", "--redistribution", "yes", "--provenance-note", "made", "--split", "utility"]
    assert cli.main(["migrate", *told, "--output", str(tmp_path / "items")]) == 0
    report = json.loads((tmp_path / "items.report.json").read_text())
    assert report["input_sha256"] == hashlib.sha256((tmp_path / "pool.jsonl").read_bytes()).hexdigest() and len(report["output_sha256"]) == 64 and report["rejected_count"] == 0
    assert cli.main(["validate", "items", str(tmp_path / "items")]) == 0
    assert cli.main(["validate", "items", str(tmp_path / "items"), "--require-core-controls"]) == 2
    (tmp_path / "pool.jsonl").write_text("\n".join(json.dumps(record(i, **({"image": ""} if i == 3 else {}))) for i in range(12)))
    assert cli.main(["migrate", *told, "--output", str(tmp_path / "items2")]) == 2
    assert cli.main(["migrate", *told, "--output", str(tmp_path / "items3"), "--allow-rejects", "--skip-answer-balance-check"]) == 0
    assert readers.jsonl(spark, str(tmp_path / "items3"), ITEM).count() == 11
    out = str(tmp_path / "splits")
    assert cli.main(["split", "--input", str(tmp_path / "pool.jsonl"), "--out-dir", out, "--forget-class", "cat", "--n-train-per-forget-class", "3", "--n-test-per-forget-class", "2", "--n-retain-train", "2", "--n-retain-test", "1"]) == 0
    assert json.loads((tmp_path / "splits" / "forget_classes.json").read_text())["forget_classes"] == ["cat"]
    stats = json.loads((tmp_path / "splits" / "split_stats.json").read_text())
    assert stats["splits"]["test_forget"] == 2 and stats["splits"]["train_forget"] == 3
    got = {r["split"]: r["n"] for r in spark.read.json(f"{out}/splits").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train_forget": 3, "test_forget": 2, "train_retain": 2, "test_retain": 1}
    assert cli.main(["leakage", "--input", out]) == 0
    assert cli.main(["split", "--input", str(tmp_path / "pool.jsonl"), "--out-dir", out]) == 2
    for model, score in (("a", 0.5), ("b", 0.75)):
        (tmp_path / f"runs/s__{model}").mkdir(parents=True)
        (tmp_path / f"runs/s__{model}/metrics.json").write_text(json.dumps({"score": score, "by_class": {"cat": 1}}))
    assert cli.main(["aggregate", "--results", str(tmp_path / "runs"), "--out", str(tmp_path / "csv"), "--sort-by", "score"]) == 0
    assert [r["model"] for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == ["b", "a"]
    assert cli.main(["aggregate", "--results", str(tmp_path / "runs"), "--out", str(tmp_path / "csv"), "--sort-by", "nothing"]) == 2
    (tmp_path / "m.json").write_text("{}")
    assert cli.main(["validate", "manifest", str(tmp_path / "m.json")]) == 2
