"""Resumable shards, staged rounds of thought, the four legacy ways, and JSON lines with digests."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from probeforge.functions.text import answer_prompt
from probeforge.operators import inference as I
from probeforge.operators import legacy_runs as Y
from probeforge.operators import sharded as H
from probeforge.plans.coverage import _run_items
from probeforge.plans.runs import erring_adapter
from probeforge.schema import CapabilityMismatch, ConstraintError
from probeforge.sources import hashed_lines as J
from tests.conftest import SF


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(_run_items(spark, SF).limit(90).collect(), _run_items(spark, SF).schema).repartition(3)


def counting(adapter, log):
    """The adapter, with a line in ``log`` for each request that a model is asked."""

    def watched(load):
        def loaded():
            model = load()

            def ask(pdf):
                with open(log, "a") as f:
                    f.write("".join(f"{r}\n" for r in pdf["request_id"]))
                return model(pdf)

            return ask

        return loaded if load else None

    return I.Adapter(adapter.name, adapter.capabilities, watched(adapter.load), watched(adapter.score_options), think=watched(adapter.think))


def asked(log):
    found = Counter(log.read_text().split()) if log.exists() else Counter()
    log.write_text("")
    return found


def test_shards_resume(spark, items, tmp_path):
    log, folder, n = tmp_path / "log", f"{tmp_path}/run", 4
    number = {r["item_id"]: r["s"] for r in items.select("item_id", H.shard_of(n, "item_id").alias("s")).collect()}
    failed = H.run_shards(items, counting(erring_adapter(lost_shard=1), log), folder, n)
    assert [tuple(r) for r in failed.collect()] == [(1, "WorkerFailure: device lost")]
    records, metrics, missing = H.reduce_shards(items, folder, n)
    assert missing == [1] and {r["item_id"] for r in records.collect()} == {i for i, s in number.items() if s != 1}
    assert metrics.where("level = 15").first()["attempted"] == sum(s != 1 for s in number.values())
    asked(log)
    assert H.run_shards(items, counting(erring_adapter(), log), folder, n).count() == 0
    assert {r.split("/")[-1] for r in asked(log)} == {i for i, s in number.items() if s == 1}  # only what was left
    records, _, missing = H.reduce_shards(items, folder, n)
    assert missing == [] and records.count() == 90 and H.finished(spark, folder).agg(F.sum("requests")).first()[0] == 90
    assert H.run_shards(items, counting(erring_adapter(), log), folder, n).count() == 0 and not asked(log)


def test_shards_whose_model_does_not_load(spark, items, tmp_path):
    def load():
        raise OSError("no weights")

    failed = H.run_shards(items, I.Adapter("none", {}, load), f"{tmp_path}/run", 3)
    assert {r["failed"] for r in failed.collect()} == {"OSError: no weights"} and failed.count() == 3
    records, _, missing = H.reduce_shards(items, f"{tmp_path}/run", 3)
    assert records.count() == 0 and missing == [0, 1, 2]


def test_thoughts_ask_open_ones_again(spark, items, tmp_path):
    log = tmp_path / "log"
    reqs = Y.conditioned(items, ["BASELINE_NORMAL"])
    got = Y.thoughts(reqs, counting(erring_adapter(), log), rounds=3)
    rows = {r["request_id"].split("/")[-1]: r for r in got.collect()}
    calls = {r.split("/")[-1]: n for r, n in asked(log).items()}
    for k, r in rows.items():
        rounds = {0: 2, 1: 3}.get(int(k) % 5, 1)
        assert r["rounds"] == rounds == calls[k] and r["thought"].endswith("</think>") and r["think_error"] is None
    with pytest.raises(CapabilityMismatch):
        Y.thoughts(reqs, I.oracle_adapter())


@pytest.mark.parametrize("way", Y.PATHS)
def test_legacy_ways(spark, items, tmp_path, way):
    log = tmp_path / "log"
    files = items.where("item_id % 17 <> 0").select(F.col("image").alias("path"))
    out = Y.legacy_records(items, counting(I.oracle_adapter() if way != "thinking" else erring_adapter(), log), ["BASELINE_NORMAL", "ORACLE_HARD"], way, files=files)
    rows = out.collect()
    out.count(), out.where("is_correct").count()
    calls = asked(log)
    assert list(out.columns) == list(Y.RECORD) and len(rows) == 180
    retain = [r for r in rows if r["split"] == "test_retain"]
    assert len({(r["id"], r["pred_index"], r["raw_output"], r["error"]) for r in retain}) == len(retain) / 2  # the baseline's own records
    lost = [r for r in rows if int(r["id"]) % 17 == 0]
    assert lost and all(r["is_invalid"] and r["error"] == f"image_not_found: img/{r['id']}" and r["raw_output"] == "" for r in lost)
    if way != "thinking":
        assert all(n == 1 for n in calls.values()) and len(calls) == len({(r["id"], r["condition"]) for r in rows if r["split"] == "test_forget" or r["condition"] == "BASELINE_NORMAL"} - {(r["id"], r["condition"]) for r in lost})
        assert all(r["is_correct"] for r in rows if int(r["id"]) % 17)
    with pytest.raises(ValueError):
        Y.legacy_records(items, I.oracle_adapter(), ["BASELINE_NORMAL"], "nothing")


def test_prompts_never_end_inside_a_thought(spark, items):
    texts = ["foo<think>\n", "a<think>reasoning", "x<think>\n</think>\n\n", "plain\n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(answer_prompt("t")).collect()]
    assert got == [texts[0] + "</think>\n\n", texts[1] + "</think>\n\n", *texts[2:]]
    with pytest.raises(ConstraintError, match="open think block"):
        Y._scored_options(items.withColumns({"request_id": F.col("item_id"), "prompt_text": F.lit("<think>")}), I.oracle_adapter(), 4)


def test_hashed_lines(spark, tmp_path):
    path, df = f"{tmp_path}/out", spark.range(1000).select("id", F.concat(F.lit("é\n"), "id").alias("t"), F.array("id").alias("a")).repartition(5)
    told = J.write_hashed_lines(df, path)
    for p in told["parts"]:
        data = (tmp_path / "out" / p["file"]).read_bytes()
        assert (hashlib.sha256(data).hexdigest(), len(data), data.count(b"\n")) == (p["sha256"], p["bytes"], p["rows"])
    assert told["rows"] == 1000 and len(told["parts"]) == 5 and sorted(J.read_hashed_lines(df, path).collect()) == sorted(df.collect())
    before = {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()}
    bad = spark.range(1000).repartition(5).select("id", F.when(F.col("id") == 777, F.raise_error(F.lit("lost"))).cast("string").alias("t"), F.array("id").alias("a"))
    with pytest.raises(Exception, match="lost"):
        J.write_hashed_lines(bad, path)
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == before  # nothing half written, the old lines stand
    told = J.write_hashed_lines(df.limit(3), path)
    assert told["rows"] == 3 and J.read_hashed_lines(df, path).count() == 3
    assert J.write_hashed_lines(df.limit(0), path)["rows"] == 0 and J.read_hashed_lines(df, path).count() == 0
    assert json.loads((tmp_path / "out" / J.PARTS).read_text()) == []


def test_a_run_s_artifacts(spark, items, tmp_path):
    run = I.evaluate(items, erring_adapter(), out_dir=f"{tmp_path}/r")
    doc = json.loads((tmp_path / "r" / "run_manifest.json").read_text())
    for name in ("responses", "results", "failures", "metrics"):
        digest = [hashlib.sha256((tmp_path / "r" / name / p["file"]).read_bytes()).hexdigest() for p in doc["artifacts"][name]["parts"]]
        assert hashlib.sha256("".join(digest).encode()).hexdigest() == doc["artifacts"][name]["sha256"]
    assert doc["artifacts"]["results"]["rows"] == 90 and doc["artifacts"]["failures"]["rows"] == run.failures.count() > 0


def test_method_hooks(spark, items):
    assert I.NO_OP.metadata() == {"method_id": "no_op", "semantic_label": "no_op", "required_capabilities": [], "hooks": []} and I.NO_OP.applied(I.oracle_adapter()).load is not None
    with pytest.raises(ValueError):
        I.suppression("soft")
    with pytest.raises(ValueError):
        I.suppression("soft", [])
    assert I.suppression("soft", ["b", "a"]).metadata()["concepts"] == ["a", "b"]
    seen = []

    def prepare(forget, retain):
        seen.append((forget.count(), retain))
        return "x"

    method = I.Method("m", "control", prepare=prepare, intervene=lambda model, given: lambda pdf: [given + a for a in model(pdf)], transform_output=lambda c: F.regexp_replace(c, "x", ""), about={"k": 1})
    run = I.evaluate(items, I.oracle_adapter(), method, training=(items.limit(3), None))
    assert seen == [(3, None)] and run.records.where("response_status = 'correct'").count() == 90
    assert run.manifest["method"]["hooks"] == ["prepare", "intervene", "transform_output"] and run.manifest["method"]["k"] == 1
    # an error has no output to change
    run = I.evaluate(items, I.failing_adapter(), I.Method("m", transform_output=lambda c: F.lit("1")))
    assert run.records.where("response_status = 'model_error' and raw_output is null").count() == 90


def test_adapters_by_model_id():
    I.register_adapter("internvl", lambda model_id, revision="": I.Adapter(model_id, {"supports_logits": False}, lambda: None, revision=revision))
    I.register_adapter("vl", lambda model_id, **_: I.Adapter("other", {}, lambda: None))
    found = I.create_adapter("OpenGVLab/InternVL3-2B", revision="deadbeef")
    assert (found.name, found.revision, found.capabilities) == ("OpenGVLab/InternVL3-2B", "deadbeef", {"supports_logits": False})
    assert I.create_adapter("Qwen/Qwen3-VL-4B").name == "other" and I.create_adapter("an oracle").name == "oracle"
    with pytest.raises(ValueError, match="no adapter"):
        I.create_adapter("nothing known")


def test_eligibility_head_is_written(spark, tmp_path):
    from probeforge.operators.manifests import write_eligibility

    concepts = spark.createDataFrame([("cat", True, []), ("dog", False, ["mcq:X"])], "concept_id string, eligible boolean, codes array<string>")
    head = {"candidate_count": 2, "eligible_count": 1, "created_at": "now"}
    where = write_eligibility(concepts, str(tmp_path), "Org/Model 2", head)
    doc = json.loads((tmp_path / "eligible_concepts" / "org-model-2.json").read_text())
    assert doc["eligible_count"] == 1 and doc["concepts"]["rows"] == 2 and len(doc["manifest_hash"]) == 64
    again = write_eligibility(concepts.repartition(3), str(tmp_path / "b"), "Org/Model 2", head | {"created_at": "later"})
    assert json.loads((tmp_path / "b" / "eligible_concepts" / "org-model-2.json").read_text())["manifest_hash"] == doc["manifest_hash"] and where != again
