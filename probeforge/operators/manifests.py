"""Run manifests and registries: small driver-side documents, and what is counted over many of them."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeforge.schema import CAPABILITIES, RUN_STATUSES, VERSION
from probeforge.sources.hashed_lines import write_hashed_lines
from probeforge.sources.writers import write_document

#: The keys that each block of a run manifest must have.
MANIFEST_KEYS = {
    "repository": ("url", "git_sha", "dirty"),
    "data": ("benchmark_version", "dataset_version", "dataset_hash", "split_hash", "concept_registry_hash", "probe_bank_hash", "prompt_bank_hash"),
    "model": ("model_id", "model_revision", "processor_revision", "loader", "chat_template"),
    "method": ("method_id", "method_version", "config_hash"),
    "capability_validation": ("supported", "missing_capabilities"),
    "seeds": ("data_selection", "option_order", "controls", "inference", "training"),
    "inference": ("decoding", "dtype", "device"),
    "training": ("steps", "updated_parameter_count", "updated_parameter_fraction", "tuning_budget"),
    "cost": ("wall_seconds", "gpu_hours", "peak_memory_bytes", "inference_latency_ms"),
}
#: Eligibility keys of runs of scope main, and the scopes.
MAIN_KEYS = ("manifest_id", "manifest_hash", "candidate_count", "eligible_count")
SCOPES = ("pilot", "main")


def manifest_errors(doc: dict) -> list[str]:
    """Errors of one run manifest, empty if it is valid."""
    errors = [f"schema_version is not {VERSION}"] if doc.get("schema_version") != VERSION else []
    errors += [f"{k} is empty" for k in ("run_id", "created_at") if not str(doc.get(k) or "").strip()]
    errors += [f"{k} is no known value" for k, known in (("run_scope", SCOPES), ("status", RUN_STATUSES)) if doc.get(k) not in known]
    blocks = dict(MANIFEST_KEYS)
    if doc.get("run_scope") == "main":
        blocks["eligibility"] = MAIN_KEYS
    for name in dict.fromkeys([*blocks, "environment", "eligibility", "artifacts", "failure_counts"]):
        block = doc.get(name)
        lacks = [k for k in blocks.get(name, ()) if k not in block] if isinstance(block, dict) else None
        if lacks is None or lacks:
            errors.append(f"{name} is no object" if lacks is None else f"{name} lacks {', '.join(lacks)}")
    gate = doc.get("capability_validation")
    if doc.get("status") == "unsupported" and isinstance(gate, dict) and (gate.get("supported") is not False or not gate.get("missing_capabilities")):
        errors.append("an unsupported run must state what it lacks")
    return errors


def capability_errors(capabilities: str = "capabilities") -> Column:
    """``missing:k`` and ``unknown:k`` of a model's capability map."""
    known, have = F.array(*map(F.lit, CAPABILITIES)), F.map_keys(capabilities)
    lacks, more = F.array_except(known, have), F.array_except(have, known)
    return F.concat(F.transform(lacks, lambda k: F.concat(F.lit("missing:"), k)), F.transform(more, lambda k: F.concat(F.lit("unknown:"), k)))


def capability_coverage(gate: DataFrame, keys: list[str] = []) -> DataFrame:
    """How many registered (method, model) combinations are supported."""
    n = F.count_if("supported")
    return gate.groupBy(*keys).agg(F.count("*").alias("registered"), n.alias("supported"), F.try_divide(n.cast("double"), F.count("*").cast("double")).alias("coverage"))


def write_eligibility(manifest: DataFrame, path: str, model_revision: str, head: dict | None = None) -> str:
    """The eligible concepts of a model revision, a folder of JSON lines below ``path``; gives its name.

    With ``head`` (of ``eligibility.manifest_document``) also ``<name>.json``: the head with the rows and SHA-256 of the concepts and, as
    manifest_hash, the SHA-256 of all that but the time of creation.
    """
    name = re.sub(r"[^a-z0-9]+", "-", model_revision.casefold()).strip("-")
    where = f"{path}/eligible_concepts/{name}"
    ordered = manifest.select(*sorted(manifest.columns)).orderBy("concept_id")
    if head is None:
        ordered.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(where)
        return where
    told = write_hashed_lines(ordered, where)
    doc = head | {"concepts": {k: told[k] for k in ("rows", "content")}}
    stable = {k: v for k, v in doc.items() if k != "created_at"}
    doc["manifest_hash"] = hashlib.sha256(json.dumps(stable, sort_keys=True, default=str).encode()).hexdigest()
    write_document(manifest.sparkSession, f"{where}.json", doc)
    return where


def run_summary(files: DataFrame) -> DataFrame:
    """(split, model, key, value, is_detail) of metric documents (``readers.metrics_files``); objects and lists are details."""
    parts = files.sparkSession.tvf.variant_explode(F.col("doc").outer())
    flat = files.lateralJoin(parts)
    detail = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
    return flat.select("split", "model", "key", F.to_json("value").alias("value"), detail.alias("is_detail"))
