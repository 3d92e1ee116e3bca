"""The model boundary: methods and adapters, batched scoring with ``mapInPandas``, and a run end to end."""

from __future__ import annotations

import hashlib
import json
import platform
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeforge.functions.text import oracle_line, render_prompt, suppression_line
from probeforge.operators.accounting import accounting_sets, failure_counts
from probeforge.operators.quality import item_errors, response_violations
from probeforge.operators.scoring import score_logits, score_responses
from probeforge.schema import VERSION, CapabilityMismatch, require_none
from probeforge.sources.hashed_lines import content_of, read_hashed_lines, write_hashed_lines
from probeforge.sources.writers import matched, spread, staged, write_document

RESPONSE = "request_id string, raw_output string, error_status string, error_detail string, latency_ms double"


@dataclass(frozen=True)
class Adapter:
    """A model: what it can do, and a loader called once a worker that returns a batch function (requests -> raw outputs).

    ``score_options`` loads the logit path likewise: requests -> a list of one number for each option. ``think`` loads the path that
    goes on with a thought: requests (prompt_text ends with the thought so far) -> what is added within the adapter's budget.
    """

    name: str
    capabilities: dict[str, bool]
    load: Callable[[], Callable[[pd.DataFrame], list]]
    score_options: Callable[[], Callable[[pd.DataFrame], list]] | None = None
    revision: str = ""
    think: Callable[[], Callable[[pd.DataFrame], list]] | None = None


class WorkerFailure(Exception):
    """Raised by an adapter that cannot go on at all (its device is lost): no request's own fault, so none is tried again."""


def oracle_adapter() -> Adapter:
    """Answers every request rightly; for tests and demonstrations."""
    said = lambda pdf: [str(int(a)) if a == a and a is not None else x[0] for a, x in zip(pdf["answer_index"], pdf["accepted_answers"])]
    liked = lambda pdf: [None if c is None else [float(i == a) for i in range(len(c))] for c, a in zip(pdf["choices"], pdf["answer_index"])]
    return Adapter("oracle", {"supports_images": True, "supports_batching": True, "supports_logits": True}, lambda: said, lambda: liked)


def failing_adapter() -> Adapter:
    """Raises on every batch."""

    def load():
        def batch(pdf):
            raise RuntimeError("no model")

        return batch

    return Adapter("failing", {"supports_images": True}, load)


@dataclass(frozen=True)
class Method:
    """A treatment: capabilities it needs, the instruction it adds to requests (None for none), and its other hooks.

    ``prepare``: called once on the driver with the forget and the retain training items; what it gives goes to ``intervene``.
    ``intervene``: (the loaded batch function, what prepare gave) -> batch function, once a worker. ``transform_output``: a column
    expression over the raw output. ``about``: what else the run manifest discloses.
    """

    name: str
    label: str = "no_op"
    required: tuple[str, ...] = ()
    instruction: Callable[[], Column | None] = lambda: None
    prepare: Callable[[DataFrame | None, DataFrame | None], object] | None = None
    intervene: Callable[[Callable, object], Callable] | None = None
    transform_output: Callable[[Column], Column] | None = None
    about: dict = field(default_factory=dict, hash=False)

    def check(self, adapter: Adapter) -> None:
        missing = sorted(c for c in self.required if not adapter.capabilities.get(c))
        if missing:
            raise CapabilityMismatch(missing, f"{self.name} on {adapter.name}")

    def metadata(self) -> dict:
        """The record that discloses the method in a run manifest."""
        hooks = [h for h in ("prepare", "intervene", "transform_output") if getattr(self, h)]
        return {"method_id": self.name, "semantic_label": self.label, "required_capabilities": list(self.required), "hooks": hooks} | self.about

    def applied(self, adapter: Adapter, forget: DataFrame | None = None, retain: DataFrame | None = None) -> Adapter:
        """The adapter after prepare and with intervene in each worker."""
        prepared = self.prepare(forget, retain) if self.prepare else None
        if self.intervene is None:
            return adapter
        intervene = self.intervene
        changed = lambda load: (lambda: intervene(load(), prepared)) if load else None
        return replace(adapter, load=changed(adapter.load), score_options=changed(adapter.score_options), think=changed(adapter.think))

    def answered(self, responses: DataFrame) -> DataFrame:
        """Responses after transform_output; errors have no output to change."""
        if self.transform_output is None:
            return responses
        return responses.withColumn("raw_output", F.when(F.col("raw_output").isNotNull(), self.transform_output(F.col("raw_output"))))


NO_OP = Method("no_op")


def suppression(variant: str, concepts: list[str] | None = None, own: bool = False) -> Method:
    """An instruction not to recognise the concepts; ``own``: each request's own concept instead of a list."""
    if not concepts and not own:
        raise ValueError("suppression needs the concepts to suppress")
    return Method(f"prompt_suppression_{variant}", "prompt_suppression", (), lambda: suppression_line(variant, "concept_name", concepts), about={"concepts": sorted(concepts or [])})


#: (a part of a model's id in lower case, factory of its adapter); the first that fits is taken.
_adapters: list[tuple[str, Callable[..., Adapter]]] = [("oracle", lambda model_id, **_: oracle_adapter()), ("failing", lambda model_id, **_: failing_adapter())]


def register_adapter(part: str, factory: Callable[..., Adapter]) -> None:
    """Models whose id holds ``part`` (in any case) are made by ``factory(model_id, **options)``; "" stands for all that no other part fits."""
    _adapters[:] = [x for x in _adapters if x[0] != part.lower()]
    _adapters.append((part.lower(), factory))


def create_adapter(model_id: str, **options) -> Adapter:
    """The adapter of a model by its id: the longest registered part that it holds. No model is loaded before a worker asks for it."""
    fit = [x for x in _adapters if x[0] in model_id.lower()]
    if not fit:
        raise ValueError(f"no adapter for {model_id!r}; known: {', '.join(sorted(x[0] for x in _adapters))}")
    return max(fit, key=lambda x: len(x[0]))[1](model_id, **options)


def oracle_control(kind: str) -> Method:
    """An instruction that reveals the answer, on forget splits only; a control and no method to rank."""
    return Method(f"oracle_{kind}", "instruction_following_control", (), lambda: F.when(F.col("split").isNull() | F.col("split").isin("test_forget", "train_forget"), oracle_line(kind, "concept_name")))


def requests(items: DataFrame, run_id: str, method: Method = NO_OP) -> DataFrame:
    line = method.instruction()
    told = F.array_compact(F.array(line)) if line is not None else None
    return items.withColumns({"request_id": F.concat(F.lit(run_id + "/"), "item_id"), "prompt_text": render_prompt("question_format", "question", "choices", told)})


def answer_batches(model: Callable[[pd.DataFrame], list], rows: pd.DataFrame, batch_size: int) -> pd.DataFrame:
    """RESPONSE for each of ``rows``, asked batch by batch. A batch that fails is tried again one by one; what fails then is a model_error with its detail."""

    def safe(pdf: pd.DataFrame) -> list[tuple]:
        try:
            out = model(pdf)
            if len(out) == len(pdf):
                return [(o, None, None) if o else (None, "model_error", "empty output") for o in out]
            failed = f"{len(out)} outputs for {len(pdf)} requests"
        except WorkerFailure:
            raise
        except Exception as e:  # noqa: BLE001  any fault of a model is recorded
            failed = f"{type(e).__name__}: {e}"
        if len(pdf) > 1:
            return [x for i in range(len(pdf)) for x in safe(pdf.iloc[i : i + 1])]
        return [(None, "model_error", failed)]

    out = []
    for at in range(0, len(rows), batch_size):
        some = rows.iloc[at : at + batch_size]
        began = time.perf_counter()
        found = safe(some)
        each = 1000 * (time.perf_counter() - began) / len(some)
        out += [(r, *x, each) for r, x in zip(some["request_id"], found)]
    return pd.DataFrame(out, columns=["request_id", "raw_output", "error_status", "error_detail", "latency_ms"]).astype({"latency_ms": "float64"})


def infer(reqs: DataFrame, adapter: Adapter, batch_size: int = 64) -> DataFrame:
    """RESPONSE for each request, in batches; the fault of one request is its own."""
    load = adapter.load

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield answer_batches(model, pdf, batch_size)

    return reqs.mapInPandas(run, RESPONSE)


def infer_options(reqs: DataFrame, adapter: Adapter, batch_size: int = 64) -> DataFrame:
    """(request_id, logits, error_detail) of MCQ requests by the adapter's logit path; a batch that fails leaves its requests without logits."""
    if adapter.score_options is None or not adapter.capabilities.get("supports_logits"):
        raise CapabilityMismatch(["supports_logits"], adapter.name)
    load = adapter.score_options

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                some = pdf.iloc[at : at + batch_size]
                try:
                    found, failed = list(model(some)), None
                    if len(found) != len(some):
                        raise ValueError(f"{len(found)} outputs for {len(some)} requests")
                except Exception as e:  # noqa: BLE001  any fault of a model is recorded
                    found, failed = [None] * len(some), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"request_id": some["request_id"].to_numpy(), "logits": found, "error_detail": failed})

    return reqs.where(F.col("question_format") == "mcq").mapInPandas(run, "request_id string, logits array<double>, error_detail string")


def score_option_requests(reqs: DataFrame, adapter: Adapter) -> DataFrame:
    """MCQ requests answered and scored by the logit path."""
    asked = staged(spread(reqs.where(F.col("question_format") == "mcq"), "request_id"), "option-requests")
    return matched(asked, infer_options(asked, adapter), "request_id").withColumn("score", score_logits("logits", "answer_index")).select("*", "score.*").drop("score")


def agreement(generated: DataFrame, logits: DataFrame) -> DataFrame:
    """How often the two answer paths agree, joined by request."""
    both = matched(generated.select("request_id", F.col("prediction").alias("a")), logits.select("request_id", F.col("prediction").alias("b")), "request_id")
    return both.agg(F.count("*").alias("requests"), F.count_if(F.col("a") == F.col("b")).alias("agree"))


def contract_tallies(generated: DataFrame, logits: DataFrame) -> DataFrame:
    """One row: how many answers of each way can be read and are right, and how often both agree where both can be read.

    Both have request_id, prediction and answer_index.
    """
    side = lambda df, name: df.select("request_id", F.col("prediction").cast("string").alias(name), F.col("answer_index").cast("string").alias(f"{name}_truth"))
    both = side(generated, "said").join(side(logits, "picked"), "request_id", "full")
    right = lambda c: F.count_if(F.coalesce(F.col(c) == F.col(f"{c}_truth"), F.lit(False)))
    return both.agg(
        F.count("*").alias("requests"), F.count("said").alias("said"), right("said").alias("said_right"), F.count("picked").alias("picked"), right("picked").alias("picked_right"),
        F.count_if(F.col("said").isNotNull() & F.col("picked").isNotNull()).alias("both"), F.count_if(F.coalesce(F.col("said") == F.col("picked"), F.lit(False))).alias("agree"),
    )


def capability_gate(methods: DataFrame, models: DataFrame) -> DataFrame:
    """All registered (method, model) combinations with what is missing; both are small registries."""
    from probeforge.functions.text import missing_capabilities

    both = methods.crossJoin(F.broadcast(models))
    return both.select("method_id", "model_id", missing_capabilities("required_capabilities", "capabilities").alias("missing")).withColumn("supported", F.size("missing") == 0)


@dataclass
class Run:
    """A run's results: records, metrics and its manifest."""

    manifest: dict
    records: DataFrame | None = None
    metrics: DataFrame | None = None
    failures: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def digests(items: DataFrame) -> dict[str, str]:
    """The data block's hashes, each over the different values or, for rows, over all, as an order-free sum; one pass, nothing is gathered."""
    row = F.xxhash64(*(F.to_json(F.struct(c)) for c in sorted(items.columns))).cast("decimal(38,0)")
    kinds = {"split_hash": ["sample_id", "split"], "concept_registry_hash": ["concept_id", "concept_name"], "probe_bank_hash": ["probe_id", "probe_family"], "prompt_bank_hash": ["prompt_variant_id"]}
    sums = [F.count("*").alias("n0"), F.sum(row).alias("s0")]
    for i, columns in enumerate(kinds.values(), 1):
        h = F.xxhash64(*columns).cast("decimal(38,0)")
        sums += [F.count_distinct(h).alias(f"n{i}"), F.sum_distinct(h).alias(f"s{i}")]
    r = items.agg(*sums).first()
    sha = lambda i: hashlib.sha256(f"{r[f'n{i}']}|{r[f's{i}'] or 0}".encode()).hexdigest()
    return {"dataset_hash": sha(0)} | {k: sha(i) for i, k in enumerate(kinds, 1)}


def base_manifest(items: DataFrame, adapter: Adapter, method: Method, run_id: str, scope: str = "pilot", seed: int = 0, repository: dict | None = None, eligibility: dict | None = None) -> dict:
    """A run manifest that ``manifests.manifest_errors`` accepts, before the run; unknown values are null."""
    sha = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()
    version = items.select(F.max(F.col("source")["version"])).first()[0] if "source" in items.columns else None
    return {
        "schema_version": VERSION, "run_id": run_id, "created_at": datetime.now(UTC).isoformat(), "run_scope": scope, "status": "running",
        "repository": {"url": None, "git_sha": None, "dirty": None} | (repository or {}),
        "environment": {"python": platform.python_version(), "spark": items.sparkSession.version},
        "data": {"benchmark_version": VERSION, "dataset_version": version} | digests(items),
        "model": {"model_id": adapter.name, "model_revision": adapter.revision, "processor_revision": None, "loader": "adapter", "chat_template": None},
        "method": {"method_id": method.name, "method_version": VERSION, "label": method.label, "config_hash": sha(method.metadata())} | method.metadata(),
        "capability_validation": {"supported": True, "missing_capabilities": []},
        "seeds": dict.fromkeys(("data_selection", "option_order", "controls", "inference", "training"), seed),
        "inference": {"decoding": None, "dtype": None, "device": None},
        "training": {"steps": 0, "updated_parameter_count": 0, "updated_parameter_fraction": 0.0, "tuning_budget": None},
        "cost": {"wall_seconds": None, "gpu_hours": None, "peak_memory_bytes": None, "inference_latency_ms": None},
        "eligibility": eligibility or {}, "artifacts": {}, "failure_counts": {},
    }


def evaluate(items: DataFrame, adapter: Adapter, method: Method = NO_OP, run_id: str = "run", out_dir: str | None = None, training: tuple[DataFrame | None, DataFrame | None] = (None, None), **about) -> Run:
    """Validate, gate, render, infer, score and account; with ``out_dir`` the run's artifacts are written there.

    Items are written once, dealt to tasks by their number. Responses are written before they are read again (in ``out_dir``, else the shared checkpoint folder), so the model runs once,
    and are checked against the requests. An unsupported combination yields only a manifest. Artifacts: run_manifest.json
    (before the run with status running, and after), responses, results, failures and metrics as JSON lines; the manifest has the rows and SHA-256 of each and of its parts.
    ``training``: the forget and the retain training items, for a method that prepares itself. ``about``: see base_manifest.
    """
    spark = items.sparkSession
    began = time.perf_counter()
    items = staged(spread(items, "item_id"), "items")
    require_none(items.select("item_id", item_errors().alias("errors")).where(F.size("errors") > 0), "items")
    doc = base_manifest(items, adapter, method, run_id, **about)

    def publish() -> None:
        if out_dir:
            write_document(spark, f"{out_dir}/run_manifest.json", doc)

    try:
        method.check(adapter)
    except CapabilityMismatch as e:
        doc |= {"status": "unsupported", "missing": e.missing, "capability_validation": {"supported": False, "missing_capabilities": e.missing}}
        publish()
        return Run(doc)
    publish()
    try:
        asked = requests(items, run_id, method)

        def kept(df: DataFrame, name: str) -> DataFrame:
            """``df`` written once; with ``out_dir`` as JSON lines whose digest was made by the tasks that wrote them."""
            if not out_dir:
                df = staged(df, name)
                doc["artifacts"][name] = content_of(df)
                return df
            doc["artifacts"][name] = write_hashed_lines(df, f"{out_dir}/{name}")
            return read_hashed_lines(df, f"{out_dir}/{name}")

        answers = kept(method.answered(infer(asked, method.applied(adapter, *training))), "responses")
        require_none(response_violations(asked, answers), "adapter contract")
        records = kept(score_responses(matched(asked, answers, "request_id")), "results")
        failures = records.where(~F.col("response_status").isin("correct", "incorrect"))
        metrics = accounting_sets(records, [[], ["split", "question_format", "input_condition"], ["concept_id", "input_condition"]])
        failures, metrics = kept(failures, "failures"), kept(metrics.orderBy("level", "split", "question_format", "input_condition", "concept_id"), "metrics")
        doc["failure_counts"] = {x[0]: x[1] for x in failure_counts(records).collect()}  # a row a status
        latency = answers.agg(F.avg("latency_ms")).first()[0]
        doc["cost"] |= {"wall_seconds": time.perf_counter() - began, "inference_latency_ms": latency}
        doc["status"] = "completed"
    except Exception:
        doc["status"] = "failed"
        publish()
        raise
    publish()
    return Run(doc, records, metrics, failures)


def evaluate_conditions(items: DataFrame, adapter: Adapter, conditions: list[str], concepts: list[str] | None = None) -> DataFrame:
    """Legacy form: every condition over every item in one pass; conditions of single items reuse the baseline on retain splits."""
    from probeforge.functions.text import legacy_digit, legacy_prompt

    per_item = F.col("condition").isin("ORACLE_HARD", "ORACLE_REVERSE")
    is_forget = F.col("split").endswith("_forget")
    rows = items.withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).where(~per_item | is_forget)
    rows = rows.withColumns({"request_id": F.concat_ws("/", "condition", "item_id"), "prompt_text": legacy_prompt("question", "choices", "condition", is_forget, "concept_name", concepts)})
    rows = staged(spread(rows, "request_id"), "legacy-requests")
    out = matched(rows, staged(infer(rows, adapter), "legacy-responses"), "request_id").withColumn("pred_index", legacy_digit("raw_output"))
    again = out.where((F.col("condition") == "BASELINE_NORMAL") & ~is_forget).drop("condition").withColumn("condition", F.explode(F.array(*(F.lit(c) for c in conditions if c.startswith("ORACLE_"))).cast("array<string>")))
    return out.unionByName(again.select(out.columns))
