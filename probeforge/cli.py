"""Command line: migrate, validate, leakage, split and aggregate. Exit code 0: done; 1: a check found something; 2: invalid input."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeforge.functions.text import forget_concept
from probeforge.operators import accounting, manifests, migration, quality, splits
from probeforge.schema import ITEM, LEGACY, SPLITS, ConstraintError, require_none
from probeforge.sources import readers, writers


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="probeforge", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("migrate", help="legacy JSON lines to items")
    for name in ("input", "output", "dataset-id", "source-version", "license-id", "redistribution", "provenance-note"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--split", required=True, choices=SPLITS)
    p.add_argument("--allow-rejects", action="store_true")
    p.add_argument("--skip-answer-balance-check", action="store_true")
    p = sub.add_parser("validate", help="items, a split registry or a run manifest")
    p.add_argument("kind", choices=("items", "registry", "manifest"))
    p.add_argument("paths", nargs="+")
    p.add_argument("--require-core-controls", action="store_true")
    p.add_argument("--skip-answer-balance-check", action="store_true")
    p = sub.add_parser("leakage", help="classes that several splits share")
    p.add_argument("--input", required=True, help="folder that split wrote")
    p = sub.add_parser("split", help="a pool into forget and retain splits")
    for name in ("input", "out-dir"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--forget-class", nargs="*")
    p.add_argument("--forget-classes-json")
    p.add_argument("--k", type=int)
    p.add_argument("--mode", choices=("random_k", "superclass_balanced_k"), default="random_k")
    for name, default in (("n-train-per-forget-class", 50), ("n-test-per-forget-class", 50), ("n-retain-train", 200), ("n-retain-test", 50), ("seed", 123)):
        p.add_argument(f"--{name}", type=int, default=default)
    p = sub.add_parser("aggregate", help="metric documents of runs to one wide CSV")
    for name in ("results", "out", "sort-by"):
        p.add_argument(f"--{name}", required=True)
    return top


def _named_lines(rows: DataFrame, key: str) -> list[str]:
    """``path:line: id: errors`` of rows with file, line and errors, the first in order."""
    some = rows.orderBy("file", "line").limit(readers.NAMED_LINES).collect()
    return [f"{r['file']}:{r['line']}: {r[key]}: {'; '.join(r['errors'])}" for r in some]


def _migrate(spark: SparkSession, a: argparse.Namespace) -> int:
    context = migration.Context(a.dataset_id, a.source_version, a.split, a.license_id, a.redistribution, a.provenance_note)
    moved = migration.migrate(readers.jsonl(spark, a.input, LEGACY), context)
    report = migration.migration_report(moved).first().asDict()
    print(json.dumps(report))
    if report["rejected_count"] and not a.allow_rejects:
        rejected = migration.migrate(readers.jsonl(spark, a.input, LEGACY, numbered=True), context)
        raise ConstraintError("migration", _named_lines(rejected.where("error is not null").withColumn("errors", F.array("error")), "legacy_id"))
    items = migration.migrated_items(moved)
    require_none(quality.dataset_violations(items, balance=not a.skip_answer_balance_check), "items")
    writers.write_jsonl(items, a.output)
    sums = {"input_sha256": writers.file_digest(spark, a.input), "output_sha256": writers.file_digest(spark, a.output)}
    writers.write_document(spark, f"{a.output.rstrip('/')}.report.json", report | sums)
    return 0


def _document(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.kind == "items":
        items = readers.jsonl(spark, a.paths, ITEM)
        if items.where(F.size(quality.item_errors()) > 0).limit(1).count():
            rows = readers.jsonl(spark, a.paths, ITEM, numbered=True).withColumn("errors", quality.item_errors())
            raise ConstraintError("items", _named_lines(rows.where(F.size("errors") > 0), "item_id"))
        require_none(quality.dataset_violations(items, balance=not a.skip_answer_balance_check, core_controls=a.require_core_controls), "items")
        return 0
    check = quality.registry_errors if a.kind == "registry" else manifests.manifest_errors
    errors = [f"{path}: {e}" for path in a.paths for e in check(_document(path))]
    if errors:
        raise ConstraintError(a.kind, errors)
    return 0


def _leakage(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = spark.read.schema(LEGACY).json(f"{a.input}/splits").withColumn("synset", F.col("meta")["synset"])
    shared = splits.class_leakage(rows, "synset").collect()  # a row for each pair of splits
    for r in shared:
        print(f"{r['s1']} and {r['s2']} share {r['shared']} classes")
    return 1 if any(r["s1"].split("_")[1:] != r["s2"].split("_")[1:] for r in shared) else 0


def _forget(classes: DataFrame, a: argparse.Namespace) -> DataFrame:
    """An explicit list beats k and mode."""
    named = readers.forget_classes(a.forget_classes_json) if a.forget_classes_json else a.forget_class
    if named:
        return classes.where(F.col("concept").isin(named))
    if not a.k:
        raise ConstraintError("split", ["state --forget-class, --forget-classes-json or --k"])
    if a.mode == "random_k":
        return splits.random_k(classes, "concept", a.k, a.seed)
    return splits.balanced_k(classes, "concept", "superclass", a.k, a.seed)


def _split(spark: SparkSession, a: argparse.Namespace) -> int:
    pool = readers.jsonl(spark, a.input, LEGACY).withColumns({"concept": forget_concept("meta"), "superclass": F.coalesce(F.col("meta")["superclass"], F.lit("unknown"))})
    classes = pool.groupBy("concept").agg(F.min("superclass").alias("superclass"))
    forget = _forget(classes, a).select("concept")
    out = splits.split_forget(pool, forget, "concept", "id", a.n_train_per_forget_class, a.n_test_per_forget_class, a.seed)
    out = out.unionByName(splits.split_retain(pool, forget, "concept", "id", a.n_retain_train, a.n_retain_test, a.seed), allowMissingColumns=True)
    writers.write_splits(out.select(*(f.name for f in LEGACY.fields), "split"), a.out_dir)
    stats = accounting.split_stats(out.select("split", "concept"), "concept")
    writers.write_jsonl(stats, f"{a.out_dir}/top_classes")
    chosen = sorted(x[0] for x in forget.collect())  # the asked classes
    counts = {x[0]: x[1] for x in out.groupBy("split").agg(F.count("*").alias("n")).collect()}  # a row a split
    writers.write_document(spark, f"{a.out_dir}/forget_classes.json", {"forget_classes": chosen, "seed": a.seed})
    writers.write_document(spark, f"{a.out_dir}/split_stats.json", {"splits": counts, "top_classes": [x.asDict() for x in stats.collect()], "seed": a.seed})
    return 0


def _aggregate(spark: SparkSession, a: argparse.Namespace) -> int:
    flat = manifests.run_summary(readers.metrics_files(spark, f"{a.results}/*/metrics.json")).where("not is_detail")
    keys = sorted(r[0] for r in flat.select("key").distinct().collect())  # names of metrics
    if a.sort_by not in keys:
        raise ConstraintError("aggregate", [f"no metric {a.sort_by}; known: {', '.join(keys)}"])
    writers.write_wide_csv(flat.groupBy("split", "model").pivot("key", keys).agg(F.first("value")), a.out, a.sort_by)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("probeforge").getOrCreate()
    run = {"migrate": _migrate, "validate": _validate, "leakage": _leakage, "split": _split, "aggregate": _aggregate}[args.command]
    try:
        return run(spark, args)
    except (ConstraintError, OSError, json.JSONDecodeError, PySparkException) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
