"""Readers of image-classification style sources as sample DataFrames: image_relpath, wnid, class_name, superclass.

Paths come from ``binaryFile`` scans that read no content (only ``path`` is selected).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeforge.functions.text import attribute_label, first_synonym, norm_text
from probeforge.schema import ConstraintError
from probeforge.sources.json_elements import document_ranges, read_elements
from probeforge.sources.writers import staged

EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")
#: Order and first global index of attribute domains.
ATTRIBUTE_OFFSETS = {"A": 0, "F": 123, "V": 181, "E": 262, "H": 337}


def relative_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(rel) of the files below ``root`` with one of the extensions, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    clean = F.url_decode(F.regexp_replace(F.regexp_replace("path", "\\+", "%2B"), "^[a-z]+:/*(?=/)", ""))
    marker = "/" + root.rstrip("/").split("://")[-1].strip("/") + "/"
    rel = F.element_at(F.split(clean, F.lit("\\Q" + marker + "\\E"), 2), -1)
    return files.select(rel.alias("rel")).where(F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)).isin(*extensions))


def category_dim(spark: SparkSession, path: str) -> DataFrame:
    """(wnid, class_name, superclass) of a JSON map {directory: {display_name, supercategory}}."""
    kind = "map<string, struct<display_name: string, supercategory: string>>"
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("wnid", "m"))
    return text.select("wnid", F.coalesce("m.display_name", "wnid").alias("class_name"), F.coalesce("m.supercategory", F.lit("unknown")).alias("superclass"))


def discovered_dim(samples: DataFrame, display=None) -> DataFrame:
    """Categories from directory names; superclass ``unknown``."""
    return samples.select("wnid").distinct().select("wnid", (display("wnid") if display else F.col("wnid")).alias("class_name"), F.lit("unknown").alias("superclass"))


def with_classes(samples: DataFrame, dim: DataFrame, known_only: bool = True) -> DataFrame:
    """Samples with their class; the dimension is one row a class, Spark broadcasts it if it is small."""
    out = samples.join(dim, "wnid", "inner" if known_only else "left")
    return out.withColumns({"class_name": F.coalesce("class_name", "wnid"), "superclass": F.coalesce("superclass", F.lit("unknown"))})


def class_directories(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, levels: int = 1) -> DataFrame:
    """Samples of ``<class>/file`` (levels 1) or ``<super>/<class>/file`` (levels 2) trees."""
    files = relative_files(spark, root, extensions)
    parts = F.split("rel", "/")
    return files.where(F.size(parts) > levels).select(F.col("rel").alias("image_relpath"), F.array_join(F.slice(parts, 1, levels), "/").alias("wnid"))


def split_directories(spark: SparkSession, root: str, wnids: DataFrame) -> DataFrame:
    """Samples of ``<split>/<wnid>/...`` trees, splits train, val, test; wnids that the map lacks are left out."""
    files = relative_files(spark, root).withColumns({"split": F.split_part("rel", F.lit("/"), F.lit(1)), "wnid": F.split_part("rel", F.lit("/"), F.lit(2))})
    return files.where(F.col("split").isin("train", "val", "test")).join(wnids.select("wnid", "class_name"), "wnid").select(F.col("rel").alias("image_relpath"), "split", "wnid", "class_name")


def labelled_parquet(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """Samples of Parquet rows (image bytes, label): the class is the first synonym of the label's name."""
    rows = spark.read.parquet(path).join(labels.select("label", first_synonym("name").alias("class_name")), "label")
    return rows.withColumn("image_sha1", F.substring(F.sha1("image"), 1, 8))


def logo_directories(spark: SparkSession, root: str) -> DataFrame:
    out = class_directories(spark, root, levels=2)
    return out.withColumns({"class_name": F.translate(F.split_part("wnid", F.lit("/"), F.lit(2)), "_", " "), "superclass": F.split_part("wnid", F.lit("/"), F.lit(1))})


def listed_images(spark: SparkSession, root: str, dim: DataFrame, splits: tuple[str, ...] = ("Train", "Test")) -> DataFrame:
    """Samples listed in ``<Split>Images.txt`` as ``category/file``; unknown categories are left out."""
    out = None
    for s in splits:
        lines = spark.read.text(f"{root}/{s}Images.txt").select(F.trim("value").alias("v")).where("v like '%/%'")
        one = lines.select(F.concat(F.lit(s.lower() + "/"), "v").alias("image_relpath"), F.split_part("v", F.lit("/"), F.lit(1)).alias("wnid"))
        out = one if out is None else out.unionByName(one)
    return with_classes(out.where(F.lower(F.regexp_extract("image_relpath", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)), dim)


def instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations, images, categories) of an instances JSON document, one file read by many tasks.

    ann_pos orders annotations as the document does (it is the offset of each one's first byte).
    """
    ranges = document_ranges(spark, path)
    ann = read_elements(spark, path, "annotations", "image_id bigint, category_id bigint, area double, iscrowd int, bbox array<double>", ranges)
    img = read_elements(spark, path, "images", "id bigint, file_name string, width int, height int", ranges)
    cat = read_elements(spark, path, "categories", "id bigint, name string, supercategory string", ranges)
    ann = ann.select(F.col("offset").alias("ann_pos"), "image_id", "category_id", "area", (F.col("iscrowd") == 1).alias("iscrowd"), "bbox")
    return ann, img.drop("offset").withColumnRenamed("id", "image_id"), cat.drop("offset").withColumnRenamed("id", "category_id")


#: Blocks of files whose line counts are broadcast; beyond, lines meet them by a shuffle of one key a block.
BROADCAST_BLOCKS = 100_000


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line from 1, value) of text files, without a task that sees a whole file.

    Each task counts the lines of its blocks of files; prefix sums of these counts, a number a block, give each block's first line.
    A gzip file is one block. Lines end with LF, CRLF or CR; blank ones count.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = staged(rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n")), "line-blocks")
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    placed = rows.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, ["file", "block"])
    return placed.select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def _plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a file whose order does not count."""
    return spark.read.text(path).select(F.col("value").alias("line")).where(F.trim("line") != "")


def attribute_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """(domain, index, group, label) of attribute_list.txt: running numbers in each domain plus the domain's offset.

    The domain is the id's single letter (``Attr_F_007``); lines without ``group: value`` count, but give no row.
    """
    lines = numbered_lines(spark, f"{root}/attribute_list.txt").where(F.trim("value") != "")
    rows = lines.select(F.col("line").alias("pos"), F.trim(F.split_part("value", F.lit(","), F.lit(1))).alias("id"), F.trim(F.split_part("value", F.lit(","), F.lit(2))).alias("text"))
    rows = rows.withColumn("domain", F.upper(F.regexp_extract("id", "(?:^|_)([A-Za-z])(?:_|$)", 1)))
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in ATTRIBUTE_OFFSETS.items() for x in kv)), F.col("domain"))
    nth = F.row_number().over(Window.partitionBy("domain").orderBy("pos")) - 1
    group, text = F.trim(F.split_part("text", F.lit(":"), F.lit(1))), F.trim(F.regexp_extract("text", r"^[^:]*:(.*)$", 1))
    numbered = rows.withColumn("index", offset + nth).where(F.contains("text", F.lit(": ")))
    return numbered.select("domain", "index", F.lower(group).alias("group"), attribute_label(text).alias("label"))


def attribute_samples(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images: image_relpath, label_id; labels: label_id, class_name; vectors: label_id, scores) of the attribute dataset's files."""
    parts = F.transform(F.split("line", ","), lambda x: F.trim(x))
    images = _plain_lines(spark, f"{root}/images.txt").where(F.size(parts) >= 4).select(F.element_at(parts, 2).alias("label_id"), F.element_at(parts, -1).alias("image_relpath"))
    labels = _plain_lines(spark, f"{root}/label_list.txt").where(F.size(parts) >= 2).select(F.element_at(parts, 1).alias("label_id"), F.element_at(parts, 2).alias("class_name"))
    numbers = F.transform(F.filter(F.split(F.trim(F.regexp_extract("line", r"\[(.*)\]", 1)), "[,\\s]+"), lambda x: x != ""), lambda x: x.cast("double"))
    vectors = _plain_lines(spark, f"{root}/attributes_per_class.txt").select(F.trim(F.split_part("line", F.lit(","), F.lit(1))).alias("label_id"), numbers.alias("scores"))
    return images, labels, vectors


def spatial_samples(rows: DataFrame) -> DataFrame:
    """Prebuilt questions whose answer is among their options: question, options, answer_index, wnid, split."""
    at = F.array_position(F.transform("options", lambda o: F.trim(o)), F.trim("answer"))
    out = rows.withColumn("answer_index", (at - 1).cast("int")).where("answer_index >= 0")
    return out.withColumns({"wnid": F.concat(F.lit("spatialq_"), F.substring(F.sha1(F.col("question").cast("binary")), 1, 10)), "split": F.when(F.col("split") == "validation", "val").otherwise(F.col("split"))})


#: Malformed lines that an error names.
NAMED_LINES = 20


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``lines`` with record and bad: a line is no JSON object of the schema. Blank lines are left out."""
    kind = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = lines.where(F.trim("value") != "").withColumn("record", F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}))
    return rows.withColumn("bad", F.col("record").isNull() | F.col("record._corrupt_record").isNotNull())


def jsonl(spark: SparkSession, path, schema: T.StructType, strict: bool = True, numbered: bool = False) -> DataFrame:
    """Rows of JSON lines by an explicit schema; blank lines are skipped, with ``numbered`` the columns file and line come, too.

    Strict: malformed lines raise, each with ``path:line`` and its text (NAMED_LINES of them, in order; only then lines are numbered).
    """
    lines = numbered_lines(spark, path) if numbered else spark.read.text(path)
    parsed = _parsed(lines, schema)
    if strict and parsed.where("bad").limit(1).count():
        bad = jsonl_rejects(spark, path, schema).orderBy("file", "line").limit(NAMED_LINES).collect()
        raise ConstraintError("jsonl", [f"{r['file']}:{r['line']}: {r['value'][:80]}" for r in bad])
    return parsed.select("record.*", *(["file", "line"] if numbered else [])).drop("_corrupt_record")


def jsonl_rejects(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """(file, line, value) of the lines that are no JSON object of the schema."""
    return _parsed(numbered_lines(spark, path), schema).where("bad").select("file", "line", "value")


def forget_classes(path: str) -> list[str]:
    """Class names of a list file: a list, or {"forget_classes": list}, of names or of objects with ``class``; sorted."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    return sorted({x["class"] if isinstance(x, dict) else x for x in (doc["forget_classes"] if isinstance(doc, dict) else doc)})


def resolved_forget_classes(items: DataFrame, given: list[str] | None = None, cls: str = "forget_concept", path: str | None = None) -> list[str]:
    """The classes of a list file, else the given ones, else the different non-empty concepts of test_forget, sorted (a registry-sized list); none raise."""
    found = forget_classes(path) if path else given
    found = found or sorted(r[0] for r in items.where(f"split = 'test_forget' and {cls} <> ''").select(cls).distinct().collect())
    if not found:
        raise ConstraintError("forget classes", ["no list file, no given class and no concept of test_forget"])
    return found


def metrics_files(spark: SparkSession, glob: str) -> DataFrame:
    """(split, model, doc) of ``<split>__<model>/metrics.json`` below a results folder; shards and hidden folders are left out."""
    files = spark.read.text(glob, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run"), F.parse_json("value").alias("doc"))
    return files.where("not startswith(run, 'shard_') and not startswith(run, '_')").select(F.substring_index("run", "__", 1).alias("split"), F.regexp_replace("run", "^.*?__", "").alias("model"), "doc")


def model_list(spark: SparkSession, path: str) -> DataFrame:
    """(model, tier) of ``id  #tier`` lines; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    return lines.select(F.regexp_extract("v", r"^(\S+)", 1).alias("model"), F.nullif(F.regexp_extract("v", r"#\s*(\S+)", 1), F.lit("")).alias("tier"))


SOURCES = {
    "directory": split_directories, "hf_parquet": labelled_parquet, "coco": instances, "spatialmqa": spatial_samples, "mit_indoor67": listed_images, "aid": class_directories,
    "logo2kplus": logo_directories, "celebrity_faces": class_directories, "lad": attribute_samples,
}


def source(kind: str = "directory"):
    """The reader of a source type."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source type {kind!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[kind]


def same_name_classes(dim: DataFrame) -> DataFrame:
    """Class names that several wnids share after normalisation."""
    return dim.groupBy(norm_text("class_name").alias("norm")).agg(F.collect_set("wnid").alias("wnids")).where(F.size("wnids") > 1)
