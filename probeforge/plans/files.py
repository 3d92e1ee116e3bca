"""Registered queries of readers and writers: each writes files from the tables into a shared folder and reads them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeforge.plans.catalogue import register
from probeforge.plans.views import view
from probeforge.sources import readers as D
from probeforge.sources import writers as W

NATION = "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"
CUSTOMER = "SELECT c_custkey, c_nationkey FROM customer"


def _text(df, path: str) -> None:
    """One text file of the column ``value``, in order of ``pos``."""
    df.orderBy("pos").coalesce(1).select("value").write.text(path)


def _line(df, pos: str, *parts):
    return df.select(F.col(pos).alias("pos"), F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)).alias("value"))


@register("SELECT concat('img/', c_custkey, '.jpg') AS image_relpath, n_name AS class_name, CAST(n_nationkey AS DOUBLE) / 4 AS first_score, CAST(0.5 AS DOUBLE) AS second_score FROM customer JOIN nation ON c_nationkey = n_nationkey")
def attribute_files(spark, d):
    root = W.shared_folder(spark, "attributes")
    c, n = view(spark, d, CUSTOMER), view(spark, d, NATION)
    images = _line(c, "c_custkey", F.col("c_custkey").cast("string"), ", L_", F.col("c_nationkey").cast("string"), ", box, img/", F.col("c_custkey").cast("string"), ".jpg")
    images.select("value").write.text(f"{root}/images.txt")  # its order does not count
    _text(_line(n, "n_nationkey", "L_", F.col("n_nationkey").cast("string"), ", ", F.col("n_name")), f"{root}/label_list.txt")
    _text(_line(n, "n_nationkey", "L_", F.col("n_nationkey").cast("string"), ", [ ", (F.col("n_nationkey") / 4).cast("string"), "  0.5 ]"), f"{root}/attributes_per_class.txt")
    images, labels, vectors = D.attribute_samples(spark, root)
    return images.join(labels, "label_id").join(vectors, "label_id").select("image_relpath", "class_name", F.col("scores")[0].alias("first_score"), F.col("scores")[1].alias("second_score"))


@register("SELECT CASE n_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'F' ELSE 'V' END AS domain, CAST(CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 123 ELSE 181 END + floor(n_nationkey / 3) AS INT) AS index, lower(r_name) AS \"group\", n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def attribute_vocabulary(spark, d):
    root = W.shared_folder(spark, "vocabulary")
    domain = F.when(F.col("n_nationkey") % 3 == 0, "A").when(F.col("n_nationkey") % 3 == 1, "f").otherwise("V")
    _text(_line(view(spark, d, NATION), "n_nationkey", "Attr_", domain, "_", F.col("n_nationkey").cast("string"), ", ", F.col("r_name"), ": is ", F.col("n_name")), f"{root}/attribute_list.txt")
    rows = D.attribute_vocabulary(spark, root)
    return rows.withColumn("index", F.col("index").cast("int"))


@register("SELECT concat(CASE WHEN c_custkey % 3 = 0 THEN 'test/' ELSE 'train/' END, n_name, '/', c_custkey, '.jpg') AS image_relpath, n_name AS wnid, lower(n_name) AS class_name, 'unknown' AS superclass FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0 AND n_nationkey < 20")
def listed_images(spark, d):
    root = W.shared_folder(spark, "lists")
    c = view(spark, d, "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
    ending = F.when(F.col("c_custkey") % 5 == 0, ".txt").otherwise(".jpg")
    for split, some in (("Test", c.where("c_custkey % 3 = 0")), ("Train", c.where("c_custkey % 3 <> 0"))):
        _text(_line(some, "c_custkey", F.col("n_name"), "/", F.col("c_custkey").cast("string"), ending), f"{root}/{split}Images.txt")
    known = view(spark, d, NATION).where("n_nationkey < 20").select(F.col("n_name").alias("wnid"))
    return D.listed_images(spark, root, D.discovered_dim(known, F.lower)).select("image_relpath", "wnid", "class_name", "superclass")


@register("SELECT n_name AS wnid, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS class_name, CASE WHEN n_nationkey % 3 = 0 THEN 'unknown' ELSE r_name END AS superclass FROM nation JOIN region ON n_regionkey = r_regionkey")
def category_map(spark, d):
    root = W.shared_folder(spark, "categories")
    entry = F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("display_name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("r_name")).alias("supercategory"))
    doc = view(spark, d, NATION).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", entry)))).alias("value"))  # a row a nation
    doc.coalesce(1).write.text(f"{root}/map.json")
    return D.category_dim(spark, f"{root}/map.json")


@register("SELECT concat(n_name, '.jpg') AS file_name, r_name AS category, CAST(c_custkey AS BIGINT) AS ann, CAST(c_custkey * 2 AS DOUBLE) AS area, c_custkey % 2 = 1 AS iscrowd FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def instances_document(spark, d):
    """Annotations joined with their images and categories, from one JSON document that many tasks read."""
    root = W.shared_folder(spark, "instances")
    c = view(spark, d, "SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
    ann = F.struct(F.col("c_nationkey").alias("image_id"), F.col("n_regionkey").alias("category_id"), (F.col("c_custkey") * 2).cast("double").alias("area"), (F.col("c_custkey") % 2).cast("int").alias("iscrowd"), F.array(F.col("c_custkey").cast("double")).alias("bbox"), F.lit('a } "quoted" ] text\\').alias("note"))
    image = F.struct(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(".jpg")).alias("file_name"))
    category = F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    tables = (("annotations", c, ann, "c_custkey"), ("images", view(spark, d, NATION), image, "n_nationkey"), ("categories", spark.read.parquet(f"{d}/region.parquet"), category, "r_regionkey"))
    lines = None
    for i, (name, rows, element, key) in enumerate(tables):
        head = spark.createDataFrame([(i, -1, ("{" if i == 0 else "],") + f'"{name}": [null')], "part int, pos long, value string")
        one = head.unionByName(rows.select(F.lit(i).alias("part"), F.col(key).cast("long").alias("pos"), F.concat(F.lit(","), F.to_json(element)).alias("value")))
        lines = one if lines is None else lines.unionByName(one)
    lines = lines.unionByName(spark.createDataFrame([(9, 0, "]}")], lines.schema))
    lines.orderBy("part", "pos").coalesce(1).select("value").write.text(f"{root}/instances")  # one file is the format
    file = spark.read.text(f"{root}/instances").inputFiles()[0]
    ann, img, cat = D.instances(spark, file)
    return ann.join(img, "image_id").join(cat, "category_id").select("file_name", F.col("name").alias("category"), F.col("bbox")[0].cast("bigint").alias("ann"), "area", "iscrowd")


@register("SELECT p, line, value FROM (SELECT p_partkey, p_partkey % 4 AS p, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) AS line, concat('{\"p_partkey\": ', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ', ' END) AS value FROM part) WHERE p_partkey % 7 = 3")
def malformed_lines(spark, d):
    """The malformed lines of four files with the number of each; blank lines count and are skipped."""
    path = W.shared_folder(spark, "malformed")
    k = F.col("p_partkey")
    broken = F.concat(F.lit('{"p_partkey": '), k.cast("string"), F.when(k % 2 == 0, "").otherwise(", "))
    value = F.when(k % 7 == 3, broken).when(k % 7 == 5, "  ").otherwise(F.to_json(F.struct(k, "p_name")))
    p = spark.read.parquet(f"{d}/part.parquet")
    p.select((k % 4).alias("p"), k.alias("pos"), value.alias("value")).repartition("p").sortWithinPartitions("p", "pos").select("p", "value").write.partitionBy("p").text(path)
    rejects = D.jsonl_rejects(spark, f"{path}/*", p.select("p_partkey", "p_name").schema)
    return rejects.select(F.regexp_extract("file", r"/p=(\d+)/", 1).cast("bigint").alias("p"), "line", "value")


@register("SELECT p_partkey, p_name, p_type FROM part")
def json_lines(spark, d):
    """Written as JSON lines and read again by an explicit schema, strictly."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type")
    path = W.shared_folder(spark, "lines")
    W.write_jsonl(p, path)
    return D.jsonl(spark, path, p.schema)


@register("SELECT p_partkey, concat('spatialq_', substr(sha1(p_name), 1, 10)) AS wnid, CAST(p_partkey % 3 AS INT) AS answer_index, CASE WHEN p_partkey % 2 = 0 THEN 'val' ELSE 'train' END AS split FROM part WHERE p_partkey % 4 <> 0")
def spatial_questions(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    options = F.array(F.lit(" left"), F.lit("on "), F.lit("under"))
    answer = F.when(F.col("p_partkey") % 4 == 0, "above").otherwise(F.element_at(options, (F.col("p_partkey") % 3 + 1).cast("int")))
    rows = p.select("p_partkey", F.col("p_name").alias("question"), options.alias("options"), answer.alias("answer"), F.when(F.col("p_partkey") % 2 == 0, "validation").otherwise("train").alias("split"))
    return D.spatial_samples(rows).select("p_partkey", "wnid", "answer_index", "split")


@register("SELECT c_custkey, n_name AS class_name, substr(sha1(c_name), 1, 8) AS image_sha1 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def labelled_rows(spark, d):
    path = W.shared_folder(spark, "labelled")
    c = spark.read.parquet(f"{d}/customer.parquet")
    c.select("c_custkey", F.col("c_name").cast("binary").alias("image"), F.col("c_nationkey").alias("label")).write.parquet(path)
    labels = view(spark, d, NATION).select(F.col("n_nationkey").alias("label"), F.concat("n_name", F.lit(", "), "r_name").alias("name"))
    return D.labelled_parquet(spark, path, labels).select("c_custkey", "class_name", "image_sha1")


@register("SELECT concat('org/', n_name) AS model, CASE WHEN n_nationkey % 2 = 0 THEN split_part(lower(r_name), ' ', 1) END AS tier FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0")
def model_lists(spark, d):
    path = W.shared_folder(spark, "models") + "/models.txt"
    k = F.col("n_nationkey")
    value = F.when(k % 5 == 0, F.concat(F.lit("# "), "n_name")).when(k % 2 == 0, F.concat(F.lit("org/"), "n_name", F.lit("   # "), F.lower("r_name"))).otherwise(F.concat(F.lit(" org/"), "n_name"))
    _text(view(spark, d, NATION).select(k.alias("pos"), value.alias("value")), path)
    return D.model_list(spark, path)


@register("SELECT concat('n_name=', n_name) AS wnid, 'unknown' AS superclass FROM nation")
def directory_classes(spark, d):
    """Classes of a tree of directories."""
    root = W.shared_folder(spark, "tree")
    view(spark, d, "SELECT n_name, CAST(c_custkey AS STRING) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey").repartition("n_name").write.partitionBy("n_name").text(root)
    return D.discovered_dim(D.class_directories(spark, root, ("txt",))).select("wnid", "superclass")


@register("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'rejects' ELSE 'all' END AS part, count(*) AS n FROM part GROUP BY 1")
def pool_files(spark, d):
    """Accepted items and rejects, written apart."""
    path = W.shared_folder(spark, "pool")
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    W.write_pool(p, path)
    one = lambda name: spark.read.text(f"{path}/{name}").agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return one("all").unionByName(one("rejects"))


@register("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'train_forget' WHEN 1 THEN 'test_forget' WHEN 2 THEN 'train_retain' ELSE 'test_retain' END AS split FROM part WHERE p_partkey % 4 IN (0, 2)")
def combined_split(spark, d):
    """Splits written one folder each; the combined one is a read of two of them."""
    path = W.shared_folder(spark, "splits")
    k = F.col("p_partkey") % 4
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(k == 0, "train_forget").when(k == 1, "test_forget").when(k == 2, "train_retain").otherwise("test_retain").alias("split"))
    W.write_splits(p, path)
    return W.read_combined(spark, path, "train").select("p_partkey", "split")


@register("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS condition, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM part")
def overwritten_condition(spark, d):
    """A condition written again replaces itself and no other."""
    path = W.shared_folder(spark, "conditions")
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("condition"))
    W.write_condition(p.withColumn("state", F.lit("old")), path)
    W.write_condition(p.where("condition = 'A'").withColumn("state", F.lit("new")), path)
    return spark.read.parquet(path).select("p_partkey", "condition", "state")
