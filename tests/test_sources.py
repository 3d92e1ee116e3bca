"""Readers and writers over small temporary trees, and streaming against batch."""

import json

import pytest
from pyspark.sql import functions as F

from probeforge.operators import quality as Q
from probeforge.schema import LEGACY, ConstraintError
from probeforge.sources import readers as S
from probeforge.sources import writers as W
from probeforge.streaming import metrics as M


def test_directories(spark, tmp_path):
    for p in ("cat/1.JPG", "cat/2.png", "dog/1.jpeg", "dog/no.txt"):
        (tmp_path / "root" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / p).write_bytes(b"x")
    got = sorted((r["image_relpath"], r["wnid"]) for r in S.class_directories(spark, str(tmp_path / "root")).collect())
    assert got == [("cat/1.JPG", "cat"), ("cat/2.png", "cat"), ("dog/1.jpeg", "dog")]
    with pytest.raises(ValueError):
        S.source("nothing")


def test_instances(spark, tmp_path):
    doc = {
        "categories": [{"id": 1, "name": "cat", "supercategory": "animal"}, {"id": 2, "name": "bus", "supercategory": "vehicle"}],
        "images": [{"id": i, "file_name": f"{i}.jpg", "width": 10, "height": 10} for i in (1, 2, 3)],
        "annotations": [{"image_id": 1, "category_id": 1, "area": 50.0, "iscrowd": 0, "bbox": []}, {"image_id": 2, "category_id": 1, "area": 50.0, "iscrowd": 0, "bbox": []}, {"image_id": 2, "category_id": 2, "area": 60.0, "iscrowd": 0, "bbox": []}, {"image_id": 3, "category_id": 2, "area": 1.0, "iscrowd": 0, "bbox": []}],
    }
    (tmp_path / "i.json").write_text(json.dumps(doc))
    ann, img, cat = S.instances(spark, str(tmp_path / "i.json"))
    assert [(r["image_id"], r["category_id"]) for r in Q.single_label(ann, img).collect()] == [(1, 1)]
    assert sorted((r["image_id"], r["category_id"]) for r in Q.single_label(ann, img, single=False).collect()) == [(1, 1), (2, 2)]
    assert cat.count() == 2


def test_attribute_files(spark, tmp_path):
    (tmp_path / "attribute_list.txt").write_text("Attr_A_001, color: is brown\nAttr_A_002, color: is red\nAttr_F_001, taste: tastes sweet\n".replace("Attr_", ""))
    (tmp_path / "images.txt").write_text("img, L1, a, b, images/x.jpg\n")
    (tmp_path / "label_list.txt").write_text("L1, fox\n")
    (tmp_path / "attributes_per_class.txt").write_text("L1, [ 0.5 0.25 1.0 ]\n")
    vocabulary = {r["label"]: r["index"] for r in S.attribute_vocabulary(spark, str(tmp_path)).collect()}
    assert vocabulary == {"brown": 0, "red": 1, "sweet": 123}
    images, labels, vectors = S.attribute_samples(spark, str(tmp_path))
    assert images.first()["image_relpath"] == "images/x.jpg" and labels.first()["class_name"] == "fox" and vectors.first()["scores"] == [0.5, 0.25, 1.0]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "choices": ["a"]}\n\n{"id": "2"}\n')
    assert [r["id"] for r in S.jsonl(spark, str(tmp_path / "a.jsonl"), LEGACY).collect()] == ["1", "2"]
    (tmp_path / "b.jsonl").write_text("{oops\n")
    with pytest.raises(ConstraintError):
        S.jsonl(spark, str(tmp_path / "b.jsonl"), LEGACY)
    got = spark.createDataFrame([('{"a": 1, "z": 2}',)], "v string").select(Q.key_violations(F.col("v"), ("a", "b")).alias("k")).first()["k"]
    assert sorted(got) == ["missing:b", "unknown:z"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "train_forget"), (2, "test_forget"), (3, "train_retain")], "id int, split string")
    W.write_splits(df, str(tmp_path))
    assert W.read_combined(spark, str(tmp_path), "train").count() == 2
    W.write_jsonl(df, str(tmp_path / "j"), single_file=True)
    assert spark.read.text(str(tmp_path / "j")).count() == 3
    (tmp_path / "f.json").write_text('{"forget_classes": [{"class": "b"}, "a"]}')
    assert S.forget_classes(str(tmp_path / "f.json")) == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    status = F.when(F.col("event_type") == "purchase", "correct").otherwise("incorrect")
    prepare = lambda df: M.timed(df.withColumn("response_status", status))
    batch = {r["start"]: r["attempted"] for r in M.windowed_accounting(prepare(src)).collect()}
    stream = M.windowed_accounting(prepare(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))))
    got = M.run_available(stream, "daily", str(tmp_path / "cp"), "complete")
    assert {r["start"]: r["attempted"] for r in got.collect()} == batch
