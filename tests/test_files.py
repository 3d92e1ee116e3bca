"""One large file read by many tasks: JSON documents by byte ranges, line numbers by blocks."""

import gzip
import json
import random
import tracemalloc

import pytest

from probeforge import cli
from probeforge.schema import ITEM, LEGACY, ConstraintError
from probeforge.sources import json_elements as J
from probeforge.sources import readers as S

BITS = ['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", '\\"', "\\\\"]


def value(rng, depth=0):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choices(BITS, k=rng.randrange(12)))
    if kind < 0.5 or depth > 3:
        return rng.choice([None, 7, True])
    if kind < 0.75:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choices(BITS, k=3)): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def document(rng, n):
    doc = {"info": {"x": [{"a": 1}], "images": [{"q": 2}]}, 'imag"]es\\': [{"no": 1}], "annotations": [{"image_id": i, "note": value(rng)} for i in range(n)], "note": '[{"x"', "images": [[value(rng)] if i % 3 else {"j": value(rng)} for i in range(5)], "n": 5}
    return {k: doc[k] for k in rng.sample(list(doc), len(doc))}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 1000])
def test_elements_of_any_range(tmp_path, size, monkeypatch):
    """Ranges that begin inside strings, escapes, keys and elements give each element once."""
    rng, path = random.Random(size), str(tmp_path / "d.json")
    for trial in range(40):
        monkeypatch.setattr(J, "AROUND_BYTES", rng.choice([64, 1 << 16]))
        doc = document(rng, rng.randrange(8))
        text = json.dumps(doc, ensure_ascii=trial % 2 == 0, indent=rng.choice([None, 1])).encode()
        (tmp_path / "d.json").write_bytes(text)
        ranges, inside, depth, key = [], False, 0, None
        for start in range(0, len(text), size):
            one = J.Range(start, min(len(text), start + size), inside, depth)
            parity, outside, within = J._summed(path, one.start, one.end)
            keys = [k for _, k in J.opened_lists(path, one)]
            one.key, one.keys = key, tuple(k for k in keys if k)
            key, depth, inside = keys[-1] if keys else key, depth + (within if inside else outside), inside ^ bool(parity)
            ranges.append(one)
        assert depth == 0 and not inside
        for name in ("annotations", "images", 'imag"]es\\'):
            found = [x for r in ranges if name == r.key or name in r.keys for x in J.elements(path, r, name)]
            assert [json.loads(t) for _, t in found] == doc[name] and [o for o, _ in found] == sorted(o for o, _ in found)


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_blocks_of_any_size(tmp_path, block, monkeypatch):
    """Ranges looked at in blocks that end inside strings, escapes, keys and elements give each element once."""
    monkeypatch.setattr(J, "BLOCK_BYTES", block)
    test_elements_of_any_range(tmp_path, 50, monkeypatch)


def test_long_keys(tmp_path, monkeypatch):
    """A key with quotation marks that begins further before its list than is read at first."""
    monkeypatch.setattr(J, "AROUND_BYTES", 16)
    name, path = 'k"\\' * 30, str(tmp_path / "d.json")
    text = json.dumps({"a": 1, name: [{"i": 0}, {"i": 1}]}).encode()
    (tmp_path / "d.json").write_bytes(text)
    at = text.index(b"[")
    r = J.Range(at, len(text), False, 1, None, (name,))
    assert J.opened_lists(path, r) == [(at, name)] and [json.loads(x) for _, x in J.elements(path, r, name)] == [{"i": 0}, {"i": 1}]


def test_memory_of_a_range(tmp_path, monkeypatch):
    """A task's memory is a block's, not its range's; elements are given out as they end."""
    monkeypatch.setattr(J, "BLOCK_BYTES", 1 << 16, raising=False)
    path, peaks = str(tmp_path / "d.json"), []
    for n in (5_000, 40_000):
        text = json.dumps({"annotations": [{"image_id": i, "note": 'a } "quoted" ] text\\', "bbox": [i]} for i in range(n)]}).encode()
        (tmp_path / "d.json").write_bytes(text)
        size, r = len(text), J.Range(0, len(text), keys=("annotations",))
        del text
        tracemalloc.start()
        assert J._summed(path, 0, size)[:2] == (0, 0) and J.opened_lists(path, r) == [(16, "annotations")]
        assert sum(1 for _ in J.elements(path, r, "annotations")) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert size > 40 << 16 and peaks[1] < 1.2 * peaks[0], peaks


def test_elements_by_many_tasks(spark, tmp_path):
    rng, path = random.Random(9), str(tmp_path / "d.json")
    doc = document(rng, 2000)
    (tmp_path / "d.json").write_text(json.dumps(doc))
    ranges = J.document_ranges(spark, path, 2000)
    got = J.read_elements(spark, path, "annotations", "image_id long, note string", ranges)
    assert got.rdd.getNumPartitions() > 20
    assert [r["image_id"] for r in got.orderBy("offset").collect()] == list(range(2000))
    assert J.read_elements(spark, f"file://{path}", "nothing", "a int").count() == 0
    (tmp_path / "d.json").write_text(json.dumps(doc)[:-1])
    with pytest.raises(ValueError, match="no whole JSON document"):
        J.document_ranges(spark, path, 2000)
    (tmp_path / "d.json").write_text('{"annotations": [{"image_id": oops}]}')
    with pytest.raises(Exception, match="(?i)malformed"):
        J.read_elements(spark, path, "annotations", "image_id long").collect()


@pytest.mark.parametrize("end, packed", [("\n", False), ("\r\n", False), ("\n", True)])
def test_line_numbers(spark, tmp_path, end, packed):
    """Files of many blocks, with blank lines and CRLF; a gzip file is one block."""
    rng = random.Random(1)
    lines = {f"f{i}": ["" if rng.random() < 0.1 else f"{i}-{j} " + "x" * rng.randrange(60) for j in range(n)] for i, n in enumerate((1, 400, 0, 900))}
    for name, some in lines.items():
        data = "".join(x + end for x in some).encode()
        (tmp_path / (name + (".txt.gz" if packed else ".txt"))).write_bytes(gzip.compress(data) if packed else data)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "1024")
    try:
        rows = S.numbered_lines(spark, str(tmp_path))
        assert packed or rows.rdd.getNumPartitions() > 4
        got = sorted((r["file"].split("/")[-1].split(".")[0], r["line"], r["value"]) for r in rows.collect())
    finally:
        spark.conf.set(key, before)
    assert got == sorted((name, i + 1, x) for name, some in lines.items() for i, x in enumerate(some))


def test_malformed_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\r\n\r\n{"id": "2"}\r\n{oops\r\n[3]\r\n')
    with pytest.raises(ConstraintError) as e:
        S.jsonl(spark, str(tmp_path / "a.jsonl"), LEGACY)
    assert [x.split("/")[-1].split(":", 1)[1] for x in e.value.rows] == ["4: {oops", "5: [3]"] and "a.jsonl:4: {oops" in str(e.value)
    assert [(r["line"], r["id"]) for r in S.jsonl(spark, str(tmp_path / "a.jsonl"), LEGACY, strict=False, numbered=True).orderBy("line").collect() if r["id"]] == [(1, "1"), (3, "2")]
    assert S.jsonl_rejects(spark, str(tmp_path / "a.jsonl"), LEGACY).count() == 2


def test_command_line_names_lines(spark, tmp_path, capsys):
    from tests.test_pool_cli import record

    (tmp_path / "pool.jsonl").write_text("\n".join(["", *(json.dumps(record(i, **({"image": ""} if i in (3, 5) else {}))) for i in range(12))]))
    told = ["--input", str(tmp_path / "pool.jsonl"), "--dataset-id", "d", "--source-version", "1", "--license-id", "cc", "--redistribution", "yes", "--provenance-note", "made", "--split", "utility"]
    assert cli.main(["migrate", *told, "--output", str(tmp_path / "items")]) == 2
    said = capsys.readouterr().err
    assert "pool.jsonl:5: 3: empty image" in said and "pool.jsonl:7: 5: empty image" in said
    assert cli.main(["migrate", *told, "--output", str(tmp_path / "items"), "--allow-rejects", "--skip-answer-balance-check"]) == 0
    items = [json.loads(x) for f in sorted((tmp_path / "items").glob("part-*")) for x in f.read_text().splitlines()]
    items[2]["question"] = " "
    (tmp_path / "items.jsonl").write_text("\n".join(map(json.dumps, items)))
    assert cli.main(["validate", "items", str(tmp_path / "items.jsonl")]) == 2
    assert "items.jsonl:3: " + items[2]["item_id"] in capsys.readouterr().err
    assert S.jsonl(spark, str(tmp_path / "items.jsonl"), ITEM).count() == 10
