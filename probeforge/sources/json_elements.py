"""One large JSON document read by many tasks: a Data Source that splits it by byte ranges at element borders.

The document is an object with lists of objects or lists, such as ``{"images": [...], "annotations": [...]}``. A range of bytes
can start anywhere, inside a string for example. So each range is first summed up for both cases (it starts outside or inside a
string): does it end in the same case, and by how much does the nesting change. A prefix combination of these sums, two numbers a
range, says where each range starts; with that, each range finds the list it starts in. Then every range gives the elements
that begin in it, reading on to the end of the last one. Backslashes before a range are looked at where the file is read.
A range is looked at in blocks, so a task holds one block, the element that is open at its end and the rows of one batch.

Files are opened through ``pyarrow.fs``, so local folders and the object stores and HDFS that it knows can be read.
An element is found by its brackets; numbers and texts directly in a list are no elements. Elements are given as JSON text with
the offset of their first byte, whose order is the document's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range.
RANGE_BYTES = 16 << 20
#: Bytes of a block, the part of a range that is looked at at once.
BLOCK_BYTES = 1 << 20
#: Bytes read at first beyond a range, for its last element, and before a value or range, for a key or backslashes.
AROUND_BYTES = 1 << 16
_QUOTE, _BACKSLASH, _OPEN, _CLOSE, _LIST = ord('"'), ord("\\"), b"{[", b"}]", ord("[")
_KIND = np.zeros(256, dtype=np.int8)
_KIND[[*_OPEN]], _KIND[[*_CLOSE]], _KIND[_QUOTE] = 1, -1, 2


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def byte_size(path: str) -> int:
    system, at = filesystem(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


class ByteRanges:
    """Bytes of one file."""

    def __init__(self, path: str):
        system, at = filesystem(path)
        self.file = system.open_input_file(at)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        start, end = max(0, start), min(end, self.size)
        return self.file.read_at(end - start, start) if end > start else b""

    def backslashes_before(self, start: int) -> int:
        n = 0
        while start > n:
            some = self.read(start - n - AROUND_BYTES, start - n)
            run = len(some) - len(some.rstrip(b"\\"))
            n += run
            if run < len(some):
                break
        return n


def marks(data: bytes, escaped: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(position, kind: 1 opens, -1 closes, 2 quotation mark) of all brackets and of the quotation marks that are not escaped."""
    raw = np.frombuffer(data, dtype=np.uint8)
    kind = _KIND[raw]
    at = np.flatnonzero(kind)
    kind = kind[at]
    quotes = np.flatnonzero(kind == 2)
    after = quotes[(at[quotes] > 0) & (raw[at[quotes] - 1] == _BACKSLASH)]
    drop = []
    for q in after.tolist():
        end = int(at[q])
        n = 0
        while n < end and data[end - 1 - n] == _BACKSLASH:
            n += 1
        drop.append((n + (escaped if n == end else 0)) % 2 == 1)
    drop = after[np.array(drop, dtype=bool)] if len(after) else after
    if escaped and len(data) and data[0] == _QUOTE:
        drop = np.append(drop, 0)
    keep = np.ones(len(at), dtype=bool)
    keep[drop] = False
    return at[keep], kind[keep]


def blocks(source: ByteRanges, start: int, end: int, beyond: bool = False) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(offset, bytes, and positions and kinds as ``marks`` gives them) of the blocks of a range; ``beyond``: on to the end of the file, in growing steps."""
    escaped, step = source.backslashes_before(start) % 2 == 1, AROUND_BYTES
    end = min(end, source.size)
    while start < end or (beyond and start < source.size):
        data = source.read(start, min(start + BLOCK_BYTES, end) if start < end else start + step)
        yield start, data, *marks(data, escaped)
        run = len(data) - len(data.rstrip(b"\\"))
        escaped = (run + (escaped if run == len(data) else 0)) % 2 == 1
        step = step if start < end else max(step, min(2 * step, BLOCK_BYTES))
        start += len(data)


@dataclass
class Range:
    """A range of bytes and what it starts in."""

    start: int
    end: int
    inside: bool = False
    depth: int = 0
    key: str | None = None
    keys: tuple[str, ...] = ()


def structure(source: ByteRanges, r: Range, beyond: bool = False) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, bytes, and of the brackets outside strings: position, +1 or -1, depth after it) of the blocks of a range."""
    inside, depth = r.inside, r.depth
    for start, data, at, kind in blocks(source, r.start, r.end, beyond):
        quotes = kind == 2
        out = ~quotes & ((np.cumsum(quotes) + inside) % 2 == 0)
        after = depth + np.cumsum(kind[out])
        yield start, data, at[out], kind[out], after
        inside ^= bool(quotes.sum() % 2)
        depth = int(after[-1]) if len(after) else depth


def _summed(path: str, start: int, end: int) -> tuple[int, int, int]:
    """(parity of quotation marks, change of depth if the range starts outside a string, if inside)."""
    parity, sums = 0, [0, 0]
    for _, _, _, kind in blocks(ByteRanges(path), start, end):
        quotes = kind == 2
        odd = (np.cumsum(quotes) + parity) % 2 == 1
        change = np.where(quotes, 0, kind)
        sums[0] += int(change[~odd].sum())
        sums[1] += int(change[odd].sum())
        parity = (parity + int(quotes.sum())) % 2
    return parity, *sums


def _key_before(source: ByteRanges, at: int) -> str | None:
    """The key of the value that begins at ``at``, found in growing steps."""
    step = AROUND_BYTES
    while True:
        start = max(0, at - step)
        head = source.read(start, at).rstrip()
        if head and not head.endswith(b":"):
            return None
        head = head[:-1].rstrip()
        begin = len(head) - 1
        while begin > 0:
            begin = head.rfind(b'"', 0, begin)
            run = 0
            while run < begin and head[begin - 1 - run] == _BACKSLASH:
                run += 1
            if begin >= 0 and run % 2 == 0 and (run < begin or not start):
                return json.loads(head[begin:])
        if not start:
            return None
        step *= 2


def opened_lists(path: str, r: Range) -> list[tuple[int, str | None]]:
    """(position, key of the list; None for an object) of the values of the document's object that open in the range."""
    source = ByteRanges(path)
    return [(start + p, _key_before(source, start + p) if data[p] == _LIST else None) for start, data, at, change, depth in structure(source, r) for p in at[(depth == 2) & (change == 1)].tolist()]


def document_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[Range]:
    """The document's ranges with what each starts in; two passes by many tasks, a few numbers and keys a range to the driver."""
    size = byte_size(path)
    starts = list(range(0, size, range_bytes))
    count = max(1, len(starts))
    ids = spark.range(0, len(starts), numPartitions=count)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *_summed(path, i * range_bytes, min(size, (i + 1) * range_bytes))) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["id", "parity", "outside", "inside"])

    ranges, inside, depth = [], False, 0
    for r in sorted(ids.mapInArrow(summed, "id long, parity long, outside long, inside long").collect()):  # a row a range
        ranges.append(Range(r["id"] * range_bytes, min(size, (r["id"] + 1) * range_bytes), inside, depth))
        depth += r["inside"] if inside else r["outside"]
        inside ^= bool(r["parity"])
    if inside or depth or not ranges:
        raise ValueError(f"{path} is no whole JSON document")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [[k for _, k in opened_lists(path, ranges[i])] for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.string()))], names=["id", "keys"])

    key = None
    for r in sorted(ids.mapInArrow(opened, "id long, keys array<string>").collect(), key=lambda r: r["id"]):
        one = ranges[r["id"]]
        one.key, one.keys = key, tuple(k for k in r["keys"] if k)
        key = r["keys"][-1] if r["keys"] else key
    return ranges


def elements(path: str, r: Range, key: str) -> Iterator[tuple[int, str]]:
    """(offset, JSON text) of the elements of the list ``key`` that begin in the range."""
    source, name, begin, pieces = ByteRanges(path), r.key, None, []
    for start, data, at, change, depth in structure(source, r, beyond=True):
        own = 0  # where the open element's bytes begin in this block
        found = ((depth == 2) | (depth == 3) & (change == 1)).nonzero()[0]
        for p, opens, level in zip(at[found].tolist(), (change[found] == 1).tolist(), depth[found].tolist()):
            if not opens:  # an element ends
                if begin is not None:
                    pieces.append(data[own : p + 1])
                    yield begin, b"".join(pieces).decode()
                    begin, pieces = None, []
            elif start >= r.end:  # only the open element goes on beyond the range
                return
            elif level == 2:
                name = _key_before(source, start + p) if data[p] == _LIST else None
            elif name == key:
                begin, own = start + p, p
        if begin is not None:
            pieces.append(data[own:])
        elif start + len(data) >= r.end:
            return
    if begin is not None:
        raise ValueError(f"the element at byte {begin} has no end")


class _Part(InputPartition):
    def __init__(self, given: dict):
        super().__init__(given)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key, self.ranges = options["path"], options["key"], json.loads(options["ranges"])

    def partitions(self) -> list[InputPartition]:
        return [_Part(r) for r in self.ranges] or [_Part({})]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        offsets, texts, held = [], [], 0
        for offset, text in elements(self.path, Range(**partition.value), self.key):
            offsets.append(offset), texts.append(text)
            held += len(text)
            if held > 4 << 20 or len(texts) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], names=["offset", "element"])
                offsets, texts, held = [], [], 0
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], names=["offset", "element"])


class JsonElements(DataSource):
    """``spark.read.format("json_elements")``: (offset, element) of one list of a JSON document; options path, key and ranges."""

    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "offset bigint, element string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_elements(spark: SparkSession, path: str, key: str, schema: T.StructType | str, ranges: list[Range] | None = None) -> DataFrame:
    """(offset, and the fields of ``schema``) of the elements of one list; ranges that hold none of it are not read. A malformed element raises."""
    ranges = document_ranges(spark, path) if ranges is None else ranges
    used = [vars(r) | {"keys": list(r.keys)} for r in ranges if key == r.key or key in r.keys]
    spark.dataSource.register(JsonElements)
    rows = spark.read.format("json_elements").option("key", key).option("ranges", json.dumps(used)).option("path", path).load()
    return rows.select("offset", F.from_json("element", schema, {"mode": "FAILFAST"}).alias("e")).select("offset", "e.*")
