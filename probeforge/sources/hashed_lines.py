"""JSON lines with digests made as they are written: a Data Source writer whose commit messages carry each part's SHA-256 and rows.

Each task writes one part below ``_writing-<id>`` and sends its digest, rows and bytes with its commit message. The driver's commit
moves the parts that were reported into place, in the order of the partitions, and writes ``_parts.json``; what a failed attempt
left goes with the folder. If a task fails for good, abort removes the folder, and what the path held before stays as it was.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from probeforge.sources.json_elements import filesystem

PARTS = "_parts.json"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    rows: int
    bytes: int
    sha256: str
    content: int = 0


def _number(line: str) -> int:
    """The first 60 bits of a line's SHA-256."""
    return int(hashlib.sha256(line.encode()).hexdigest()[:15], 16)


def content_of(df: DataFrame) -> dict:
    """rows and content of a table that is not written: the sum of its lines' numbers, the same in any order and partitioning."""
    line = F.conv(F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(line), F.lit(0))).first()
    return {"rows": rows, "content": int(total)}


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.folder = path.rstrip("/"), overwrite, f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, at = filesystem(self.folder)
        system.create_dir(at, recursive=True)
        context = TaskContext.get()
        part = Part(context.partitionId(), f"{at}/{context.partitionId():05d}-{context.taskAttemptId()}.jsonl", 0, 0, "")
        digest = hashlib.sha256()
        with system.open_output_stream(part.file) as out:
            for batch in iterator:
                texts = batch.column(0).to_pylist()
                data = "".join(x + "\n" for x in texts).encode()
                digest.update(data)
                out.write(data)
                part.rows += len(texts)
                part.content += sum(map(_number, texts))
                part.bytes += len(data)
        part.sha256 = digest.hexdigest()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        system, at = filesystem(self.path)
        before = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
        number = 0
        if self.overwrite:
            for file in before:
                system.delete_file(file)
        else:
            number = sum(f.endswith(".jsonl") for f in before)
        written = []
        for p in parts:
            if p.rows:
                name = f"part-{number + len(written):05d}.jsonl"
                system.move(p.file, f"{at}/{name}")
                written.append({"file": name, "rows": p.rows, "bytes": p.bytes, "sha256": p.sha256, "content": p.content})
        with system.open_output_stream(f"{at}/{PARTS}") as out:
            out.write(json.dumps(written, indent=2).encode())
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, at = filesystem(self.folder)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class HashedLines(DataSource):
    """``df.write.format("hashed_lines")``: one string column, a line each; option path."""

    @classmethod
    def name(cls) -> str:
        return "hashed_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def write_hashed_lines(df: DataFrame, path: str) -> dict:
    """``df`` as JSON lines below ``path``, in place of what was there; rows, sha256 (of the parts' digests in order), content and parts."""
    spark = df.sparkSession
    spark.dataSource.register(HashedLines)
    system, at = filesystem(path)
    system.create_dir(at, recursive=True)
    df.select(F.to_json(F.struct("*")).alias("value")).write.format("hashed_lines").mode("overwrite").option("path", path).save()
    with system.open_input_stream(f"{at}/{PARTS}") as f:
        parts = json.loads(f.read())
    return {"rows": sum(p["rows"] for p in parts), "sha256": hashlib.sha256("".join(p["sha256"] for p in parts).encode()).hexdigest(), "content": sum(p["content"] for p in parts), "parts": parts}


def read_hashed_lines(df: DataFrame, path: str) -> DataFrame:
    """What ``write_hashed_lines`` wrote of a table like ``df``."""
    return df.sparkSession.read.schema(df.schema).json(f"{path.rstrip('/')}/part-*.jsonl") if _any_part(path) else df.limit(0)


def _any_part(path: str) -> bool:
    system, at = filesystem(path)
    return any(f.base_name.startswith("part-") for f in system.get_file_info(fs.FileSelector(at)))
