"""Chat formatting: records of any known layout, told by the fingerprint of their field paths, become turns and a training text.

A record's schema is the set of its nested field paths (``messages[].role``); their sorted list is hashed. A ``Layout`` is a
declarative mapping from such paths to turns: a list of items with a role and a text field, fields each of one role, or
lists of pairs. A record whose fingerprint is a layout's own (or its form without items) is that layout; else paths no layout
names are left out and the rest is hashed again; else the layout with most of its paths present is taken (the first of equal
ones). Decisions are kept by fingerprint. A record with no layout, or no JSON, yields a row of layout null without turns.

A turn is written ``### role: text</turn>`` and a newline, with ``\\`` for a backslash, ``\\e`` for a ``</turn>``, ``\\h`` for a
``### `` and, in roles, ``\\c`` for a colon inside: so the marks never occur in a text and all is read back exactly. The loss mask is
the spans, in code points, of the escaped assistant texts.

Conversations of any length: ``as_records`` makes records of at most ``PART_TURNS`` turns and about ``PART_CHARS`` code points, and
``read_back`` streams the parts of a conversation in order through running digests, so that no conversation is held whole.

Defined results: null role or text is empty; turns are in the order of turn (null first), then role, then text; equal rows are
turns of their own; rows with a null id form one conversation, of null id; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeforge.llm.runtime import lean_batches

PART_TURNS = 64
PART_CHARS = 1 << 20
#: Fingerprints whose layout a worker keeps.
KEPT_SHAPES = 10_000
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Layout:
    """``items``: path of a list of turns with ``role`` and ``text`` fields ("" for a list of pairs: user, then assistant).
    ``fields``: (role, path) of single texts, in order; ``after``: some of them follow the items. ``joined``: fields added to the one before."""

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    joined: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    pairs: bool = False

    def paths(self) -> frozenset[str]:
        inner = {f"{self.items}[][]"} if self.pairs else {f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"} if self.items else set()
        return frozenset(inner | {p for _, p in self.fields} | set(self.joined))

    def shapes(self) -> set[frozenset[str]]:
        """The sets of paths that are this layout: with or without optional fields, and with an empty list."""
        found = {self.paths()}
        for p in self.optional:
            found |= {s - {p} for s in found}
        if self.items:
            found |= {frozenset(p for p in s if not p.startswith(f"{self.items}[")) | {f"{self.items}[]"} for s in found}
        return found

    def turns(self, record: dict) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        listed = record.get(self.items) or [] if self.items else []
        for role, path in (f for f in self.fields if f[0] == "system"):
            if record.get(path) is not None:
                out.append((role, _text(record[path])))
        for x in listed:
            if self.pairs:
                out += zip(("user", ASSISTANT), map(_text, x))
            else:
                role = _text(x.get(self.role))
                out.append((self.roles.get(role, role), _text(x.get(self.text))))
        for role, path in (f for f in self.fields if f[0] != "system"):
            text = _text(record.get(path))
            out.append((role, text))
            if role == "user":
                more = [t for t in (_text(record.get(p)) for p in self.joined) if t]
                out[-1] = (role, "\n\n".join([text, *more]))
        return out


def _text(value: Any) -> str:
    """A text, the texts of a list of content parts, or JSON of anything else."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list) and all(isinstance(x, dict) and isinstance(x.get("text"), str) for x in value):
        return "".join(x["text"] for x in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


#: The layouts known, most usual first.
LAYOUTS = (
    Layout("messages", items="messages", role="role", text="content"),
    Layout("share", items="conversations", role="from", text="value", roles={"human": "user", "gpt": ASSISTANT, "system": "system"}),
    Layout("instruction", fields=(("user", "instruction"), (ASSISTANT, "output")), joined=("input",), optional=("input",)),
    Layout("prompt", fields=(("system", "system"), ("user", "prompt"), (ASSISTANT, "completion")), optional=("system",)),
    Layout("response", fields=(("system", "system"), ("user", "prompt"), (ASSISTANT, "response")), optional=("system",)),
    Layout("question", fields=(("system", "system_prompt"), ("user", "question"), (ASSISTANT, "response")), optional=("system_prompt",)),
    Layout("history", items="history", pairs=True, fields=(("system", "system"), ("user", "query"), (ASSISTANT, "response")), optional=("system",)),
    Layout("turns", items="turns", role="role", text="text"),
)


def field_paths(value: Any, at: str = "") -> set[str]:
    """The nested paths of a record's leaves; list elements share one path, an empty list or object is a leaf of its own."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    """Sixteen hexadecimal digits of the sorted paths' SHA-256."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class LayoutTable:
    """Layouts by fingerprint."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.layouts = layouts
        self.exact: dict[str, Layout] = {}
        for layout in reversed(layouts):  # the first of two with one shape has it
            self.exact |= {fingerprint(s): layout for s in layout.shapes()}
        # fields below a path count with it: the parts of a text made of parts
        self.named = frozenset(p for layout in layouts for s in layout.shapes() for p in s)
        self.found: dict[str, Layout | None] = {}

    def _base(self, path: str) -> str | None:
        while path not in self.named:
            cut = max(path.rfind("."), path.rfind("[]"))
            if cut <= 0:
                return None
            path = path[:cut]
        return path

    def resolve(self, paths: set[str]) -> tuple[str, Layout | None]:
        key = fingerprint(paths)
        if key in self.exact:
            return key, self.exact[key]
        if key not in self.found:
            known = {b for p in paths if (b := self._base(p))}
            layout = self.exact.get(fingerprint(known))
            if layout is None:
                fit = [(len(s & known), -i, x) for i, x in enumerate(self.layouts) for s in x.shapes() if s <= known]
                layout = max(fit, key=lambda f: f[:2])[2] if fit else None
            if len(self.found) >= KEPT_SHAPES:
                self.found.clear()
            self.found[key] = layout
        return key, self.found[key]

    def turns(self, text: str | None) -> tuple[str | None, str | None, list[tuple[str, str]]]:
        """(fingerprint, layout's name, turns) of a record in JSON."""
        try:
            record = json.loads(text or "")
        except ValueError:
            return None, None, []
        if not isinstance(record, dict):
            return None, None, []
        key, layout = self.resolve(field_paths(record))
        try:
            return key, layout.name if layout else None, layout.turns(record) if layout else []
        except (AttributeError, TypeError):  # right paths, other kinds of values
            return key, None, []


_CODES = {"\\": "\\\\", "</turn>": "\\e", "### ": "\\h", ":": "\\c"}
_PLAIN = {v[1]: k for k, v in _CODES.items()}
_in_text, _in_role, _escaped = re.compile(r"\\|</turn>|### "), re.compile(r"\\|</turn>|### |:"), re.compile(r"\\(.)")
_turn = re.compile(r"### ([^:]*): (.*?)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_in_role if role else _in_text).sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: _PLAIN[m[1]], text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, loss spans in code points) of turns."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, role=True)}: ", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns that ``formatted`` wrote."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(text)]


def format_records(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with the column of JSON replaced by fingerprint, layout, n_turns, formatted and loss_spans; rows stay where they are."""
    lean_batches(records.sparkSession)
    kept = [c for c in records.columns if c != record_col]
    plain = records.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{record_col}`").cast("string").alias("r"))
    kinds = [f"k{i} {k}" for i, k in enumerate(dict(records.dtypes)[c] for c in kept)] + ["fingerprint string, layout string, n_turns int, formatted string, loss_spans array<struct<start:int,end:int>>"]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = LayoutTable(layouts)
        for batch in batches:
            keys, names, number, texts, marks = [], [], [], [], []
            for x in batch.column(len(kept)):
                key, name, turns = table.turns(x.as_py())
                text, loss = formatted(turns)
                keys.append(key), names.append(name), number.append(len(turns)), texts.append(text), marks.append([{"start": a, "end": b} for a, b in loss])
            new = [pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(number, pa.int32()), pa.array(texts, pa.string()), pa.array(marks, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[f"k{i}" for i in range(len(kept))] + ["fingerprint", "layout", "n_turns", "formatted", "loss_spans"])

    out = plain.mapInArrow(run, ", ".join(kinds))
    return out.toDF(*kept, "fingerprint", "layout", "n_turns", "formatted", "loss_spans")


def as_records(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, record): turn rows as JSON records in layouts that differ from conversation to conversation.

    A part of exactly user and assistant is written as prompt, instruction or question and answer, one of system, user
    and assistant with a system field; others as lists of messages in one of three layouts. All rows of a conversation are in
    one partition of the result. One shuffle, by conv_id.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text")).repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1).withColumn("chars", F.sum(F.length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = [F.floor(F.col("pos") / PART_TURNS).alias("block"), F.floor((F.col("chars") - F.length("text")) / PART_CHARS).alias("stretch")]
    listed = rows.groupBy("conv_id", *part).agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    pick = F.pmod(F.xxhash64("conv_id", "block"), F.lit(3))
    roles, t = F.col("turns.role"), [F.col("turns")[i]["text"] for i in range(3)]

    def items(name: str, role: str, text: str, rename=lambda r: r) -> Column:
        return F.to_json(F.struct(F.transform("turns", lambda x: F.struct(rename(x["role"]).alias(role), x["text"].alias(text))).alias(name)))

    def single(**fields: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    def share(r: Column) -> Column:
        return F.when(r == "user", "human").when(r == ASSISTANT, "gpt").otherwise(r)

    plain_roles = F.forall(roles, lambda r: r.isin("system", "user", ASSISTANT))
    two = roles == F.array(F.lit("user"), F.lit(ASSISTANT))
    three = roles == F.array(F.lit("system"), F.lit("user"), F.lit(ASSISTANT))
    record = (
        F.when(two & (pick == 0), single(prompt=t[0], completion=t[1])).when(two & (pick == 1), single(instruction=t[0], input=F.lit(""), output=t[1])).when(two, single(question=t[0], response=t[1]))
        .when(three & (pick == 0), single(system=t[0], prompt=t[1], response=t[2])).when(three & (pick == 1), single(system_prompt=t[0], question=t[1], response=t[2]))
        .when(plain_roles & (pick == 0), items("conversations", "from", "value", share)).when(pick == 1, items("turns", "role", "text")).otherwise(items("messages", "role", "content"))
    )
    return listed.select("conv_id", F.struct("block", "stretch").alias("part"), record.alias("record"))


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of conversations, read from (conv_id, part, formatted, loss_spans) alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. The parts of a conversation must share a partition.
    """
    lean_batches(parts.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = (), None, []

        def close():
            if state:
                done.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != (conv,):
                    close()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parsed(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    lost = unescape(text[span["start"] : span["end"]])
                    state[2] += len(lost)
                    state[3].update(lost.encode())
                state[4] += len(text)
            if len(done) >= 1000:
                yield flush()
                done.clear()
        close()
        if done:
            yield flush()

    return parts.sortWithinPartitions("conv_id", "part").select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
