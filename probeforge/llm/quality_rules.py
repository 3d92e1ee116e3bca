"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text go.

A line fails by the first of these rules that applies (lines without a word are neither kept nor lost):
  symbols      more than one of ``#*$%&|<>`` for each four words
  punctuation  more than one ``!`` for each two words
  shouting     at least four words and no lower-case letter, though letters are there
  repetition   at least ten words of which under 30 % are different
  boilerplate  a notice phrase (``BOILERPLATE``) in a line of at most 20 words
  navigation   at most three words that end without ``.``, ``!``, ``?``, ``:``, a quote or a bracket
A document is kept unless the base test fails or lines with over ``max_lost`` of its word characters went.
The verdict is on the text as given; ``text`` of the result is what the failing lines leave, other lines as they stand.

Null text counts as the empty text: no words, base_failed. A repeated row gets a row each. Other columns
of the input are not read. Memory is that of one text and its word windows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeforge.llm.runtime import lean_batches, map_rows

SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "cookie", "javascript", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "licensed under", "subscribe to", "sign up", "log in", "click here", "share this", "read more",
)
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, lines bigint, lines_removed bigint, lost_chars bigint, kept boolean"
)
CLEANED_SCHEMA = SCHEMA + ", text string"
_words = re.compile(r"[^\x20\x09-\x0D]+")
_spaces = " \t\n\x0b\x0c\r"
_ends = (".", "!", "?", ":", '"', "'", ")", "]", "”", "»", "…")
_notice = re.compile("|".join(map(re.escape, BOILERPLATE)))


def line_fails(line: str, words: list[str]) -> str | None:
    """The rule that removes a line with at least one word, or None."""
    n = len(words)
    if 4 * sum(map(line.count, SYMBOLS)) > n:
        return "symbols"
    if 2 * line.count("!") > n:
        return "punctuation"
    if n >= 4 and (low := line.lower()) != line and line.upper() == line:
        return "shouting"
    if n >= 10 and 10 * len(set(words)) < 3 * n:
        return "repetition"
    if n <= 20 and _notice.search(line.lower()):
        return "boilerplate"
    if n <= 3 and not words[-1].endswith(_ends):
        return "navigation"
    return None


def repeated_words(words: list) -> int:
    """How many words lie in a three-word window that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n = covered = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def measure(text: str | None, max_lost: float = 0.5) -> tuple:
    """The columns of SCHEMA after doc_id."""
    text = text or ""
    seen: set[str] = set()
    all_words: list[str] = []
    dup = lines = removed = lost = 0
    chars = len(text) - sum(map(text.count, _spaces))
    for line in text.split("\n"):
        words = _words.findall(line)
        if not words:
            continue
        lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
        all_words += words
        if line_fails(line, words):
            removed += 1
            lost += sum(map(len, words))
    n = len(all_words)
    repeats = repeated_words(all_words)
    failed = n < 50 or 100 * repeats > 50 * n
    kept = not failed and lost <= max_lost * chars
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeats, failed, lines, removed, lost, kept


def cleaned(text: str | None) -> str | None:
    """The text of the lines that pass and of those without a word."""
    if text is None:
        return None
    out = []
    for line in text.split("\n"):
        words = _words.findall(line)
        if not words or not line_fails(line, words):
            out.append(line)
    return "\n".join(out)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5) -> DataFrame:
    """One row of CLEANED_SCHEMA for each row of ``docs``; no shuffle."""
    lean_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in CLEANED_SCHEMA.split(", ")]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(*measure(x, max_lost), cleaned(x)) for x in texts]
            columns = list(zip(*rows)) if rows else [()] * 11
            types = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, CLEANED_SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", max_lost: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that quality_rules keeps, with the text of the lines that pass; n_chars, if there, is that text's."""
    at = docs.columns.index(text_col)
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array([measure(x.as_py(), max_lost)[-1] for x in batch.column(at)], pa.bool_()))
        texts = [cleaned(x.as_py()) for x in batch.column(at)]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if sized is not None:
            columns[sized] = pa.array([None if x is None else len(x) for x in texts], batch.schema.field(sized).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_rows(docs, good)
