"""Best-fit packing of tokenised documents into sequences, with vector capacities.

Vector best-fit, decreasing: a sequence has three capacities (tokens, documents, attention cost = sum of
squared piece lengths). A piece goes, under every constraint, to the open sequence that fits it best: by
``score="norm"`` the one with the least weighted norm of what is left after it, by ``score="dot"`` the one with
the largest weighted dot product of the piece with what is left before it. Longer pieces go first.

A piece's demand depends on its length alone, so pieces of one length are alike, and the plan needs only how
many pieces each length has: at most ``max_tokens`` numbers, whatever the corpus. The driver packs this
histogram, moving whole intervals of like sequences at once, into a plan of some thousand rows; each piece
then finds its place from its rank among the pieces of its length. Ranks come from a count in each input
partition plus a running sum over (length, partition) counts. Nothing is packed apart, so no sequence
is left half empty at the border of a shard.

The registered query packs into as few sequences as it can, under sequences of 1024 tokens. Its document and attention
capacities (1024 and 1024²) are those that 1024 tokens imply, so only tokens bind there, and the two others break near-ties: any capacity that
binds costs sequences, as the README's figures show. ``Capacities`` takes others, under which all three bind.

Tokens: ids of the byte-level BPE file ``byte_bpe_50k.json`` of the public tokenizers, no special tokens added, then id 2.
A document longer than a sequence is cut into full pieces, of which the first takes the rest.
Null text counts as empty (the one id 2). A repeated row is packed again; null doc_id is kept; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeforge.llm.runtime import lean_batches, staged

END_ID = 2
MAX_TOKENS = 1024
#: Words whose ids a worker keeps: at most about 100 MB.
CACHED_WORDS = 300_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


class WordTokenizer:
    """Token ids of whole texts as little-endian uint32 bytes, equal to those of the tokenizers library.

    A single space between two other characters always begins a new unit of the pattern, so words between such spaces are
    encoded apart and kept. Where white space meets a space, the text is encoded whole. Text that holds the
    end-of-text marker goes to the tokenizers library, which reads the marker as a token.
    """

    def __init__(self, folder_file=None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = folder_file or public_tokenizers.path
        with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path("byte_bpe_50k.json"))
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text:
            return b""
        head, *words = text.split(" ")
        out = []
        for kept, prefix, some in ((self.first, "", [head]), (self.later, " ", words)):
            for word in some:
                ids = kept.get(word)
                if ids is None:
                    if not word or word[0].isspace() or word[-1].isspace():
                        return self._raw(text)
                    ids = self._raw(prefix + word)
                    if len(kept) < CACHED_WORDS and len(word) < 64:
                        kept[word] = ids
                out.append(ids)
        return b"".join(out)


_tokenizer: list[WordTokenizer] = []


def tokenizer() -> WordTokenizer:
    """One for each Python worker."""
    if not _tokenizer:
        _tokenizer.append(WordTokenizer())
    return _tokenizer[0]


def cut(ids: bytes, max_tokens: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; the first piece takes what full pieces leave."""
    n = len(ids) // 4
    at, piece = 0, 0
    end = n % max_tokens or min(n, max_tokens)
    while at < n:
        yield piece, at, end - at, zlib.crc32(ids[4 * at : 4 * end])
        at, end, piece = end, end + max_tokens, piece + 1


def tokenised_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """PIECES; nth: the piece's number, from 0, among those of its length in input partition ``part``."""
    end_id = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), [0] * (max_tokens + 1), tokenizer().encode
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece, start, length, crc in cut(encode(text.as_py() or "") + end_id, max_tokens):
                    rows.append((doc, piece, start, length, crc, part, seen[length]))
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, PIECES)


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds, and each dimension's weight in the score."""

    tokens: int = MAX_TOKENS
    documents: int = MAX_TOKENS
    attention: int = MAX_TOKENS * MAX_TOKENS
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    score: str = "norm"


def plan(histogram: dict[int, int], cap: Capacities = Capacities()) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces a sequence, offset of its first).

    Pieces of ``length`` with ranks from ``first`` up to ``end`` fill consecutive sequences from ``first sequence`` on,
    so many in each, one behind the other from ``offset``.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[tuple[int, int, int], list[list[int]]] = {}  # what is left -> intervals [first sequence, sequences]
    fresh = (cap.tokens, cap.documents, cap.attention)
    used = 0
    for length in sorted(histogram, reverse=True):
        need, rank, left = (length, 1, length * length), 0, histogram[length]
        if any(a > b for a, b in zip(need, fresh)):
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacities")

        def worth(state: tuple[int, int, int], need=need) -> float:
            if cap.score == "dot":
                return -sum(w * n / c * s / c for w, n, s, c in zip(cap.weights, need, state, fresh))
            return sum(w * ((s - n) / c) ** 2 for w, n, s, c in zip(cap.weights, need, state, fresh))

        for state in [*sorted((s for s in open_ if all(a <= b for a, b in zip(need, s))), key=worth), fresh]:
            each = min(s // n for s, n in zip(state, need))
            intervals = open_.pop(state, []) if state is not fresh else []
            while left and (intervals or state is fresh):
                first, count = intervals.pop() if intervals else (used, -(-left // each))
                used = max(used, first + count)
                full = min(count, left // each)
                placed = [(full, each)] if full else []
                if full < count and left > full * each:
                    placed.append((1, left - full * each))
                for bins, k in placed:
                    rows.append((length, rank, rank + bins * k, first, k, cap.tokens - state[0]))
                    rank, left = rank + bins * k, left - bins * k
                    after = tuple(s - k * n for s, n in zip(state, need))
                    if after[0] > 0 and after[1] > 0:
                        open_.setdefault(after, []).append([first, bins])
                    first, count = first + bins, count - bins
                if count:
                    intervals.append([first, count])
            if intervals:
                open_.setdefault(state, []).extend(intervals)
            if not left:
                break
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: Capacities = Capacities()) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    lean_batches(spark)
    pieces = staged(tokenised_pieces(docs, id_col, text_col, cap.tokens), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = staged(counts.withColumn("before", F.coalesce(before, F.lit(0))), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length, max_tokens at most
    rows = plan(totals, cap)
    table = {length: tuple(np.array([r[1:] for r in rows if r[0] == length], dtype=np.int64).T) for length in {r[0] for r in rows}}
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.value
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                length = int(lengths[some[0]])
                first, _, bins, each, at = plans[length]
                row = np.searchsorted(first, ranks[some], side="right") - 1
                nth = ranks[some] - first[row]
                sequence[some] = bins[row] + nth // each[row]
                offset[some] = at[row] + nth % each[row] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = pieces.join(counts.select("length", "part", "before"), ["length", "part"])
    return placed.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
