"""Importance resampling towards a target corpus, over hashed word n-grams whose CRCs are composed, not computed.

A word's CRC-32 is taken once. Appending n zero bytes to a message is a linear map over GF(2) of its CRC, the n-th power of
one 32 x 32 bit matrix; so the CRC of a run of words joined by spaces follows from the CRCs and lengths of its words, by the
matrices of 1, 2, 4, ... bytes (as four tables of 256 entries each), and no n-gram's string is ever made.

With s of S features of the documents and t of T of the target in a bucket, its gain is
floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for B buckets; a document's weight is the sum of its features' gains, and its score
adds a Gumbel number of its id in thousandths, so that the highest scores are a draw without replacement by weight.

Each partition adds its buckets up before anything is shuffled; the gains (B numbers) are all that the driver gathers of
the corpus, and one number of rows for each range partition. Ranks come from a range partitioning by (score, id) and the
rows of the partitions before, so no task sorts all documents. Texts are read in slices of about a megabyte.

Defined results: null text has no words; weight 0 without features; rows with a null id are weighed, but have no score, no
rank, and are no candidates; repeated rows have a row each, in any order between equal ones; without target texts
T = t = 0; an empty table has no rows. Columns other than the two named play no part.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeforge.llm.runtime import lean_batches, map_rows, staged
from probeforge.llm.textio import binary_column, slices

#: Bytes of text whose words are held at a time.
SLICE = 1 << 20
_CRC_POLYNOMIAL = 0xEDB88320
_SPACE_CRC = zlib.crc32(b" ")
#: Lower-case ASCII letters, digits and all bytes of other characters as they are; everything else parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _tables(columns: np.ndarray) -> np.ndarray:
    """Four tables, one for each byte of a CRC, of the linear map whose images of the 32 bits are ``columns``."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([np.bitwise_xor.reduce(np.where(bits, columns[8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)]).astype(np.uint32)


def _apply(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    return tables[0][crcs & 255] ^ tables[1][(crcs >> 8) & 255] ^ tables[2][(crcs >> 16) & 255] ^ tables[3][crcs >> 24]


def _one_zero_bit() -> np.ndarray:
    """What one more zero bit makes of each bit of a CRC."""
    return np.array([_CRC_POLYNOMIAL] + [1 << i for i in range(31)], dtype=np.uint32)


_shifts: list[np.ndarray] = []


def _shift_table(k: int) -> np.ndarray:
    """The map of 2**k zero bytes, by squaring."""
    if not _shifts:
        columns = _one_zero_bit()
        for _ in range(3):  # eight bits
            columns = _apply(_tables(columns), columns)
        _shifts.append(_tables(columns))
    while len(_shifts) <= k:
        last = _shifts[-1]
        _shifts.append(_tables(_apply(last, _apply(last, np.uint32(1) << np.arange(32, dtype=np.uint32)))))
    return _shifts[k]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as its length says."""
    out, left, k = crcs.copy(), np.asarray(lengths, dtype=np.int64), 0
    while left.any():
        at = np.flatnonzero(left & 1)
        out[at] = _apply(_shift_table(k), out[at])
        left, k = left >> 1, k + 1
    return out


def combined(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of two messages in a row, from the CRC of each and the second's length."""
    return shifted(first, lengths) ^ second


def gram_crcs(rows: np.ndarray, crcs: np.ndarray, lengths: np.ndarray, max_n: int, seen: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, CRC) of every run of 1 to ``max_n`` words of one row; runs inside the first ``seen`` words are left out."""
    now, ones = crcs, np.ones(len(crcs), dtype=np.int64)
    for n in range(1, max_n + 1):
        if n > 1:
            k = len(crcs) - n + 1
            if k <= 0:
                return
            spaced = combined(now[:k], np.full(k, _SPACE_CRC, dtype=np.uint32), ones[:k])
            now = combined(spaced, crcs[n - 1 :], lengths[n - 1 :])
        at = max(0, seen - n + 1)
        own = rows[at : len(now)] == rows[at + n - 1 :]
        yield rows[at : len(now)][own], now[at:][own]


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` (words parted by spaces) in pieces of about SLICE bytes that end between words."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def features(column: pa.Array, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, CRC, n) of all runs of 1 to ``max_n`` words of the texts, slice by slice."""
    column = binary_column(column)
    for a, b in slices(column, SLICE):
        kept = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = [column[i].as_py().translate(_WORD_BYTES) for i in range(a, b)]
        for part in [texts] if b - a > 1 else [[p] for p in _pieces(texts[0])]:
            words = [t.split() for t in part]
            flat = [w for some in words for w in some] if len(words) > 1 else words[0]
            rows = np.repeat(np.arange(a, b), [len(some) for some in words])
            crcs = np.fromiter(map(zlib.crc32, flat), dtype=np.uint32, count=len(flat))
            lengths = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
            seen = len(kept[0])  # the last words of the piece before
            if seen:
                rows, crcs, lengths = np.concatenate([np.full(seen, a), rows]), np.concatenate([kept[0], crcs]), np.concatenate([kept[1], lengths])
            for n, (r, c) in enumerate(gram_crcs(rows, crcs, lengths, max_n, seen), 1):
                yield r, c, n
            if b - a == 1 and max_n > 1:
                kept = crcs[1 - max_n :], lengths[1 - max_n :]


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """How many features of all ``texts`` are in each bucket."""
    lean_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, crcs, _ in features(batch.column(0), max_n):
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():  # a row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gumbel_part(seed: int, doc_id: int) -> int:
    """floor(-1000 ln(-ln u)) for u from the first 32 bits of SHA-256 of ``seed:doc_id``."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


@dataclass(frozen=True)
class ImportanceModel:
    """A gain for each bucket: bounded by the number of buckets, whatever the corpus."""

    gains: np.ndarray
    max_n: int = 2
    seed: int = 2024

    def weigh(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, features, weight) of each text."""
        words, number, weight = (np.zeros(len(column), dtype=np.int64) for _ in range(3))
        for rows, crcs, n in features(column, self.max_n):
            if len(rows):
                low = int(rows[0])
                count = np.bincount(rows - low)
                span = slice(low, low + len(count))
                number[span] += count
                if n == 1:
                    words[span] += count
                # whole numbers far below 2**53: the doubles of bincount add them without error
                weight[span] += np.bincount(rows - low, weights=self.gains[crcs % np.uint32(len(self.gains))]).astype(np.int64)
        return words, number, weight

    def scores(self, ids: list, weight: np.ndarray) -> list:
        return [None if i is None else w + gumbel_part(self.seed, i) for i, w in zip(ids, weight.tolist())]


def fit_importance(docs: DataFrame, target: DataFrame, max_n: int = 2, buckets: int = 10_000, seed: int = 2024, text_col: str = "text", target_col: str = "text") -> ImportanceModel:
    """The gains from all texts of ``docs`` and ``target``."""
    s, t = bucket_counts(docs, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets)
    all_s, all_t = int(s.sum()), int(t.sum())
    gains = [math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist())]
    return ImportanceModel(np.array(gains, dtype=np.int64), max_n, seed)


def importance_scores(docs: DataFrame, model: ImportanceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score for each row."""
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            words, number, weight = m.weigh(batch.column(1))
            columns = [batch.column(0), pa.array(words), pa.array(number), pa.array(weight), pa.array(m.scores(batch.column(0).to_pylist(), weight), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


def ranked(scores: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """``scores`` with rank: 1, 2, 3, ... for floor(percent * N / 100) of the N candidates, by falling score, then rising doc_id."""
    spark = scores.sparkSession
    all_rows = staged(scores.withColumn("at", F.monotonically_increasing_id()), "importance-scores")
    able = F.coalesce((F.col("n_words") >= min_words) & F.col("score").isNotNull(), F.lit(False))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("at")]  # the last one parts equal rows, however many they are
    parts = staged(all_rows.where(able).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "importance-ranges")
    before, offsets = 0, []
    for r in parts.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each partition
        offsets.append((r["part"], before))
        before += r["n"]
    most = percent * before // 100
    drawn = [x for x in offsets if x[1] < most]
    columns = [F.col(c) for c in ("doc_id", "n_words", "n_features", "weight", "score")]
    if not drawn:
        return all_rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    after = F.broadcast(spark.createDataFrame(drawn, "part int, offset long"))
    place = F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    top = parts.join(after, "part").select(*columns, F.when(place <= most, place).alias("rank"))
    rest = parts.where(F.col("part") > drawn[-1][0]).unionByName(all_rows.where(~able).withColumn("part", F.lit(-1)))
    return top.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_n: int = 2, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) for each row of ``docs``."""
    return ranked(importance_scores(docs, fit_importance(docs, target, max_n, buckets, seed, text_col), id_col, text_col), percent, min_words)


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_n: int = 2, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, all columns. The last drawn (score, id) settles each row where it is: no text is shuffled or joined."""
    model = fit_importance(docs, target, max_n, buckets, seed, text_col)
    drawn = ranked(importance_scores(docs, model, id_col, text_col), percent, min_words).where("rank is not null")
    last = drawn.orderBy(F.desc("rank")).select("score", "doc_id").first()
    if last is None:
        return docs.limit(0)
    equal = drawn.where((F.col("score") == last["score"]) & (F.col("doc_id") == last["doc_id"])).count()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def pick(holds):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, _, weight = shared.value.weigh(batch.column(at_text))
            ids = batch.column(at_id).cast(pa.int64()).to_pylist()
            keys = zip(words.tolist(), shared.value.scores(ids, weight), ids)
            return batch.filter(pa.array([n >= min_words and s is not None and holds((-s, i)) for n, s, i in keys], pa.bool_()))

        return map_rows(docs, run)

    border = (-last["score"], last["doc_id"])
    return pick(lambda key: key < border).unionByName(pick(lambda key: key == border).limit(equal))
