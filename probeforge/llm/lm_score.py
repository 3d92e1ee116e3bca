"""LM scoring with a log-frequency Bloom filter of quantised bigram counts.

Training counts bigrams (words in ASCII lower case, then one end; the first context is a start mark) over the whole
training texts. A bigram of count c is kept from ``min_count`` on (1 keeps all, as the registered
query does) and quantised to a level q(c) = 1 + floor(log_B(c / min_count)). It is entered in the filter once for each level up to q
that some whole count has. To look a bigram up, its levels are probed from the first on until one is absent; the last
one present gives the count's lower bound.

With c' the quantised counts, S(u) = sum of c'(u, w), C(u) the count of u as a context and T(u) the number of
different kept w after u, the model is

    p(w | u) = (c'(u, w) + r(u) p1(w)) / (S(u) + r(u)),   r(u) = C(u) - S(u) + T(u) + 1
    p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

so that for each u the probabilities of all V known tokens and one unknown sum to one, but for false positives,
of which the filter has about 1 % a probe. Scores are log10 of the product over a text's tokens, end included. A word is a
context as often as it stands in the texts, so one count of bigrams gives all of this.

Size. The filter is made in shards, each by the task that counts its bigrams, whose number follows the text's
bytes. All shards and the token table (hash, c, S, T) are broadcast if together they are within ``max_bytes``, which is known
exactly before anything is gathered. Beyond, the texts are read in several passes, each with the table and a group of shards that
fit together; a score is a sum over bigrams, so the passes' parts, a few numbers a row, add up to it. If the table leaves no room for that
(or for over MAX_PASSES passes), nothing that grows is broadcast: each text's distinct bigrams are probed in the same shards, each shard in a task with the bigrams that belong to it, and join the token table by shuffles, of
which keys that more than 1/4096 of the rows have are split off and broadcast (4096 at most). All ways probe the
same bits, so scores are the same at every size (to the rounding of sums).

Tokens are told apart by 64-bit hashes. Null text counts as empty (one end). Repeated rows are learned from and
scored as often as they stand there. Without training rows all counts are zero. Other columns are read only by ``train``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeforge.llm.runtime import lean_batches, staged
from probeforge.llm.textio import binary_column, hashed_words, mix, slices

START = np.uint64(0x243F6A8885A308D3)
END = np.uint64(0x13198A2E03707344)
LEVEL_BASE = 1.25
MIN_COUNT = 2
BITS_PER_ENTRY = 12
#: Bits of an entry, all in one 64-bit word.
BITS_SET = 4
#: Tokens whose bigrams a worker adds up before they are shuffled.
PARTIAL_TOKENS = 1_000_000
#: Bytes of training text a shard of the filter, within limits.
SHARD_BYTES = 12 << 20
SHARDS = (4, 65_536)
#: Partial counts that a shard's task adds up at once.
MERGED_ROWS = 1_000_000
#: Bytes up to which filter and token table are broadcast.
MAX_BYTES = 384 << 20
#: Passes over the texts, at most, before bigrams are shuffled instead.
MAX_PASSES = 16
#: A key is hot beyond this share of the rows.
HOT_SHARE = 4096


def level(count: np.ndarray, least: int = MIN_COUNT) -> np.ndarray:
    """The quantised level, from 1, of counts of at least ``least``."""
    return 1 + np.floor(np.log(count / least) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def level_count(q: np.ndarray, least: int = MIN_COUNT) -> np.ndarray:
    """The least whole count of a level; 0 of level 0."""
    return np.where(q > 0, np.ceil(least * LEVEL_BASE ** (q - 1.0) - 1e-9), 0.0)


def steps(least: int = MIN_COUNT) -> np.ndarray:
    """The levels that whole counts have, ascending; a bigram is entered once for each of them up to its own."""
    q = np.arange(1, 200)
    return q[level(level_count(q, least), least) == q]


def bigram(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * np.uint64(0x9FB21C651E98DF25) + w)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, context) of all tokens of a large-binary column, in text order with each row's end."""
    row, word = hashed_words(column)
    n = len(column)
    lengths = np.bincount(row, minlength=n) + 1
    ends = np.cumsum(lengths) - 1
    token = np.empty(len(word) + n, dtype=np.uint64)
    mask = np.ones(len(token), dtype=bool)
    mask[ends] = False
    token[mask] = word
    token[ends] = END
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[np.concatenate([[0], ends[:-1] + 1])] = START
    return np.repeat(np.arange(n), lengths), token, context


def count_bigrams(train: DataFrame) -> DataFrame:
    """Partial counts (h, u, c) of the bigrams over column text of ``train``."""

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        token, context = (np.concatenate(x) for x in zip(*parts))
        h, at, c = np.unique(bigram(context, token), return_index=True, return_counts=True)
        u = context[at]
        for a in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (h.view(np.int64), u.view(np.int64), c)], names=["h", "u", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            column = binary_column(batch.column(0))
            for a, b in slices(column, 1 << 19):
                parts.append(tokens(column.slice(a, b - a))[1:])
                held += len(parts[-1][0])
                if held > PARTIAL_TOKENS:
                    yield from counted(parts)
                    parts, held = [], 0
        if parts:
            yield from counted(parts)

    return train.select("text").mapInArrow(run, "h bigint, u bigint, c bigint")


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The partition that Spark's hash partitioning sends a bigint to (MurmurHash3, seed 42)."""
    u32 = np.uint32
    turn = lambda x, r: (x << u32(r)) | (x >> u32(32 - r))
    out = np.full(len(h), 42, u32)
    for half in (h.astype(u32), (h >> np.uint64(32)).astype(u32)):
        out = turn(out ^ turn(half * u32(0xCC9E2D51), 15) * u32(0x1B873593), 13) * u32(5) + u32(0xE6546B64)
    out ^= u32(8)
    out = (out ^ (out >> u32(16))) * u32(0x85EBCA6B)
    out = (out ^ (out >> u32(13))) * u32(0xC2B2AE35)
    return np.mod((out ^ (out >> u32(16))).view(np.int32), np.int32(shards))


class CountFilter:
    """The Bloom filter of (bigram, step) pairs in shards; an entry sets BITS_SET bits of one 64-bit word of its bigram's shard."""

    def __init__(self, shards: dict[int, np.ndarray], number: int):
        """``shards``: words of each; ``number``: of shards, those without entries included."""
        self.number = number
        self.size = np.ones(number, np.uint64)
        self.first = np.zeros(number, np.uint64)  # of an empty shard: word 0, which stays empty
        at = 1
        for k, words in sorted(shards.items()):
            self.size[k], self.first[k] = len(words), at
            at += len(words)
        self.words = np.concatenate([np.zeros(1, np.uint64), *(w for _, w in sorted(shards.items()))])

    @staticmethod
    def _place(h: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(a number below 2**32 for the word, mask)."""
        a = mix(h + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        mask = np.zeros(len(h), np.uint64)
        for i in range(BITS_SET):
            mask |= np.uint64(1) << ((a >> np.uint64(6 * i)) & np.uint64(63))
        return a >> np.uint64(32), mask

    @staticmethod
    def shard(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The words of a shard with these bigrams at steps 1 to ``rank``."""
        size = max(1, -(-int(rank.sum()) * BITS_PER_ENTRY // 64))
        words = np.zeros(size, np.uint64)
        for step in range(1, int(rank.max(initial=0)) + 1):
            at, mask = CountFilter._place(h[rank >= step], step)
            np.bitwise_or.at(words, ((at * np.uint64(size)) >> np.uint64(32)).astype(np.int64), mask)
        return words

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """The highest step up to which all are present."""
        out = np.zeros(len(h), dtype=np.int64)
        shard = shard_of(h, self.number)
        size, first = self.size[shard], self.first[shard]
        left, step = np.arange(len(h)), 0
        while len(left):
            step += 1
            at, mask = self._place(h, step)
            hit = self.words[(first + ((at * size) >> np.uint64(32))).astype(np.int64)] & mask == mask
            left, h, size, first = left[hit], h[hit], size[hit], first[hit]
            out[left] = step
        return out


def _quantised(rank: np.ndarray, least: int) -> np.ndarray:
    """The counts that steps stand for."""
    return np.concatenate([[0.0], level_count(steps(least), least)])[np.minimum(rank, len(steps(least)))]


class Model:
    """Counts (``n`` tokens, ``v`` different), sorted token table and bigram filter."""

    def __init__(self, n: int, v: int, table: tuple[np.ndarray, ...], counts: CountFilter, starts: tuple[float, float, float], least: int = MIN_COUNT, group: tuple[int, int] | None = None):
        """``group``: only bigrams of these shards (first, end) are added to a score."""
        self.group = group
        self.n, self.v, self.table, self.counts, self.starts, self.least = n, v, table, counts, starts, least

    def score(self, row: np.ndarray, token: np.ndarray, context: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each row."""
        h, c, s, t = self.table
        distinct, back = np.unique(token, return_inverse=True)
        at = np.minimum(np.searchsorted(h, distinct), max(0, len(h) - 1))
        hit = h[at] == distinct if len(h) else np.zeros(len(distinct), bool)
        pick = lambda x: np.where(hit, x[at], 0.0) if len(h) else np.zeros(len(distinct))
        known = pick(c)
        p1 = (known + 0.5) / (self.n + 0.5 * (self.v + 1))
        # a context is the token before or, with the last number, the start mark
        m = len(distinct)
        before = np.empty(len(back), np.int64)
        before[1:] = back[:-1]
        before[context == START] = m
        total, kinds, seen = (np.append(pick(x), start) for start, x in zip(self.starts, (s, t, c)))
        rest = seen - total + kinds + 1
        pair, at = np.unique(before * m + back, return_inverse=True)
        u, w = pair // m, pair % m
        h = bigram(np.append(distinct, START)[u], distinct[w])
        mine = slice(None)
        if self.group:
            own = shard_of(h, self.counts.number)
            mine = (own >= self.group[0]) & (own < self.group[1])
        h, u, w = h[mine], u[mine], w[mine]
        quantised = _quantised(self.counts.ranks(h), self.least)
        quantised = np.minimum(quantised, total[u])  # a false positive cannot exceed its context
        p = np.zeros(len(pair))
        p[mine] = np.log10((quantised + rest[u] * p1[w]) / (total[u] + rest[u]))
        add = lambda x: np.bincount(row, weights=x, minlength=rows)
        return np.bincount(row, minlength=rows), add((known > 0)[back].astype(float)).astype(np.int64), add(np.log10(p1)[back]), add(p[at])


def train_counts(learn: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(a row (shard, words) for each shard of the filter and rows (u, n, s, t) of each shard's contexts, the number of shards).

    u's n, s and t are parts of C(u), S(u) and T(u): each shard has some of u's bigrams.
    """
    size = learn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(min(max(size // SHARD_BYTES + 1, SHARDS[0]), SHARDS[1]))

    def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """The partial counts of each bigram as one."""
        h, u, c = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h)
        h = h[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[at], u[order[at]], np.add.reduceat(c[order], at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, own = [], 0, 0
        for batch in batches:
            parts.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            held += batch.num_rows
            if held > MERGED_ROWS + 2 * own:  # what is held is at most about three times the different bigrams
                parts = [added(parts)]
                held = own = len(parts[0][0])
        if not held:
            return
        h, u, c = added(parts)
        h = h.view(np.uint64)
        kept = c >= least
        count = np.maximum(c, least)
        q = level(count, least)
        rank = np.where(kept, np.searchsorted(steps(least), q) + 1, 0)
        contexts, at = np.unique(u, return_inverse=True)
        add = lambda x: np.bincount(at, weights=x, minlength=len(contexts))
        sums = add(c).astype(np.int64), add(np.where(kept, level_count(q, least), 0.0)), add(kept).astype(np.int64)
        own = shard_of(h, shards)
        for k in np.unique(own):
            words = CountFilter.shard(h[own == k], rank[own == k]).astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((int(k), words, None, None, None, None), types)], names=names)
        for a in range(0, len(contexts), 1 << 16):
            b = min(len(contexts), a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.nulls(b - a, types[0]), pa.nulls(b - a, types[1]), pa.array(contexts[a:b]), *(pa.array(x[a:b]) for x in sums)], names=names)

    names, types = ["shard", "words", "u", "n", "s", "t"], [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return staged(count_bigrams(learn).repartition(shards, "h").mapInArrow(run, "shard int, words binary, u bigint, n bigint, s double, t bigint"), "lm-counts"), shards


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row; ``train``: which rows to learn from; ``min_count``: of bigrams."""
    spark = docs.sparkSession
    lean_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text)
    counts, shards = train_counts(docs.where(train).select(text), min_count)
    contexts = counts.where("u is not null").groupBy(F.col("u").alias("h")).agg(F.sum("n").alias("c"), F.sum("s").alias("s"), F.sum("t").alias("t"))
    contexts = staged(contexts, "lm-contexts")
    mark = int(START.view(np.int64))
    first = contexts.where(F.col("h") == mark).first()
    starts = (first["s"], float(first["t"]), float(first["c"])) if first else (0.0, 0.0, 0.0)
    ends = spark.createDataFrame([(int(END.view(np.int64)), first["c"], 0.0, 0)] if first else [], "h long, c long, s double, t long")
    table = contexts.where(F.col("h") != mark).unionByName(ends)
    n, v = contexts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()  # one end for the start mark
    filters = counts.where("shard is not null").select("shard", "words")
    size = filters.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    if 24 * v + size > max_bytes:
        groups = _groups(filters, max_bytes - 24 * v)
        if len(groups) > MAX_PASSES or not groups:
            return _sharded_scores(plain, n, v, table, filters, shards, starts, min_count)
        return _scores_in_passes(plain, n, v, table, filters, shards, starts, min_count, groups)
    return _scored(plain, spark.sparkContext.broadcast(_gathered(n, v, table, filters, shards, starts, min_count)))


def _groups(filters: DataFrame, room: int) -> list[tuple[int, int]]:
    """(first, end) of groups of shards that fit into ``room`` bytes; none if a shard does not."""
    out, held = [], 0
    for r in filters.select("shard", F.octet_length("words").alias("size")).orderBy("shard").collect():  # a row a shard, SHARDS[1] at most
        if r["size"] > room:
            return []
        if not out or held + r["size"] > room:
            out.append((out[-1][1] if out else 0, r["shard"] + 1))
            held = 0
        out[-1] = (out[-1][0], r["shard"] + 1)
        held += r["size"]
    return out


def _scores_in_passes(plain: DataFrame, n: int, v: int, table: DataFrame, filters: DataFrame, shards: int, starts: tuple[float, float, float], least: int, groups: list[tuple[int, int]]) -> DataFrame:
    """A pass over the texts for each group of shards; equal rows are added up together and told apart again by their number."""
    parts = None
    for first, end in groups:
        model = _gathered(n, v, table, filters.where((F.col("shard") >= first) & (F.col("shard") < end)), shards, starts, least)
        model.group = first, end
        shared = plain.sparkSession.sparkContext.broadcast(model)
        one = staged(_scored(plain, shared, numbered=True), "lm-pass")
        shared.destroy()
        del model
        parts = one if parts is None else parts.unionByName(one)
    copies = F.count("*") / len(groups)
    out = parts.groupBy("doc_id", "text_hash", "n_tokens", "n_known", "train_tokens").agg(F.max("base_score").alias("base_score"), (F.sum("score") / copies).alias("score"), F.array_repeat(F.lit(0), copies.cast("int")).alias("copies"))
    return out.withColumn("copy", F.explode("copies")).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _scored(plain: DataFrame, shared, numbered: bool = False) -> DataFrame:
    """The rows scored by a model that is broadcast; ``numbered``: with a hash of their text."""
    rows = plain.withColumn("text_hash", F.xxhash64("text")) if numbered else plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = binary_column(batch.column(1))
            for a, b in slices(column, 1 << 19):
                found = m.score(*tokens(column.slice(a, b - a)), b - a)
                n_tokens, known, base, score = map(pa.array, found)
                more = [batch.column(2).slice(a, b - a)] if numbered else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n_tokens, known, pa.array(np.full(b - a, m.n, np.int64)), base, score, *more], names=[*names, "text_hash"][: 6 + len(more)])

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double" + (", text_hash bigint" if numbered else ""))


def _gathered(n: int, v: int, table: DataFrame, filters: DataFrame, shards: int, starts: tuple[float, float, float], least: int) -> Model:
    """The model on the driver, fetched part by part; its size was checked before."""

    def parts(df: DataFrame) -> Iterator[pa.Table]:
        """Column data of each task, packed as one binary cell, so that the driver handles no row objects."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part"])

        for cell in df.mapInArrow(pack, "part binary").toLocalIterator():
            yield pa.ipc.open_stream(cell["part"]).read_all()

    columns = [np.empty(v, np.uint64), np.empty(v, np.int64), np.empty(v, np.float32), np.empty(v, np.int32)]
    at = 0
    for part in parts(table.select("h", "c", "s", "t")):
        end = at + part.num_rows
        for to, name in zip((columns[0].view(np.int64), *columns[1:]), "hcst"):
            to[at:end] = part[name].to_numpy()
        at = end
    if not columns[1].max(initial=0) >> 32:
        columns[1] = columns[1].astype(np.uint32)
    order = np.argsort(columns[0])
    for i in range(4):
        columns[i] = columns[i][order]
    del order
    words = {r["shard"]: np.frombuffer(r["words"], "<u8") for r in filters.toLocalIterator()}
    return Model(n, v, tuple(columns), CountFilter(words, shards), starts, least)


def hot_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` (staged) left join ``table`` (a row for a key) on ``key``; keys of many rows are joined by a broadcast of HOT_SHARE rows at most."""
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("times")).where(F.col("times") > max(1, total // HOT_SHARE)).select(key)
    hot = staged(hot, "lm-hot")  # fewer than HOT_SHARE keys have a greater share
    few = hot.join(table, key, "left")
    often = rows.join(F.broadcast(few), key)
    return often.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left").select(often.columns))


def _sharded_scores(plain: DataFrame, n: int, v: int, table: DataFrame, filters: DataFrame, shards: int, starts: tuple[float, float, float], least: int) -> DataFrame:
    """The way for models of any size: each text's distinct bigrams meet the shard of the filter they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), binary_column(batch.column(1))
            for a, b in slices(column):
                row, token, context = tokens(column.slice(a, b - a))
                order = np.lexsort((token, context, row))
                row, token, context = row[order], token[order], context[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1]) | (context[1:] != context[:-1])
                at = np.flatnonzero(new)
                k = np.diff(np.append(at, len(row)))
                pair = bigram(context[at], token[at])
                own = ids.slice(a, b - a).take(pa.array(row[at]))
                nth = batch.column(2).slice(a, b - a).take(pa.array(row[at]))
                yield pa.RecordBatch.from_arrays([nth, own, *(pa.array(x.view(np.int64)) for x in (pair, context[at], token[at])), pa.array(k)], names=["nth", "doc_id", "pair", "u", "w", "k"])

    def probe(pairs: pa.Table, words: pa.Table) -> pa.Table:
        h = pairs["pair"].to_numpy()
        own = {int(k): np.frombuffer(x, "<u8") for k, x in zip(words["shard"].to_pylist(), words["words"].to_pylist())}
        rank = CountFilter(own, shards).ranks(h.view(np.uint64)) if len(h) else np.zeros(0, np.int64)
        return pa.table({"pair": pa.array(h, pa.int64()), "q": pa.array(_quantised(rank, least), pa.float64())})

    # repeated doc_ids are told apart by a number that is fixed by the scan
    numbered = plain.withColumn("nth", F.monotonically_increasing_id())
    rows = staged(numbered.mapInArrow(run, "nth bigint, doc_id bigint, pair bigint, u bigint, w bigint, k bigint"), "lm-rows")
    pairs = rows.select("pair").distinct().withColumn("shard", F.pmod(F.hash("pair"), F.lit(shards)))
    found = staged(pairs.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(probe, "pair bigint, q double"), "lm-probed")
    words = table.select(F.col("h").alias("w"), F.col("c").alias("wc"))
    contexts = table.select(F.col("h").alias("u"), F.col("c").alias("uc"), F.col("s").alias("us"), F.col("t").alias("ut"))
    joined = staged(hot_join(rows, words, "w"), "lm-words")
    joined = staged(hot_join(joined, contexts, "u"), "lm-rows-contexts")
    joined = hot_join(joined, found, "pair")
    first = F.col("u") == int(START.view(np.int64))
    pick = lambda start, c: F.when(first, F.lit(float(start))).otherwise(F.coalesce(c, F.lit(0.0)))
    total, kinds, seen = (pick(s, F.col(c).cast("double")) for s, c in zip(starts, ("us", "ut", "uc")))
    p1 = (F.coalesce("wc", F.lit(0)) + 0.5) / (n + 0.5 * (v + 1))
    rest = seen - total + kinds + 1
    p = (F.least("q", total) + rest * p1) / (total + rest)
    out = joined.groupBy("nth", "doc_id").agg(
        F.sum("k").alias("n_tokens"), F.sum(F.when(F.col("wc") > 0, F.col("k")).otherwise(0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.sum(F.col("k") * F.log10(p1)).alias("base_score"), F.sum(F.col("k") * F.log10(p)).alias("score"),
    )
    return out.drop("nth")
