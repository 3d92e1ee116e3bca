"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its different words (ASCII lower case) hashed to ``BUCKETS`` and normalised to unit length (words of one
bucket add up), bins of structure statistics (symbol, punctuation, case, repetition, line and word length shares, lists), and metadata
taken from the text itself (its length class; the shares of code points in the blocks of extended Latin, of Greek and Cyrillic, of
other scripts of two and three bytes, and of CJK and beyond). Its score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

i.e. all pairwise interactions at rank ``RANK``, in time linear in the features by the sum-of-squares identity.
Labels, lang, source and doc_id are never inputs of a score.

The model is fitted by AdaGrad on at most ``MAX_TRAINING_ROWS`` labelled rows (a documented bound; those of least
hash of doc_id). Their features are made where the rows are, ``N_FEATURES`` a row at most however long its text, and only these
meet in the fitting task. Epochs are as many as make ``STEPS`` rows, ``EPOCHS`` at least and ten times that at most: a small table is
gone through more often. The model has (BUCKETS + statistics) x (1 + RANK) numbers, whatever the corpus.

Defined results: null text counts as empty, and has a score too; repeated rows get a row each; other columns are not read; without a labelled row of
either class all scores are 0.5.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeforge.llm.runtime import lean_batches
from probeforge.llm.textio import binary_column, hashed_words, slices
from probeforge.llm.toxicity import training_rows

BUCKETS = 1 << 16
RANK = 8
MAX_TRAINING_ROWS = 12_000
EPOCHS, STEPS = 6, 40_000
BATCH = 64
BINS = 12

#: Lead bytes of UTF-8 by blocks of scripts.
SCRIPTS = tuple(bytes(range(a, b)) for a, b in ((0xC3, 0xCA), (0xCD, 0xD5), (0xD5, 0xE3), (0xE3, 0xF5)))
_CLASSES = np.zeros((8 + len(SCRIPTS), 256), dtype=np.int32)
for _k, _bytes in enumerate((b"#*$%&|<>", b"!?", b".,;:", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"\n", bytes(range(0xC2, 0xF5)), *SCRIPTS)):
    _CLASSES[_k, list(_bytes)] = 1
N_STATS = 14 + len(SCRIPTS)
N_FEATURES = BUCKETS + N_STATS * BINS


def _bin(x: np.ndarray, top: float = 1.0) -> np.ndarray:
    """Square-root bins of shares up to ``top``."""
    return np.minimum(BINS - 1, (np.sqrt(np.clip(x / top, 0, 1)) * BINS).astype(np.int64))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), sorted by row, of a large-binary column."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    starts = offsets - offsets[0]
    size = np.diff(starts)
    row, word = hashed_words(column)
    words = np.bincount(row, minlength=n)
    per = np.maximum(size, 1)

    def share(k: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(_CLASSES[k][data])])
        return total[starts[1:]] - total[starts[:-1]]

    symbols, bangs, stops, upper, lower, digits, breaks, multi, *scripts = (share(k) for k in range(len(_CLASSES)))
    order = np.lexsort((word, row))
    r, w = row[order], word[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
    kinds = np.bincount(r[new], minlength=n)
    same = np.zeros(len(row), bool)
    same[1:] = (row[1:] == row[:-1]) & (word[1:] == word[:-1])
    most = np.zeros(n)
    at = np.flatnonzero(new)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(r))))
    lines = breaks + 1
    w1 = np.maximum(words, 1)
    stats = [
        _bin(symbols / w1, 3.0), _bin(bangs / w1, 2.0), _bin(stops / w1, 2.0), _bin(upper / np.maximum(upper + lower, 1)), _bin(digits / per), _bin(1 - kinds / w1),
        _bin(np.bincount(row[same], minlength=n) / w1), _bin(most / w1), _bin(lines / w1), _bin(multi / per), np.minimum(BINS - 1, np.log2(words + 1).astype(np.int64)),
        np.minimum(BINS - 1, np.log2(per / w1 + 1).astype(np.int64) * 2), np.minimum(BINS - 1, np.log2(lines).astype(np.int64)), np.minimum(BINS - 1, (np.log2(per) / 2).astype(np.int64)),
        *(_bin(s / per, 0.5) for s in scripts),
    ]
    word_rows, buckets = r[new], (w[new] & np.uint64(BUCKETS - 1)).astype(np.int64)
    values = 1.0 / np.sqrt(np.maximum(kinds[word_rows], 1))
    keys, at = np.unique(word_rows * BUCKETS + buckets, return_inverse=True)  # a bucket once a row: BUCKETS at most, however long the text
    word_rows, buckets, values = keys // BUCKETS, keys % BUCKETS, np.bincount(at, weights=values, minlength=len(keys))
    stat_rows = np.repeat(np.arange(n), N_STATS)
    stat_features = BUCKETS + np.arange(N_STATS)[None, :] * BINS + np.stack(stats, axis=1)
    rows = np.concatenate([word_rows, stat_rows])
    order = np.argsort(rows, kind="stable")
    found = np.concatenate([buckets, stat_features.ravel()])[order]
    return rows[order], found, np.concatenate([values, np.full(len(stat_rows), 1 / np.sqrt(N_STATS))])[order].astype(np.float32)


class Machine:
    """w0, linear weights and rank-RANK factors."""

    def __init__(self, seed: int = 7):
        self.w0 = np.float32(0)
        self.w = np.zeros(N_FEATURES, dtype=np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (N_FEATURES, RANK)).astype(np.float32)
        self.fitted = False

    def _parts(self, row: np.ndarray, feature: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and sum_i v_if x_i; rows must be sorted and each present."""
        at = np.searchsorted(row, np.arange(n))
        vx = self.v[feature] * x[:, None]
        total = np.add.reduceat(vx, at, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), at)
        linear = np.add.reduceat(self.w[feature] * x, at)
        return self.w0 + linear + 0.5 * ((total * total).sum(axis=1) - squares), total

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.full(len(column), 0.5)
        z, _ = self._parts(*features(column), len(column))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, column: pa.Array, y: np.ndarray, epochs: int | None = None) -> Machine:
        """Fitted to the texts of a large-binary column."""
        chunks = [features(column.slice(a, b - a)) + (a,) for a, b in slices(column)]
        row = np.concatenate([c[0] + c[3] for c in chunks] or [np.zeros(0, np.int64)])
        return self.fit_features(row, *(np.concatenate([c[k] for c in chunks] or [np.zeros(0, np.int64)]) for k in (1, 2)), y, epochs)

    def fit_features(self, row: np.ndarray, feature: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int | None = None, rate: float = 0.1, penalty: float = 1e-5) -> Machine:
        if not len(y) or y.min() == y.max():
            return self
        epochs = epochs or max(EPOCHS, min(10 * EPOCHS, STEPS // len(y)))
        begin = np.searchsorted(row, np.arange(len(y) + 1))
        g0, gw, gv = np.float32(1e-6), np.full(N_FEATURES, 1e-6, np.float32), np.full((N_FEATURES, RANK), 1e-6, np.float32)
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                some = order[at : at + BATCH]
                picks = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in some])
                rows = np.repeat(np.arange(len(some)), begin[some + 1] - begin[some])
                f, xs = feature[picks], x[picks]
                z, total = self._parts(rows, f, xs, len(some))
                e = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[some]).astype(np.float32) / len(some) ** 0.5
                d = e[rows] * xs
                uniq, back = np.unique(f, return_inverse=True)
                dw = np.bincount(back, weights=d, minlength=len(uniq)).astype(np.float32) + penalty * self.w[uniq]
                each = d[:, None] * (total[rows] - self.v[f] * xs[:, None])
                by = np.argsort(back, kind="stable")
                dv = np.add.reduceat(each[by], np.searchsorted(back[by], np.arange(len(uniq))), axis=0) + penalty * self.v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                g0 += e.sum() ** 2
                self.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= rate * 0.5 * dv / np.sqrt(gv[uniq])
                self.w0 -= np.float32(rate * e.sum() / np.sqrt(g0))
        self.fitted = True
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, keep=lambda doc_id: F.lit(True), id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING_ROWS) -> Machine:
    """Fitted in one task from the features of at most ``most`` labelled rows; only the model comes to the driver."""
    lean_batches(docs.sparkSession)
    rows = training_rows(docs, labels, "quality", keep, id_col, text_col, most)
    kind = "doc_id bigint, label int, feature array<int>, x array<float>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = binary_column(batch.column(1))
            for a, b in slices(column):
                row, feature, x = features(column.slice(a, b - a))
                ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (feature.astype(np.int32), x)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *lists], names=["doc_id", "label", "feature", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = pa.Table.from_batches(batches).sort_by("doc_id").combine_chunks()
        lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (some["feature"], some["x"])]
        row = np.repeat(np.arange(len(some)), pa.compute.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
        feature, x = (c.flatten().to_numpy() for c in lists)
        machine = Machine().fit_features(row, feature.astype(np.int64), x, some["label"].to_numpy().astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], names=["model"])

    found = rows.select("doc_id", "text", "label").mapInArrow(measure, kind).repartition(1).mapInArrow(run_if_any(run), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Machine()


def run_if_any(run):
    """``run`` over the batches, if there are any."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            yield from run(found)

    return checked


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row; no shuffle."""
    lean_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = binary_column(batch.column(1))
            for a, b in slices(column):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.score(column.slice(a, b - a)))], names=["doc_id", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")
