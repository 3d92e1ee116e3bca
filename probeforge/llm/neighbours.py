"""Approximate nearest neighbours with learned partitions (neural locality-sensitive hashing).

On a bounded sample: a nearest-neighbour graph, cut into balanced parts by recursive bisection (spectral, then
swaps that cut fewer edges), and a small two-layer classifier trained to foretell in which parts a vector's
neighbours lie. Every row is then indexed in its most probable part. A query goes to its several most probable
parts, as many as reach ``TARGET_RECALL`` on the sample, and all vectors there are reranked by exact Euclidean
distance in double precision on the original numbers.

Vectors that are null, zero or hold null or non-finite components take no part. A query's candidates have its length: the
index is learned for the most frequent length, and each other length is a part of its own, searched whole. Ties go to the smaller
vec_id. A row with the query's own id is no candidate. Repeated ids are candidates each, and queries each: every row of a
repeated query id has its own ranks from 1. Other columns are not read.

The sample's size is ``SAMPLE`` and the number of parts grows with the rows until ``MAX_PARTS``, so the driver and the
model are bounded. A part is searched in blocks of at most about ``BLOCK_ROWS`` rows against blocks of
``BLOCK_QUERIES`` queries; a part that holds a third of all rows (equal vectors) is only more blocks. Each block returns
each query's ten best, of which a window keeps the ten best before and after the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probeforge.llm.runtime import staged

SAMPLE = 6_000
GRAPH = 10
MAX_PARTS = 64
PART_ROWS = 1_500
BLOCK_ROWS = 4_096
BLOCK_QUERIES = 1_024
TARGET_RECALL = 0.94
HIDDEN = 96


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    return df.where(fine).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest other rows, in blocks."""
    square = (x * x).sum(axis=1)
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 1024):
        d = square[None, :] - 2 * (x[a : a + 1024] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisect(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A balanced part for each node of the neighbour graph; ``parts`` is a power of two."""
    n, k = graph.shape
    part = np.zeros(n, dtype=np.int64)
    both = (np.concatenate([np.repeat(np.arange(n), k), graph.ravel()]), np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)]))
    for _ in range(parts.bit_length() - 1):
        inside = part[both[0]] == part[both[1]]
        a, b = both[0][inside], both[1][inside]
        degree = np.maximum(np.bincount(a, minlength=n), 1)
        x = rng.normal(size=n)
        count = np.bincount(part)
        for _ in range(60):  # power iteration of the lazy walk, less the constant of each part
            x = 0.5 * x + 0.5 * np.bincount(a, weights=x[b], minlength=n) / degree
            x -= (np.bincount(part, weights=x) / count)[part]
            x /= np.sqrt((np.bincount(part, weights=x * x) / count)[part]) + 1e-12
        order = np.lexsort((x, part))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        side = (rank - first[part] >= count[part] / 2).astype(np.int64)
        for _ in range(8):  # swaps: the most misplaced of either side change places, as many from each
            cross = np.bincount(a, weights=(side[a] != side[b]).astype(float), minlength=n)
            gain = 2 * cross - np.bincount(a, minlength=n)
            moved = 0
            for p in range(len(count)):
                here = [np.flatnonzero((part == p) & (side == s) & (gain > 0)) for s in (0, 1)]
                m = min(map(len, here)) // 2
                for own in here:
                    some = own[np.argsort(-gain[own], kind="stable")[:m]]
                    side[some] ^= 1
                moved += m
            if not moved:
                break
        part = 2 * part + side
    return part


class Router:
    """A two-layer classifier from vectors to parts."""

    def __init__(self, dim: int, parts: int, rng: np.random.Generator):
        self.mean, self.scale = np.zeros(dim), np.ones(dim)
        self.w = [rng.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts))]
        self.b = [np.zeros(HIDDEN), np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w[0] + self.b[0], 0) @ self.w[1] + self.b[1]

    def fit(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 40, rate: float = 3e-3) -> Router:
        self.mean, self.scale = x.mean(axis=0), x.std() + 1e-12
        values = [*self.w, *self.b]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                some = order[at : at + 128]
                z = (x[some] - self.mean) / self.scale
                hidden = np.maximum(z @ self.w[0] + self.b[0], 0)
                out = hidden @ self.w[1] + self.b[1]
                p = np.exp(out - out.max(axis=1, keepdims=True))
                e = (p / p.sum(axis=1, keepdims=True) - target[some]) / len(some)
                back = (e @ self.w[1].T) * (hidden > 0)
                step += 1
                for v, g, m, s in zip(values, (z.T @ back, hidden.T @ e, back.sum(axis=0), e.sum(axis=0)), first, second):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        return self

    def parts(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k most probable parts of each row, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :k]


def learn(x: np.ndarray, rows: int, seed: int = 5) -> tuple[Router, int]:
    """(classifier, how many parts a query visits) from the sample ``x`` of ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    parts = 1
    while parts < MAX_PARTS and parts * PART_ROWS < rows and parts * 64 < len(x):
        parts *= 2
    router = Router(x.shape[1], parts, rng)
    if parts == 1:
        return router, 1
    x = x + 0.0
    graph = nearest(x, min(GRAPH, len(x) - 1))
    part = bisect(graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1 / graph.shape[1])
    test = rng.random(len(x)) < 0.2
    router.fit(x[~test], target[~test], rng)
    own = router.parts(x, 1)[:, 0]
    order = router.parts(x[test], parts)
    found = (order[:, :, None] == own[graph[test]][:, None, :]).cumsum(axis=1).mean(axis=(0, 2))
    return router.fit(x, target, rng, epochs=10), int(min(parts, 1 + np.searchsorted(found, TARGET_RECALL)))


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k nearest rows: query (its place), vec_id, score. A matrix product preselects, differences decide."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    center = x.mean(axis=0)
    xc = x - center
    square = (xc * xc).sum(axis=1)
    for a in range(0, len(q), 256):
        qc = q[a : a + 256] - center
        d = square[None, :] - 2 * (qc @ xc.T) + (qc * qc).sum(axis=1)[:, None]
        slack = 1e-9 * (square.max() + (qc * qc).sum(axis=1)) + 1e-12
        for i in range(len(qc)):
            row = np.where(ids == q_ids[a + i], np.inf, d[i])
            if len(row) > k:
                some = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack[i])
            else:
                some = np.arange(len(row))
            some = some[np.isfinite(row[some])]
            score = np.sqrt(((x[some] - q[a + i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[some], score))[:k]
            out.append((np.full(len(order), a + i), ids[some][order], score[order]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame({"query": columns[0], "vec_id": columns[1], "score": columns[2]})


def search(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for whose id column ``is_query`` holds."""
    spark = df.sparkSession
    rows = staged(usable(df, id_col, vec_col), "vectors")
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    main = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").first()
    dim, many = main["n"], main["k"]
    sample = rows.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    router, visits = learn(np.stack(sample["v"].to_numpy()), many)
    shared = spark.sparkContext.broadcast(router)

    def route(n: int):
        def run(batches):
            for pdf in batches:
                sizes = pdf["v"].map(len).to_numpy() if len(pdf) else np.zeros(0, int)
                learned = pdf[sizes == dim]
                if len(learned):
                    chosen = shared.value.parts(np.stack(learned["v"].to_numpy()), n)
                    yield learned.loc[np.repeat(learned.index, chosen.shape[1])].assign(part=chosen.ravel().astype(np.int32))
                if len(learned) < len(pdf):  # a part for each other length
                    yield pdf[sizes != dim].assign(part=-sizes[sizes != dim].astype(np.int32))

        return run

    kind = "vec_id long, v array<double>"
    numbered = staged(rows.where(is_query(F.col("vec_id"))).withColumn("nth", F.monotonically_increasing_id()), "vector-asked")
    indexed = staged(rows.mapInPandas(route(1), f"{kind}, part int"), "vector-index")
    asked = staged(numbered.mapInPandas(route(visits), f"{kind}, nth long, part int"), "vector-queries")

    def blocks(of: DataFrame, size: int) -> dict[int, int]:
        """Part -> number of blocks; a row for each of MAX_PARTS parts and each other length at most."""
        return {r["part"]: -(-r["n"] // size) for r in of.groupBy("part").agg(F.count("*").alias("n")).collect()}

    c_blocks, q_blocks = blocks(indexed, BLOCK_ROWS), blocks(asked, BLOCK_QUERIES)

    def of_part(counts: dict[int, int]):
        pairs = [x for p, n in counts.items() for x in (F.lit(p), F.lit(n))]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col("part")), F.lit(0)) if pairs else F.lit(0)

    def with_blocks(of: DataFrame, own: dict[int, int], other: dict[int, int], mine: str, theirs: str) -> DataFrame:
        out = of.withColumn(mine, F.pmod(F.xxhash64("vec_id", F.lit(3)), of_part(own)).cast("int"))
        out = out.withColumn("others", of_part(other)).where("others > 0")
        return out.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("others") - 1))).drop("others")

    left = with_blocks(asked, q_blocks, c_blocks, "qb", "cb").groupBy("part", "qb", "cb")
    right = with_blocks(indexed, c_blocks, q_blocks, "cb", "qb").groupBy("part", "qb", "cb")

    def rerank(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return pd.DataFrame({"nth": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        out = best(queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy()), found["vec_id"].to_numpy(), np.stack(found["v"].to_numpy()), k)
        at = out.pop("query").to_numpy()
        return out.assign(nth=queries["nth"].to_numpy()[at], query_id=queries["vec_id"].to_numpy()[at])[["nth", "query_id", "vec_id", "score"]]

    each = left.cogroup(right).applyInPandas(rerank, "nth long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("nth").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
