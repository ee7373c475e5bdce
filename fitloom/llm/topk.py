"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments, coarse to fine; of each segment the mean and
the deviation from it are kept.  For vectors q and c,
    <q, c> <= sum over segments of  L * mean_q * mean_c + dev_q * dev_c
(the segment parts around the means are bounded by Cauchy-Schwarz; for vectors of
given lengths this is the lower bound on their distance).  A candidate whose
bound lies below a query's k-th best score so far is dropped at the coarsest
level that shows it; survivors get exact integer scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Segments at each level, coarse to fine.
LEVELS = (2, 8, 32)
#: Queries that a task holds at once (a broadcast of a few MB); more are taken in waves.
WAVE = 8_192
#: Candidates, taken by a hash of the id, whose scores give every query its first threshold.
FIRST = 2_048
#: Room for rounding in a bound and in a threshold taken as a float, as a part of the norms' product.
ROUNDING = 1e-9
#: Queries and candidates of one matrix of bounds.
BLOCK_Q, BLOCK_C = 512, 4_096


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as floats, which hold these whole numbers exactly."""
    return np.floor(1024.0 * x)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; floats where they are exact, else whole numbers of any size, held to 64 bits."""
    reach = (np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0)) * q.shape[1]
    if reach < 2**53:
        return (q @ c.T).astype(np.int64)
    big = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in c], object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


class Summary:
    """Segment statistics of a set of vectors at every level, laid out so that bounds are matrix products."""

    def __init__(self, x: np.ndarray):
        self.level, self.norm = [], np.sqrt((x * x).sum(1))
        n, d = x.shape
        for segments in LEVELS:
            edges = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int)) if d else np.array([0])
            size = np.diff(edges)
            if not len(size):
                self.level.append(np.zeros((n, 0)))
                continue
            sums = np.add.reduceat(x, edges[:-1], axis=1)
            around = x - np.repeat(sums / size, size, axis=1)
            dev = np.sqrt(np.add.reduceat(around * around, edges[:-1], axis=1))
            self.level.append(np.hstack([sums / np.sqrt(size), dev]))


class Best:
    """The k highest scores of each query so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k, self.summary = ids, q, k, Summary(q)
        self.scores = [np.zeros(0, np.int64)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)
        #: Scores below this can't be among the k highest.
        self.least = np.full(len(ids), np.iinfo(np.int64).min) if floor is None else floor.copy()

    def offer(self, ids: np.ndarray, c: np.ndarray) -> None:
        for a in range(0, len(ids), BLOCK_C):
            part, vectors = ids[a : a + BLOCK_C], c[a : a + BLOCK_C]
            summary = Summary(vectors)
            for b in range(0, len(self.ids), BLOCK_Q):
                self._block(slice(b, b + BLOCK_Q), part, vectors, summary)

    def _block(self, rows: slice, ids: np.ndarray, c: np.ndarray, summary: Summary) -> None:
        q, least = self.q[rows], self.least[rows]
        columns = np.arange(len(ids))
        room = ROUNDING * summary.norm  # the summands of a bound are no larger than the norms' product, whatever its sign
        needed = least[:, None].astype(float) - 1
        for mine, other in zip(self.summary.level, summary.level, strict=True):
            bound = mine[rows] @ other[columns].T
            alive = bound + self.summary.norm[rows][:, None] * room[columns] >= needed
            columns = columns[alive.any(0)]
            if not len(columns):
                return
        score = _exact(q, c[columns])
        own = self.ids[rows][:, None] == ids[columns]
        for i in np.flatnonzero((score >= least[:, None]).any(1)):
            good = np.flatnonzero((score[i] >= least[i]) & ~own[i])
            if len(good):
                self._add(rows.start + int(i), score[i, good], ids[columns[good]])

    def _add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.scores[i], score]), np.concatenate([self.found[i], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.scores[i], self.found[i] = score[order], ids[order]
        if len(order) == self.k:
            self.least[i] = max(self.least[i], self.scores[i][-1])


def _matrices(ids: pa.Array, vectors: pa.Array):
    """(ids, quantised matrix) of the vectors of each length."""
    values, offsets = np.asarray(vectors.flatten(), np.float64), np.asarray(vectors.offsets)
    offsets, ids = offsets - offsets[0], np.asarray(ids, np.int64)
    size = np.diff(offsets)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        at = offsets[rows][:, None] + np.arange(d)
        yield int(d), ids[rows], quantise(values[at])


def _search(wave, k: int):
    def run(batches):
        best = {d: Best(ids, q, k, floor) for d, (ids, q, floor) in wave.value.items()}
        for batch in batches:
            for d, ids, c in _matrices(batch.column(0), batch.column(1)):
                if d in best:
                    best[d].offer(ids, c)
        for b in best.values():
            counts = [len(s) for s in b.scores]
            if sum(counts):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, counts)), pa.array(np.concatenate(b.found)), pa.array(np.concatenate(b.scores))], names=["query_id", "vec_id", "score"])

    return run


def _collected(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    got = rows.toArrow().combine_chunks()
    if not len(got):
        return {}
    parts = list(_matrices(got["vec_id"].combine_chunks(), got["v"].combine_chunks()))
    out = {}
    for d, ids, x in parts:
        order = np.argsort(ids, kind="stable")
        out[d] = ids[order], x[order]
    return out


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best among all other rows.

    Components count as floor(1024 * x).  Queries reach the tasks in waves of
    bounded size, one pass over all candidates for each wave; a task
    keeps k rows a query, and the tasks' rows meet in a window by query.
    Cases: vectors that are null or hold a null or non-finite component, and
    rows of a null id, take no part; only vectors of one length are compared;
    rows that carry the query's own id are the query's own, and a query id
    that repeats is asked once, by its smallest vector; other repeated rows are
    candidates each; an empty table, or one without queries, gives no row.
    """
    spark = embeddings.sparkSession
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    total, asked = rows.count(), queries.count()
    waves = max(1, -(-asked // WAVE))
    schema = "query_id long, vec_id long, score long"
    draw = F.pmod(F.xxhash64(F.lit("first"), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    first = _collected(rows.where(draw < min(1.0, FIRST / max(total, 1)))) if waves else {}
    found = spark.createDataFrame([], schema)
    for n in range(waves):
        wave = _collected(queries.where(F.pmod(F.xxhash64(F.lit("wave"), "vec_id"), F.lit(waves)) == n))
        held = {}
        for d, (ids, q) in wave.items():
            seed = Best(ids, q, k)
            if d in first:
                seed.offer(*first[d])
            held[d] = ids, q, seed.least
        if held:
            found = found.unionByName(rows.mapInArrow(_search(spark.sparkContext.broadcast(held), k), schema))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
