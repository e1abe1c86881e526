"""Nearest neighbours by collision-counting hashing.

Every vector, scaled to length one, is projected on ``projections`` random lines; per line the values of an Arrow batch are kept
as one sorted array. A query looks at a window round its own value in each array and counts how often a vector falls in. Vectors
whose count reaches ``threshold`` are verified with the exact cosine. If the k-th best distance so far is beyond the window's
radius, all windows grow to the next radius (virtual rehashing: the arrays stay as they are). A vector no farther than the
radius falls into each window with probability 0.68 at least, so that with 48 lines and a threshold of 24 it is missed in about
0.3 % of the cases; at the last radius everything is verified.

Queries are handled in blocks of about ``block`` (bounded, sent to all tasks); every block meets all rows once, and a task keeps
the k best of each query only.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate;
vectors of another dimension than the query's are no candidates; rows with the query's own id are not candidates; rows repeated
with id and vector count as one; equal scores go to the smaller id; fewer candidates than k give all; no query gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RADII = (0.25, 0.4, 0.55, 0.7, 0.85, 1.0, 1.15, 1.3, 1.5, 2.0, np.inf)


def _lines(dimension: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, projections))


def _sound(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each dimension in the batch."""
    size = np.asarray(vectors.value_lengths().fill_null(0))
    for dimension in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero((size == dimension) & np.asarray(ids.is_valid()))
        flat = vectors.take(pa.array(at)).flatten().cast(pa.float64())
        matrix = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dimension)
        with np.errstate(invalid="ignore", over="ignore"):
            norm = np.sqrt((matrix * matrix).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            yield ids.take(pa.array(at[good])).to_numpy(zero_copy_only=False), matrix[good]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class _Best:
    """The k best of one query so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        new = np.ones(len(ids), bool)  # repeated rows count as one
        new[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        self.ids, self.scores = ids[new][: self.k], scores[new][: self.k]

    def distance(self) -> float:
        return float(np.sqrt(max(0.0, 2 - 2 * self.scores[-1]))) if len(self.ids) == self.k else np.inf


def _search_batch(queries: np.ndarray, query_ids: np.ndarray, q_at: np.ndarray, ids: np.ndarray, matrix: np.ndarray, lines: np.ndarray, threshold: int, best: list[_Best], rows: list[int]) -> None:
    norms = _norms(matrix)
    values = (matrix / norms[:, None]) @ lines
    order = np.argsort(values, axis=0)
    ranked = np.take_along_axis(values, order, axis=0)
    order, n, m = np.ascontiguousarray(order.T), len(ids), lines.shape[1]
    lo = np.empty((len(RADII), len(queries), m), np.int64)
    hi = np.empty_like(lo)
    for j in range(m):
        for t, radius in enumerate(RADII):
            lo[t, :, j] = np.searchsorted(ranked[:, j], q_at[:, j] - radius, "left")
            hi[t, :, j] = np.searchsorted(ranked[:, j], q_at[:, j] + radius, "right")
    q_norms = _norms(queries)
    for q in range(len(queries)):
        counts, done, mine = np.zeros(n, np.int64), np.zeros(n, bool), best[rows[q]]
        done[ids == query_ids[q]] = True
        left = right = None
        for t, radius in enumerate(RADII):
            a, b = lo[t, q].tolist(), hi[t, q].tolist()
            if left is None:
                new = [order[j, a[j] : b[j]] for j in range(m)]
            else:
                new = [order[j, a[j] : left[j]] for j in range(m)] + [order[j, right[j] : b[j]] for j in range(m)]
            counts += np.bincount(np.concatenate(new), minlength=n)
            left, right = a, b
            hit = np.flatnonzero((counts >= threshold) & ~done)
            if len(hit):
                done[hit] = True
                mine.offer(ids[hit], (matrix[hit] * queries[q]).sum(axis=1) / (norms[hit] * q_norms[q]))
            if mine.distance() <= radius:
                break


def _search(batches: Iterator[pa.RecordBatch], sent, k: int, projections: int, threshold: int, seed: int) -> Iterator[pa.RecordBatch]:
    query_ids, by_dimension = sent.value
    best = [_Best(k) for _ in query_ids]
    lines = {d: _lines(d, projections, seed) for d in by_dimension}
    for batch in batches:
        for ids, matrix in _sound(batch.column(0), batch.column(1)):
            d = matrix.shape[1]
            if d in by_dimension:
                rows, queries = by_dimension[d]
                at = (queries / _norms(queries)[:, None]) @ lines[d]
                _search_batch(queries, query_ids[rows], at, ids, matrix, lines[d], threshold, best, rows)
    found = [(np.full(len(b.ids), q), b.ids, b.scores) for q, b in zip(query_ids.tolist(), best, strict=True) if len(b.ids)]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, k: int = 5, projections: int = 48, threshold: int = 24, block: int = 2048, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) where ``is_query`` holds, against all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    queries = rows.where(is_query & F.col("embedding").isNotNull())
    blocks = max(1, -(-queries.count() // block))
    out = None
    for i in range(blocks):
        table = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        ids, by_dimension, n = [], {}, 0
        for batch in table.to_batches():
            for own, matrix in _sound(batch.column(0), batch.column(1)):
                own, first = np.unique(own, return_index=True)
                by_dimension[matrix.shape[1]] = (list(range(n, n + len(own))), matrix[first])
                ids.append(own)
                n += len(own)
        sent = spark.sparkContext.broadcast((np.concatenate(ids) if ids else np.zeros(0, np.int64), by_dimension))
        part = rows.mapInArrow(lambda b, sent=sent: _search(b, sent, k, projections, threshold, seed), "query_id long, vec_id long, score double")
        out = part if out is None else out.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.distinct().select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op9_collision_search(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
