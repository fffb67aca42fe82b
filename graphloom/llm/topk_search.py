"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments.  With the mean m and the deviation d (root of the summed squares about the mean) of each, a
segment of n components adds at most n * m_q * m_v + d_q * d_v to an inner product, which is a lower bound of the
distance |q|^2 + |v|^2 - 2 <q, v>.  Bounds are taken with one segment, then more, ever finer ones; whatever may still beat a
query's k-th best so far is computed exactly, in integers.

Queries go out in blocks of bounded size, one after the other; each block is one pass over the vectors, in which a task keeps the
k best of each query, and its result is written before the next block is fetched, so the driver never holds two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, col

#: Bytes of query components sent out at once.
BLOCK_BYTES = 8 << 20
SEGMENTS = (1, 4, 16)
#: Components up to this size are exact in double precision sums of up to 2**13 products.
EXACT = 1 << 20
_LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """The components as double; null for null vectors and those with null or non-finite components."""
    v = F.transform(vector, lambda x: x.cast("double"))
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & whole, v)


def _stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of equal segments (the last one padded by zeros), ready for the bound's two products."""
    n, d = x.shape
    width = -(-d // segments)
    if width * segments > d:
        x = np.hstack([x, np.zeros((n, width * segments - d))])
    x = x.reshape(n, segments, width)
    mean = x.mean(axis=2)
    dev = np.sqrt(((x - mean[:, :, None]) ** 2).sum(axis=2))
    return mean * np.sqrt(width), dev


class _Best:
    """The k best candidates of each query: larger scores first, then smaller ids."""

    def __init__(self, queries: np.ndarray, k: int):
        self.k, self.scores, self.ids = k, [[] for _ in queries], [[] for _ in queries]
        self.least = np.full(len(queries), -np.inf)

    def add(self, q: int, scores: list, ids: list) -> None:
        best = sorted(zip((-s for s in [*self.scores[q], *scores]), [*self.ids[q], *ids], strict=True))[: self.k]
        self.scores[q], self.ids[q] = [-s for s, _ in best], [i for _, i in best]
        if len(best) == self.k:
            self.least[q] = float(self.scores[q][-1])


def _matrix(vectors: list[list[float]], scale: int, d: int) -> np.ndarray:
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def _search(query_ids: np.ndarray, query_vectors: list[list[float]], k: int, scale: int, segments: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, levels, queries = _Best(query_ids, k), [], np.zeros((0, 0))
        widest = max(map(len, query_vectors), default=0)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, vectors = np.array(part.column(0).to_pylist(), np.int64), part.column(1).to_pylist()
                d = max(1, widest, *map(len, vectors)) if vectors else 1
                if queries.shape[1] != d:
                    queries = _matrix(query_vectors, scale, d)
                    levels = [_stats(queries, min(s, d)) for s in segments]
                x = _matrix(vectors, scale, d)
                if max(np.abs(x).max(initial=0), np.abs(queries).max(initial=0)) > EXACT or d > 1 << 13:
                    _exactly(best, query_ids, query_vectors, ids, vectors, scale)
                    continue
                own = [_stats(x, min(s, d)) for s in segments]
                for q0 in range(0, len(query_ids), 256):
                    _block(best, query_ids, queries, levels, ids, x, own, slice(q0, q0 + 256))
        rows = [(int(query_ids[q]), int(i), max(-_LONG - 1, min(_LONG, int(s)))) for q in range(len(query_ids)) for s, i in zip(best.scores[q], best.ids[q], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [(), (), ()])], names=["query_id", "vec_id", "score"])

    return run


def _block(best: _Best, query_ids, queries, levels, ids, x, own, q: slice) -> None:
    """Bounds from coarse to fine, then exact products of the survivors, for some queries and some vectors."""
    if best.least[q].min() == -np.inf:  # seed the k best so that bounds have something to beat
        head = slice(0, min(len(ids), 4 * best.k))
        _take(best, query_ids, ids, q, (queries[q] @ x[head].T), np.ones((queries[q].shape[0], head.stop), bool))
        rest = np.arange(head.stop, len(ids))
    else:
        rest = np.arange(len(ids))
    if not len(rest):
        return
    # a bound may fall short by rounding: components are below 2**20, so a relative 1e-9 of the norms is ample
    slack = 1e-9 * np.outer(np.sqrt((queries[q] ** 2).sum(axis=1)), np.sqrt((x[rest] ** 2).sum(axis=1))) + 1e-6
    alive = np.ones((queries[q].shape[0], len(rest)), bool)
    for (qm, qd), (xm, xd) in zip(levels, own, strict=True):
        bound = qm[q] @ xm[rest].T + qd[q] @ xd[rest].T
        alive &= bound + slack >= best.least[q][:, None]
        some = alive.any(axis=0)
        if not some.all():
            rest, alive, slack = rest[some], alive[:, some], slack[:, some]
        if not len(rest):
            return
    _take(best, query_ids, ids[rest], q, queries[q] @ x[rest].T, alive)


def _take(best: _Best, query_ids, ids, q: slice, exact: np.ndarray, alive: np.ndarray) -> None:
    alive = alive & (exact >= best.least[q][:, None]) & (ids[None, : exact.shape[1]] != query_ids[q][:, None])
    for i in np.flatnonzero(alive.any(axis=1)):
        at = np.flatnonzero(alive[i])
        if len(at) > 4 * best.k:  # only those that reach the k-th largest
            at = at[exact[i, at] >= np.partition(exact[i, at], len(at) - best.k)[len(at) - best.k]]
        best.add(q.start + i, exact[i, at].astype(np.int64).tolist(), ids[at].tolist())


def _exactly(best: _Best, query_ids, query_vectors, ids, vectors, scale) -> None:
    """Whole-number arithmetic without a limit, for components of any size."""
    from fractions import Fraction
    from math import floor

    whole = lambda v: [floor(Fraction(c) * scale) for c in v]
    xs = [whole(v) for v in vectors]
    for q, v in enumerate(query_vectors):
        v = whole(v)
        pairs = [(sum(a * b for a, b in zip(v, x, strict=False)), int(i)) for x, i in zip(xs, ids, strict=True) if i != query_ids[q]]
        best.add(q, [p[0] for p in pairs], [p[1] for p in pairs])


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row that the condition ``queries`` picks.

    Score: the inner product of floor(scale * x) of both vectors, ties to the smaller id.  Shorter vectors count as
    padded by zeros.  Rows with a null id and vectors that are null or hold a null or non-finite component take no
    part; with fewer than k others all are returned.  Rows that share an id are not each other's neighbours; as a query,
    such an id has the first of its vectors in order.  Scores beyond 64 bits are cut to their range.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    base = vectors.select(col(id_col).cast("long").alias("vec_id"), finite(col(vector_col)).alias("v"), queries.alias("q")).where("vec_id is not null and v is not null")
    asked = work.save(base.where("q").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, longest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * max(1, longest or 0) * 8 // BLOCK_BYTES))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(f"rank <= {k}")
    parts = []
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = sorted(block.collect())  # a block of bounded size
        search = _search(np.array([r.vec_id for r in rows], np.int64), [r.v for r in rows], k, scale, segments)
        del rows
        parts.append(work.save(best(base.select("vec_id", "v").mapInArrow(search, "query_id long, vec_id long, score long")), "best").workspace_path)
        del search
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*parts)
