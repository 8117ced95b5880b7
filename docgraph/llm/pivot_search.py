"""Exact top-k search by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import materialize


def usable_vector(vector: Column) -> Column:
    """Not null, not empty, no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, x as double; an error where that is no 64-bit integer."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    too_large = F.exists(vector, lambda x: finite(x) & (F.abs(x.cast("double") * scale) >= 2.0**63))
    return F.when(too_large, F.raise_error(F.lit("a component is beyond 64-bit integers")).cast("array<bigint>")).otherwise(F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sampled vector farthest from all before it."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def to_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row per vector."""
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _lists(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def leaf_bounds(q: np.ndarray, q_pivot: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The most that the inner product of each query with a vector of each leaf can be.

    A leaf's distances to pivot p lie from ``low`` to ``high``; how far a query's distance lies outside is at most its distance d from
    each vector of the leaf, and the inner product is (|q|^2 + |x|^2 - d^2) / 2. The largest over all pivots is the best bound.
    """
    d = np.zeros((len(q), len(low)))
    for p in range(low.shape[1]):
        own = q_pivot[:, p, None]
        np.maximum(d, np.maximum(low[:, p] - own, own - high[:, p]), out=d)
    squares = (q.astype(np.float64) ** 2).sum(axis=1)[:, None] + norm[None, :]
    return (squares - d**2) / 2 + 1 + 1e-9 * squares  # more than rounding can take away


class Best:
    """The ``k`` best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.worst = k, floor.copy()
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, ids, score))
        self.waiting += len(query)
        if self.waiting > 500_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drop what is no longer among the best, and raise each query's floor to its k-th best score."""
        if not self.held:
            return (np.empty(0, dtype=np.int64),) * 3
        query, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        kth = place == self.k - 1
        self.worst[query[kth]] = np.maximum(self.worst[query[kth]], score[kth])
        self.held, self.waiting = [(query[keep], ids[keep], score[keep])], 0
        return self.held[0]


def search_slab(q: np.ndarray, q_id: np.ndarray, q_pivot: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_pivot: np.ndarray, best: Best, leaf_rows: int = 64, first: int = 4) -> int:
    """Add a slab's candidates that may be among the k best of some query; how many exact scores that took.

    The slab is cut into leaves of neighbouring rows. Each query takes leaves in order of their bounds, ``first`` of them, then
    more and more at a time, until the next bound is below its floor, which rises with every round. Leaves that
    several queries take in one round are scored for all of them at once.
    """
    cuts = np.arange(0, len(x), leaf_rows)
    low, high = np.minimum.reduceat(x_pivot, cuts), np.maximum.reduceat(x_pivot, cuts)
    bound = leaf_bounds(q, q_pivot, low, high, np.maximum.reduceat((x.astype(np.float64) ** 2).sum(axis=1), cuts))
    order = np.argsort(-bound, axis=1, kind="stable")
    exact = np.float64 if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2.0**53 else np.int64
    q, x = q.astype(exact), x.astype(exact)
    done, size, scored = 0, first, 0
    while done < len(cuts):
        taken = order[:, done : done + size]
        open_ = np.take_along_axis(bound, taken, axis=1) >= best.worst[:, None]
        if not open_.any():
            break
        query, leaf = np.nonzero(open_)[0], taken[open_]
        by_leaf = np.argsort(leaf, kind="stable")
        query, leaf = query[by_leaf], leaf[by_leaf]
        ends = np.flatnonzero(np.append(leaf[1:] != leaf[:-1], True)) + 1
        for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            asking, at = query[a:b], int(cuts[leaf[a]])
            ids = x_id[at : at + leaf_rows]
            scores = q[asking] @ x[at : at + leaf_rows].T
            scored += scores.size
            row, col = np.nonzero(scores >= best.worst[asking, None])
            if len(row):
                other = ids[col] != q_id[asking[row]]
                row, col = row[other], col[other]
                best.add(asking[row], ids[col], scores[row, col].astype(np.int64))
        best.settle()
        done, size = done + size, size * 4
    return scored


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    n_pivots: int = 32,
    sample_rows: int = 1024,
    block_queries: int = 16_384,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's ``k`` highest integer inner products: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` hold ids and integer vectors (see ``quantized``). Ties go to the smaller id; a query's own id is no
    candidate. Repeated rows of a query count once, and two different vectors under one query id are two queries, each with its own ranks;
    repeated rows of a candidate count each. Vectors of another length than that of the least id take no part, nor do null ids; other
    columns, whatever their names, are not read. An empty table gives no rows. Scores that might not fit into 64 bits are an error.

    1. Pivots come from a sample of about ``sample_rows`` vectors, farthest first. Each vector's distances to the pivots are
       computed once and written with it, vectors of a partition in order of their nearest pivot and the distance to it (the pivot
       table): no shuffle. The sample's exact scores also give each query a floor that its k-th best score can't be under.
    2. Queries are taken in blocks of about ``block_queries``, whose size alone bounds what is sent to the tasks; vectors aren't
       shuffled. A task goes through its rows slab by slab (``search_slab``), with the floors that it has reached.
    3. The k best of each task are merged to the k best of all.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    vectors, queries = clean(vectors), clean(queries)
    result = "query_id long, copy long, vec_id long, score long"
    first = vectors.agg(F.min_by(F.size("v"), F.struct("id", "v")).alias("width"), F.count("*").alias("n")).first()
    if not first["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = first["width"]
    vectors, queries = vectors.where(F.size("v") == width), queries.where(F.size("v") == width).distinct()
    chosen = vectors.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)) < min(1.0, 2 * sample_rows / first["n"]) * (1 << 30)).limit(sample_rows).toArrow()
    if not len(chosen):
        chosen = vectors.limit(1).toArrow()
    chosen = chosen.sort_by("id").combine_chunks()
    sample, sample_id = _lists(chosen["v"].combine_chunks(), width), chosen["id"].to_numpy()
    pivots = choose_pivots(sample.astype(np.float64), n_pivots)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = to_pivots(_lists(batch.column(1), width).astype(np.float64), pivots)
                near = away.argmin(axis=1)
                at = pa.array(np.arange(len(away) + 1) * away.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(at, pa.array(away.ravel())), pa.array(near, pa.int32()), pa.array(away[np.arange(len(away)), near])], names=["id", "v", "p", "near", "away"]
                )

    stored = vectors.mapInArrow(describe, "id long, v array<long>, p array<double>, near int, away double").sortWithinPartitions("near", "away")
    stored = materialize(stored.select("id", "v", "p"), "pivot-table")
    asked = materialize(queries, "pivot-queries")
    blocks = max(1, -(-asked.count() // block_queries))

    def search(block: int):
        table = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not len(table):
            return None
        q, q_id = _lists(table["v"].combine_chunks(), width), table["id"].to_numpy()
        q_pivot = to_pivots(q.astype(np.float64), pivots)
        floor = np.full(len(q), np.iinfo(np.int64).min)
        largest = float(np.abs(q).max(initial=0)) * width
        if len(sample) > k and largest * float(np.abs(sample).max(initial=0)) < 2.0**63:
            scores = q @ sample.T
            scores[q_id[:, None] == sample_id[None, :]] = np.iinfo(np.int64).min
            floor = np.partition(scores, -k, axis=1)[:, -k]

        def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(floor, k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _lists(batch.column(1), width)
                if largest * float(np.abs(x).max(initial=0)) >= 2.0**63:
                    raise OverflowError("scores do not fit into 64 bits")
                search_slab(q, q_id, q_pivot, x, batch.column(0).to_numpy(), _lists(batch.column(2), len(pivots)), best)
            query, ids, score = best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(q_id[query]), pa.array(query), pa.array(ids), pa.array(score)], names=["query_id", "copy", "vec_id", "score"])

        return stored.mapInArrow(through, result)

    if blocks == 1:
        found = [search(0)]
    else:  # block by block, so that one block's queries are held at a time
        found = [materialize(part, "block-best") for block in range(blocks) if (part := search(block)) is not None]
    found = [part for part in found if part is not None] or [spark.createDataFrame([], result)]
    best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    ranked = [part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score") for part in found]
    for part in ranked[1:]:
        ranked[0] = ranked[0].unionByName(part)
    return ranked[0]
