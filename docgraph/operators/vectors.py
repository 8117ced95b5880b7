"""Embeddings and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.text import distance_to_similarity
from docgraph.sources.shared import stored


def word_counts(texts: pa.Array, width: int) -> np.ndarray:
    """One row per text: signed counts of its words in ``width`` hash buckets. Distinct words are hashed once per batch; a bucket and a sign are those of Spark's xxhash64."""
    split = pc.split_pattern_regex(pc.fill_null(texts, ""), "[ \\t-\\r]+")
    coded = split.flatten().dictionary_encode()
    bucket, sign = np.empty(len(coded.dictionary), dtype=np.int64), np.empty(len(coded.dictionary))
    for k, word in enumerate(coded.dictionary.to_pylist()):
        h = xxhash.xxh64_intdigest(word, 42)
        bucket[k] = (h - (1 << 64) if h >> 63 else h) % width
        sign[k] = (1.0 - 2.0 * (xxhash.xxh64_intdigest(b"\x01\0\0\0", h) & 1)) * (word != "")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
    code = coded.indices.to_numpy(zero_copy_only=False)
    return np.bincount(row * width + bucket[code], weights=sign[code], minlength=len(texts) * width).reshape(len(texts), width)


def hashed_words(text: DataFrame, text_col: str = "text", width: int = 64, out: str = "vec") -> DataFrame:
    """A deterministic embedding without a model: signed hashed word counts, scaled to length one; lower case, words parted by white space.

    In Arrow batches, cut so that a part holds a few megabytes of text; the time grows with the text, whatever the width. A null text and one without words have zeros.
    """

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        parts, at = [np.empty((0, width))], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (4 << 20), side="right")))
            parts.append(word_counts(texts.slice(at, to - at), width))
            at = to
        found = np.concatenate(parts)
        found /= np.maximum(np.sqrt((found * found).sum(axis=1)), 1e-12)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(found.ravel()))

    return text.withColumn(out, run(F.lower(F.col(text_col).cast("string"))))


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text_col: str = "text", out: str = "vec") -> DataFrame:
    """Adds ``out`` by a model given as a function of a list of texts; called once per Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return rows.withColumn(out, run(F.col(text_col)))


def usable(vec: Column) -> Column:
    """Whether a vector can be compared: it is there, and so are all its components."""
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull())


def in_tiles(queries: DataFrame, vectors: DataFrame, within: str = "doc_id", tile_rows: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Both tables with the tiles that their rows belong to: bucket, q_block, v_block.

    A group's vectors are in blocks of about ``tile_rows``, and so are its queries; a tile is a block of queries against one of vectors. Groups of one
    block share a bucket with others, so that small groups don't make a tile each; a large group has its blocks in all tiles of its pairs.
    A vector is sent once per block of queries, not once per query.
    """
    counts = stored(vectors.groupBy(within).agg(F.count("*").alias("n_v")).join(queries.groupBy(within).agg(F.count("*").alias("n_q")), within), "groups")
    buckets = max(1, (counts.agg(F.sum("n_v")).first()[0] or 0) // tile_rows)
    blocks = lambda n: F.ceil(F.col(n) / tile_rows).cast("int")
    sizes = counts.select(within, F.pmod(F.xxhash64(within), F.lit(buckets)).alias("bucket"), blocks("n_v").alias("v_blocks"), blocks("n_q").alias("q_blocks"))
    own = lambda key, n: F.pmod(F.xxhash64(key, F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, within).select(*queries.columns, "bucket", own("query_id", "q_blocks").alias("q_block"), every("v_blocks").alias("v_block"))
    v = vectors.join(sizes.select(*[F.col(c).alias(c) for c in sizes.columns]), within).select(*vectors.columns, "bucket", own("id", "v_blocks").alias("v_block"), every("q_blocks").alias("q_block"))
    return q, v


def _matrix(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    return np.stack(column.take(pa.array(rows)).to_numpy(zero_copy_only=False)).astype(np.float64)


def _groups(queries: pa.Table, vectors: pa.Table, within: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of ``queries``, rows of ``vectors``, their matrices) of each group and width in a tile."""
    groups: dict[tuple, tuple[list[int], list[int]]] = {}
    for side, table in enumerate((queries, vectors)):
        for row, (group, width) in enumerate(zip(table[within].to_pylist(), pc.list_value_length(table["vec"]).to_pylist(), strict=True)):
            groups.setdefault((group, width), ([], []))[side].append(row)
    for asked, there in groups.values():
        if asked and there:
            asked, there = np.array(asked), np.array(there)
            yield asked, there, _matrix(queries["vec"], asked), _matrix(vectors["vec"], there)


def _row_sums(pairs: int, products: Callable[[slice], np.ndarray]) -> np.ndarray:
    """Sums over the components of pairs, one after another as an aggregate adds them, some pairs at a time."""
    parts = [np.empty(0)]
    for at in range(0, pairs, 65536):
        p = products(slice(at, at + 65536))
        parts.append(np.cumsum(p, axis=1)[:, -1] if p.shape[1] else np.zeros(len(p)))
    return np.concatenate(parts)


def _nearest_in_tile(queries: pa.Table, vectors: pa.Table, within: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``queries``, row of ``vectors``, distance) of the nearest in one tile, each query with its group's vectors of its width.

    A matrix product gives distances that are near enough to leave most out; those that may be among the nearest are computed from the differences.
    """
    ids, most = vectors["id"].to_numpy(), queries["k"].to_numpy()
    found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
    for asked, there, q, v in _groups(queries, vectors, within):
        k = most[asked]
        q_norm, v_norm = (q * q).sum(axis=1), (v * v).sum(axis=1)
        about = q_norm[:, None] + v_norm[None, :] - 2 * (q @ v.T)
        line = np.full(len(q), np.inf)
        for limit in np.unique(k[k < len(v)]).tolist():
            line[k == limit] = np.partition(about[k == limit], limit - 1, axis=1)[:, limit - 1] if limit > 0 else -np.inf
        i, j = np.nonzero(~(about > (line + 1e-9 * (q_norm + v_norm.max()) + 1e-12)[:, None]))
        exact = _row_sums(len(i), lambda at, i=i, j=j, q=q, v=v: (q[i[at]] - v[j[at]]) ** 2)
        order = np.lexsort((ids[there[j]], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kept = place < k[i]
        found.append((asked[i[kept]], there[j[kept]], exact[kept]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(queries: DataFrame, vectors: DataFrame, k: int | str, within: str = "doc_id", tile_rows: int = 1024) -> DataFrame:
    """query_id, within, id, distance (squared L2), rank: the ``k`` nearest vectors of each query in its document, ties to the smaller id.

    queries: (query_id, within, vec); vectors: (within, id, vec); ``k`` may be a column of ``queries``. Exact: every query meets every vector of
    its document, in tiles of bounded size that are tasks of their own, as products of matrices; a tile gives each of its queries' ``k`` nearest,
    and these are merged. Vectors that are null or hold nulls take no part, nor do pairs of unequal widths; queries of documents without
    vectors have no rows. Equal vectors tie by id.
    """
    schema = {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}
    own = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  both tables may come from one
    asked = queries.where(usable(F.col("vec"))).select(*own("query_id", within, "vec"), (F.col(k) if isinstance(k, str) else F.lit(k)).cast("long").alias("k"))
    q, v = in_tiles(asked, vectors.where(usable(F.col("vec"))).select(*own(within, "id", "vec")), within, tile_rows)

    def tile(asked: pa.Table, there: pa.Table) -> pa.Table:
        i, j, distance = _nearest_in_tile(asked, there, within)
        i = pa.array(i)
        return pa.table([asked["query_id"].take(i), asked[within].take(i), there["id"].take(pa.array(j)), pa.array(distance), asked["k"].take(i)], names=["query_id", within, "id", "distance", "k"])

    key = ["bucket", "q_block", "v_block"]
    found = q.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(tile, f"query_id {schema['query_id']}, `{within}` {schema[within]}, id {schema['id']}, distance double, k long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(within, "query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= (F.col("k") if isinstance(k, str) else k)).drop("k")


def all_scores(queries: DataFrame, vectors: DataFrame, within: str = "doc_id", tile_rows: int = 1024) -> DataFrame:
    """query_id, id, distance (squared L2), cosine of every query (query_id, within, vec) with every vector (within, id, vec) of its group.

    The rows are as many as the pairs; they are made in tiles of bounded size, some at a time, each sum in the order of the components. Vectors that are null or hold
    nulls, and pairs of unequal widths, take no part. The cosine with a vector of zeros is 0.
    """
    schema = {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}
    own = lambda *names: [F.col(c).alias(c) for c in names]
    q, v = in_tiles(queries.where(usable(F.col("vec"))).select(*own("query_id", within, "vec")), vectors.where(usable(F.col("vec"))).select(*own(within, "id", "vec")), within, tile_rows)

    def tile(asked: pa.Table, there: pa.Table) -> pa.Table:
        found = [pa.table([asked["query_id"].slice(0, 0), there["id"].slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.float64())], names=["query_id", "id", "distance", "cosine"])]
        for rows, others, a, b in _groups(asked, there, within):
            sums = lambda p: np.cumsum(p, axis=1)[:, -1] if p.shape[1] else np.zeros(len(p))
            one, other = np.sqrt(sums(a * a)), np.sqrt(sums(b * b))
            ids = there["id"].take(pa.array(others))
            for k, row in enumerate(rows.tolist()):
                norm, dot = one[k] * other, sums(a[k] * b)
                cosine = np.divide(dot, norm, out=np.zeros(len(b)), where=norm > 0)
                found.append(pa.table([asked["query_id"].take(pa.array(np.full(len(b), row))), ids, pa.array(sums((a[k] - b) ** 2)), pa.array(cosine)], names=["query_id", "id", "distance", "cosine"]))
        return pa.concat_tables(found)

    key = ["bucket", "q_block", "v_block"]
    return q.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(tile, f"query_id {schema['query_id']}, id {schema['id']}, distance double, cosine double")


def alike_pairs(vectors: DataFrame, at_least: float, within: str = "doc_id", most_ratio: float = 1.25, tile_rows: int = 1024) -> DataFrame:
    """within, first, second, score: pairs first < second of a group whose cosine is ``at_least``, and whose sizes are within ``most_ratio`` of each other.

    vectors: (within, id, size, vec). Exact, in tiles as ``nearest``: a product of matrices leaves out nearly all pairs, and only those that may be alike enough are
    computed one by one and given out. Vectors that are null, hold nulls or are all zeros, and pairs of unequal widths, take no part.
    """
    schema = {f.name: f.dataType.simpleString() for f in vectors.schema}
    known = vectors.where(usable(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    own = lambda key: known.select(F.col(within).alias(within), F.col("id").alias(key), F.col("size").cast("double").alias("size"), F.col("vec").alias("vec"))
    q, v = in_tiles(own("query_id"), own("id"), within, tile_rows)

    def tile(one: pa.Table, other: pa.Table) -> pa.Table:
        first, second = one["query_id"].to_numpy(), other["id"].to_numpy()
        size, other_size = one["size"].to_numpy(), np.maximum(other["size"].to_numpy(), 1)
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        for asked, there, a, b in _groups(one, other, within):
            norms = [np.sqrt(np.cumsum(m * m, axis=1)[:, -1]) for m in (a, b)]
            about = (a / norms[0][:, None]) @ (b / norms[1][:, None]).T
            ratio = size[asked][:, None] / other_size[there][None, :]
            i, j = np.nonzero((about >= at_least - 1e-9) & (first[asked][:, None] < second[there][None, :]) & (ratio >= 1 / most_ratio) & (ratio <= most_ratio))
            score = _row_sums(len(i), lambda at, i=i, j=j, a=a, b=b: a[i[at]] * b[j[at]]) / (norms[0][i] * norms[1][j])
            kept = score >= at_least
            found.append((asked[i[kept]], there[j[kept]], score[kept]))
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([one[within].take(pa.array(i)), one["query_id"].take(pa.array(i)), other["id"].take(pa.array(j)), pa.array(score)], names=[within, "first", "second", "score"])

    key = ["bucket", "q_block", "v_block"]
    return q.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(tile, f"`{within}` {schema[within]}, first {schema['id']}, second {schema['id']}, score double")


def rerank(seeds: DataFrame, candidates: DataFrame, vectors: DataFrame, k: int = 5, scale: float = 150.0, search: int = 64) -> DataFrame:
    """query_id, id, score, rank: a query's candidates by likeness to its seed's vector, those among the seed's nearest only.

    seeds: (query_id, doc_id, id); candidates: (query_id, id). The search goes as far as the candidates are many, ``search`` at least.
    """
    many = candidates.groupBy("query_id").agg(F.greatest(F.count("*"), F.lit(search)).alias("most"))
    own = seeds.select("query_id", "doc_id", "id").join(vectors, ["doc_id", "id"]).join(many, "query_id").select("query_id", "doc_id", "vec", "most")
    found = nearest(own, vectors, "most")
    kept = found.join(candidates, ["query_id", "id"], "left_semi").withColumn("score", distance_to_similarity(F.col("distance"), scale))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def best_scores(scored: DataFrame) -> DataFrame:
    """query_id, id, score: the best where a chunk recurs."""
    return scored.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def score_summary(scored: DataFrame) -> DataFrame:
    """query_id, n, avg_score, max_score, min_score."""
    return scored.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))
