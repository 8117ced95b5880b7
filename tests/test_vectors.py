"""Exact neighbours in tiles against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.operators import graph as G
from docgraph.operators import vectors as V

VECTORS = "doc_id string, id int, vec array<double>"


def data(seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"d{d}", k, rng.integers(-3, 4, 4).astype(float).tolist()) for d, n in (("a", 70), ("b", 5), ("c", 1)) for k in range(n)]
    rows += [("dw", k, [float(k)] * (2 + k % 2)) for k in range(9)]  # two widths in one document
    return rows


def brute(rows, queries, k):
    out = []
    for q, doc, vec in queries:
        if vec is None or None in vec:
            continue
        near = sorted((sum((a - b) ** 2 for a, b in zip(vec, v, strict=True)), i) for d, i, v in rows if d == doc and v is not None and None not in v and len(v) == len(vec))
        out += [(q, doc, i, x, r) for r, (x, i) in enumerate(near[: k(q)], 1)]
    return sorted(out)


@pytest.mark.parametrize("tile_rows", [1024, 8])
@pytest.mark.parametrize("k", [1, 4, 200, "most"])
def test_nearest(spark, tile_rows, k):
    rows = [*data(), ("da", 900, None), ("da", 901, [1.0, None, 0.0, 0.0])]
    asked = [(q, d, v) for q, (d, _, v) in enumerate(rows) if q % 3 == 0] + [(500, "unknown", [0.0] * 4), (501, "da", None), (502, "dw", [0.0]), (503, "da", [0.5] * 4)]
    queries = spark.createDataFrame(asked, "query_id long, doc_id string, vec array<double>").withColumn("most", F.col("query_id") % 7)
    found = V.nearest(queries, spark.createDataFrame(rows, VECTORS), k, tile_rows=tile_rows)
    assert found.columns == ["query_id", "doc_id", "id", "distance", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(rows, asked, (lambda q: q % 7) if k == "most" else (lambda q: k))


def test_no_vectors(spark):
    none, one = spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, "a", [1.0])], "query_id long, doc_id string, vec array<double>")
    assert V.nearest(one, none, 3).collect() == [] and V.nearest(one.limit(0), none, 3).collect() == []


def test_a_large_document_is_many_tiles(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") < 90_000, "big").otherwise(F.concat(F.lit("d"), F.col("id") % 2_000)).alias("doc_id"), F.col("id").cast("int").alias("id"), F.array(F.rand(1)).alias("vec"))
    q, v = V.in_tiles(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows)
    tile = ["bucket", "q_block", "v_block"]
    sizes = v.groupBy(*tile).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).collect()
    big = [s for s in sizes if s.n > 600]
    assert max(s.n for s in sizes) < 1_600 and len(big) >= 88 * 5  # its blocks meet all five blocks of its queries
    assert max(r["count"] for r in q.groupBy(*tile).count().collect()) < 1_600
    assert max(s.docs for s in sizes) > 2  # small documents share tiles


def test_similar_edges_of_equal_vectors(spark):
    vecs = spark.createDataFrame([("a", k, [float(k // 3), 0.0]) for k in range(12)], "doc_id string, chunk_index int, vec array<double>")
    follows = spark.createDataFrame([], "doc_id string, source string, target string")
    edges = G.similar_edges(vecs, follows).collect()
    near = {(e.source, e.target) for e in edges}
    assert ("chunk:0", "chunk:1") in near and all(s != t for s, t in near) and len({frozenset(p) for p in near}) == len(near)


def test_rerank_takes_candidates_near_their_seed(spark):
    vecs = spark.createDataFrame([("a", k, [float(k)]) for k in range(100)], VECTORS)
    seeds, candidates = spark.createDataFrame([(1, "a", 10)], "query_id long, doc_id string, id int"), spark.createDataFrame([(1, k) for k in (9, 12, 30, 99)], "query_id long, id int")
    assert [(r.id, r.rank) for r in V.rerank(seeds, candidates, vecs).orderBy("rank").collect()] == [(9, 1), (12, 2), (30, 3)]  # 99 isn't among the 64 nearest
