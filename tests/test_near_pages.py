"""Hashed words by value, and the recall of near pages at the parameters that they are registered with."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgraph.functions.text import words
from docgraph.operators import dedup as D
from docgraph.operators import vectors as V

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def test_hashed_words_by_value(spark):
    texts = [None, "", " \t ", "One two  TWO\nthree", "été ÉTÉ naïve", "x" * 5000, "a b c d e f g " * 3000, "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    made = {r.id: r.vec for r in V.hashed_words(rows, width=8).collect()}
    hits = rows.select("id", F.explode(words(F.lower("text"))).alias("w"))
    sums = hits.groupBy("id", F.pmod(F.xxhash64("w"), F.lit(8)).alias("b")).agg(F.sum(F.when(F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("s")).collect()
    for k in range(len(texts)):
        expected = np.zeros(8)
        for r in sums:
            if r.id == k:
                expected[r.b] = r.s
        assert np.allclose(made[k], expected / max(np.sqrt((expected**2).sum()), 1e-12))
    assert made[1] == [0.0] * 8 == made[0]


def test_embed_is_called_by_batches(spark):
    rows = spark.createDataFrame([(k, f"t{k}" if k else None) for k in range(30)], "id int, text string").coalesce(1)
    made = V.embed(rows, lambda texts: [[float(len(texts)), float(len(t))] for t in texts])
    assert {(r.id, tuple(r.vec)) for r in made.collect()} == {(k, (30.0, float(len(f"t{k}") if k else 0))) for k in range(30)}


@pytest.mark.parametrize("at_least", [0.9, 0.95, 0.8])
def test_shape_reaches_the_recall(at_least):
    rng = np.random.default_rng(2)
    for n in (100, 100_000, 10_000_000):
        planes, tables = D.lsh_shape(n, at_least, 0.95)
        a = rng.normal(size=(3000, 16))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.normal(size=a.shape)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        near = at_least * a + np.sqrt(1 - at_least**2) * b  # just at the threshold
        assert shared([a, near], planes, tables).mean() >= 0.93
    assert D.lsh_shape(10_000_000, 0.9, 0.95)[0] > D.lsh_shape(1_000, 0.9, 0.95)[0]


def shared(sides, planes, tables):
    keys = []
    for v in sides:
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "vec"])
        out = pa.Table.from_batches(D._buckets(iter([batch]), planes, tables, 1))
        order = np.argsort(out["id"].to_numpy(), kind="stable")
        keys.append(out["bucket"].to_numpy()[order].reshape(len(v), tables))
    return (keys[0] == keys[1]).any(axis=1)


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="no test tables")
def test_direct_recall_at_the_registered_parameters(spark):
    rows = V.hashed_words(spark.read.parquet(DOCUMENTS).select(F.col("doc_id").alias("id"), "text"), width=32).select("id", "vec").where(F.exists("vec", lambda x: x != 0)).collect()
    v = np.unique(np.array([r.vec for r in rows]), axis=0)  # equal vectors are linked in any case
    scores = v @ v.T
    i, j = np.nonzero(np.triu(scores >= 0.9, 1))
    planes, tables = D.lsh_shape(len(v), 0.9, 0.95)
    hit = shared([v[i], v[j]], planes, tables)
    assert len(i) > 500 and hit.mean() >= 0.95
    assert hit[scores[i, j] < 0.92].mean() >= 0.93


@pytest.mark.parametrize("tile_rows", [1024, 16])
def test_near_pairs_against_brute_force(spark, tile_rows):
    rng = np.random.default_rng(8)
    v = np.abs(rng.normal(size=(240, 26))) ** 3
    v[200:] = v[:40] * (1 + 0.05 * rng.normal(size=(40, 26)))
    v[7] = 0
    sizes = rng.integers(0, 100, len(v))
    rows = spark.createDataFrame([(k % 2, k, int(n), x.tolist()) for k, (n, x) in enumerate(zip(sizes, v, strict=True))] + [(0, 900, 5, None)], "doc_id int, id int, size int, vec array<double>")
    with np.errstate(invalid="ignore"):
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.nan_to_num(unit @ unit.T)
    for least in (0.9, 0.97):
        near = {(i % 2, i, j) for i in range(240) for j in range(i + 1, 240) if i % 2 == j % 2 and scores[i, j] >= least and 0.8 <= sizes[i] / max(1, sizes[j]) <= 1.25}
        found = V.alike_pairs(rows, least, tile_rows=tile_rows).collect()
        assert {(r.doc_id, r["first"], r.second) for r in found} == near != set() and len(found) == len(near)
        assert all(abs(r.score - scores[r["first"], r.second]) < 1e-9 for r in found)
