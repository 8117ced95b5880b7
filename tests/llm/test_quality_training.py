"""The quality model's training against the same sums over all rows in plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.llm import quality_model as Q


def described(spark, x, labels):
    return spark.createDataFrame([(k, int(y), [float(v) for v in row]) for k, (row, y) in enumerate(zip(x, labels, strict=True))], "id long, label int, features array<float>")


def drawn(n, share, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).astype(np.float32).astype(np.float64)
    return x, (x @ [1.5, -1.0, 0.0] + rng.normal(size=n) > share).astype(int)


def test_every_pair_of_a_group_counts(spark):
    x, labels = drawn(90, 0.3)
    grouped = Q.deal_groups(described(spark, x, labels), {1: int(labels.sum()), 0: int((1 - labels).sum())})
    mean, scale, w = Q.fit_groups(grouped, 3, ridge=0.01)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(scale, x.std(axis=0) + 1e-6)
    z = (x - mean) / scale
    d = (z[labels == 1][:, None] - z[labels == 0][None]).reshape(-1, 3)
    v = np.zeros(3)
    for _ in range(3000):
        v -= 0.5 * (0.01 * v - d.T @ (1 / (1 + np.exp(d @ v))) / len(d))
    assert np.allclose(w, v, atol=1e-6)


def test_all_rows_are_dealt_and_rare_labels_meet_all(spark):
    x, labels = drawn(3000, 4.5)
    counts = {1: int(labels.sum()), 0: int((1 - labels).sum())}
    assert 0 < counts[1] < 60
    groups = Q.deal_groups(described(spark, x, labels), counts).collect()
    assert sum(sum(g["once"]) for g in groups) == 3000 and len(groups) == 3000 // 256
    assert all(1 in g["labels"] and 0 in g["labels"] for g in groups)


def test_threshold_is_the_best_of_all_rows(spark):
    rng = np.random.default_rng(4)
    for raw in (np.round(rng.normal(size=400), 1), rng.normal(size=400), np.zeros(5)):
        labels = (raw + rng.normal(size=len(raw)) > 0).astype(int)
        labels[:2] = [0, 1]
        rows = spark.createDataFrame([(float(r), int(y)) for r, y in zip(raw, labels, strict=True)], "raw double, label int").repartition(3)
        n = [int((labels == k).sum()) for k in (0, 1)]
        found = Q.best_threshold(rows, dict(enumerate(n)))
        values = np.unique(raw)
        balance = lambda t: ((raw < t) & (labels == 0)).sum() / n[0] + ((raw >= t) & (labels == 1)).sum() / n[1]
        middles = (values[1:] + values[:-1]) / 2
        assert found == (pytest.approx(middles[np.argmax([balance(t) for t in middles])]) if len(middles) else 0)


def test_a_row_beyond_the_old_bound_counts(spark, monkeypatch):
    """Every labelled row reaches the fit; it was 12,000 of each label at most, and 20,000 of their pairs."""
    seen = []
    deal = Q.deal_groups
    monkeypatch.setattr(Q, "deal_groups", lambda rows, counts: seen.append(counts) or deal(rows, counts))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "fine words here").otherwise("## ** ##").alias("text"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    model = Q.train_quality_model(docs, labels)
    learnt = labels.where(~Q.held_out(F.col("doc_id"))).groupBy("quality").count().collect()
    assert seen == [{r["quality"]: r["count"] for r in learnt}] and min(seen[0].values()) > 12_000
    few = docs.where("doc_id < 50")
    assert {r.doc_id for r in Q.keep_good(few, model).collect()} == set(range(0, 50, 2))
    assert np.allclose(Q.train_quality_model(docs, labels, broadcast_rows=10).weights, model.weights, atol=1e-9)
