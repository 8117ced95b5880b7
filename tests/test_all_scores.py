"""Scores of all pairs of a group in tiles against plain loops."""

import math

import numpy as np
import pytest

from docgraph.operators import vectors as V


def test_all_pairs_are_scored_in_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 3, [float(x) for x in rng.normal(size=4)]) for k in range(90)] + [(90, 0, [0.0] * 4), (91, 0, None), (92, 0, [1.0, None, 0.0, 0.0]), (93, 1, [1.0, 2.0]), (94, 7, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "id long, doc_id int, vec array<double>")
    queries = spark.createDataFrame([r for r in rows if r[0] % 5 == 0], "query_id long, doc_id int, vec array<double>")
    found = V.all_scores(queries, vectors, tile_rows=16)
    assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()  # tiles, not a join that makes a row with both vectors of each pair
    good = [r for r in rows if r[2] and None not in r[2]]
    want = {}
    for q, g, a in good:
        for v, h, b in good:
            if q % 5 == 0 and g == h and len(a) == len(b):
                norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
                want[q, v] = (sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm else 0.0)
    got = {(r.query_id, r.id): (r.distance, r.cosine) for r in found.collect()}
    assert got.keys() == want.keys() and found.count() == len(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
