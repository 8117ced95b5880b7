"""Near pages in time that grows with the corpus: what is compared, how often rows are dealt, how often vectors are made."""

import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgraph.operators import dedup as D


def groups(n, pairs):
    return D._joined(n, [(int(a), int(b)) for a, b in pairs])


def corpus(n=1500, width=8):
    """Unlike rows, near copies of some, a large group of near copies, and rows around that group's edge."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(n, width))
    v[n // 2 : n // 2 + 200] = v[:200] + 0.15 * rng.normal(size=(200, width))
    middle = rng.normal(size=width)
    v[-400:] = middle + 0.1 * rng.normal(size=(400, width))
    v[-500:-400] = middle + 0.45 * rng.normal(size=(100, width))
    return v[rng.permutation(n)]


@pytest.mark.parametrize("tile_rows", [16, 4096])
def test_forest_connects_what_near_pairs_connect(tile_rows):
    v = D._unit(corpus())
    near = np.triu(v @ v.T >= 0.95, 1)
    rng = np.random.default_rng(1)
    known = np.where(rng.random(len(v)) < 0.4, groups(len(v), np.argwhere(near)), -1)  # some rows are known to be joined
    side = rng.integers(0, 2, len(v))
    for group in (None, known):
        joined = [] if group is None else [(np.flatnonzero(group == g)[0], k) for g in np.unique(group[group >= 0]) for k in np.flatnonzero(group == g)]
        for inside in ((True, True), (True, False), (False, True), (False, False)):
            a, b, score = D._forest(v, 0.95, group, side, inside, tile_rows)
            assert (score >= 0.95).all() and np.allclose(score, (v[a] * v[b]).sum(axis=1))
            asked = [(i, j) for i, j in np.argwhere(near) if side[i] != side[j] or inside[side[i]]]
            found = groups(len(v), [*zip(a, b), *joined])
            assert all(found[i] == found[j] for i, j in asked)
            assert len(a) == len(np.unique(groups(len(v), joined))) - len(np.unique(found))  # a forest: no link between what is joined


def test_unlike_rows_are_compared_in_products():
    v = D._unit(np.random.default_rng(3).normal(size=(6000, 32)))
    began = time.process_time()
    assert len(list(D._forest(v, 0.95))[0]) == 0
    taken = time.process_time() - began
    began = time.process_time()
    (v @ v.T >= 0.95).sum()
    assert taken < 8 * (time.process_time() - began) + 0.5  # a product per row took 50 times as long


def test_rows_are_dealt_by_what_is_not_joined_yet(spark):
    groups_of = [5] * 2000 + [-1] * 60 + [6] * 30
    rows = spark.createDataFrame([(k, g, 1) for k, g in enumerate(groups_of)] + [(k, -1, 2) for k in range(50)] + [(k, -1, 3) for k in range(500)] + [(k, 7, 4) for k in range(400)], "id long, group int, bucket long")
    dealt = D.in_tasks(rows, rows, 200).collect()
    assert len(dealt) <= 2000 + 90 * 21 + 50 + 500 * 4  # a pair of blocks a task would be 2090 * 20 for the first bucket
    tasks = defaultdict(list)
    for r in dealt:
        tasks[r.task].append(r)
    met = Counter()
    for members in tasks.values():
        for a in members:
            for b in members:
                if a.id < b.id and (a.group < 0 or a.group != b.group) and (a.side != b.side or a.inside):
                    met[a.id, b.id] += 1
        assert all(len({r.inside for r in members if r.side == s}) < 2 for s in (0, 1)) and len(members) <= 450
    first = {(a, b) for a in range(2090) for b in range(max(a + 1, 2000), 2090) if groups_of[a] < 0 or groups_of[a] != groups_of[b]}
    rest = Counter([*first, *((a, b) for n in (50, 500) for a in range(n) for b in range(a + 1, n))])
    assert met == rest


@pytest.mark.parametrize("n_hubs, block_rows", [(16, 65536), (16, 40), (200, 40), (1, 300)])
def test_hubs_and_blocks_against_brute_force(spark, n_hubs, block_rows):
    v = corpus()
    rows = spark.createDataFrame([(f"d{k}", x.tolist()) for k, x in enumerate(v)], "id string, vec array<double>")
    unit = D._unit(v)
    near = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))
    links = [(int(a[1:]), int(b[1:]), score, a < b) for a, b, score in D.near_pages_lsh(rows, 0.95, planes=4, tables=12, block_rows=block_rows, n_hubs=n_hubs).collect()]
    assert all(o and abs(s - unit[a] @ unit[b]) < 1e-9 and s >= 0.95 for a, b, s, o in links)
    found = groups(len(v), [x[:2] for x in links])
    assert (found[near[:, 0]] == found[near[:, 1]]).mean() >= 0.98
    assert len(links) < 6 * len(v)


def test_vectors_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def make(k):
        calls.add(1)
        return [1.0, float(k % 5), 0.5]

    rows = spark.range(40).select("id", make("id").alias("vec"))
    assert D.near_pages_lsh(rows, 0.99).count() >= 35 and calls.value == 40
