"""Expansion over a graph until it is full or exhausted."""

from docgraph.operators import graph as G
from docgraph.operators import retrieval as Q

EDGE = "doc_id long, source string, target string, relation string, similarity double"
SEED = "query_id long, doc_id long, chunk_id int"


def follows(doc, *pairs):
    return [(doc, f"chunk:{a}", f"chunk:{b}", "follows", None) for a, b in pairs]


def reach(found, query):
    return [(r.chunk_id, r.hop) for r in sorted(found, key=lambda r: r.rank) if r.query_id == query]


def test_a_chain_is_walked_to_the_cap(spark):
    chain = follows(0, *((k, k + 1) for k in range(99)))
    rest = follows(1, (0, 1), (1, 2), (2, 0)) + follows(2, (5, 6))
    edges = spark.createDataFrame(chain + rest, EDGE)
    seeds = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 2, 9), (4, 0, 50), (5, 0, 3), (5, 0, 3), (5, 0, 90), (6, 7, 1)], SEED)
    found = G.expand(seeds, edges, most=30).collect()
    assert reach(found, 1) == [(k, k) for k in range(30)]  # 30 of 30, 29 steps away
    assert reach(found, 2) == [(0, 0), (1, 1), (2, 1)]  # a cycle ends
    assert reach(found, 3) == [(9, 0)] and reach(found, 6) == [(1, 0)]  # nothing to reach, and a document without edges
    assert len(reach(found, 4)) == 30 and {c for c, _ in reach(found, 4)} == set(range(36, 65)) | {35}
    assert len(reach(found, 5)) == 30 and {0, 3, 90} <= {c for c, _ in reach(found, 5)}
    assert G.expand(seeds.limit(0), edges).collect() == [] and G.expand(seeds, edges.limit(0)).count() == 7


def test_sections_open_and_can_be_switched_off(spark):
    contains = [(0, f"chunk:{k}", f"section:S{k // 4}", "belongs_to", None) for k in range(12)]
    edges = spark.createDataFrame([*contains, *follows(0, (3, 4)), (0, "chunk:7", "chunk:8", "similar_to", 0.9)], EDGE)
    seeds = spark.createDataFrame([(1, 0, 0)], SEED)
    assert reach(G.expand(seeds, edges).collect(), 1) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 3), (7, 3), (8, 4), (9, 5), (10, 5), (11, 5)]
    assert reach(G.expand(seeds, edges, section_step=False).collect(), 1) == [(0, 0)]
    assert [c for c, _ in reach(G.expand(seeds, edges, most=6).collect(), 1)] == [0, 1, 2, 3, 4, 5]


def test_search_goes_on_to_its_limit(spark):
    edges = spark.createDataFrame(follows(0, *((k, k + 1) for k in range(99))), EDGE)
    vectors = spark.createDataFrame([(0, k, [float(k)]) for k in (40, 41)], "doc_id long, id int, vec array<double>")
    queries = spark.createDataFrame([(7, 0, [40.2])], "query_id long, doc_id long, vec array<double>")
    found = sorted(Q.search(queries, vectors, edges).collect(), key=lambda r: r.place)
    assert [r.id for r in found][:2] == [40, 41] and len(found) == 15 and {r.id for r in found} == set(range(34, 48)) | {33}
