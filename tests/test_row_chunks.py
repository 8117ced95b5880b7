"""Chunks computed within a document's row against the steps one by one."""

import random

from pyspark.sql import functions as F

from docgraph.functions.text import PAGE_BREAK
from docgraph.operators import chunking as C
from docgraph.operators import layout as L


def documents(spark):
    rng = random.Random(3)
    line = lambda: rng.choice(["# H", "## T one", PAGE_BREAK, "", "| a | b |", " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "x1"], k=rng.randint(1, 90)))])
    texts = ["\n".join(["# first", *(line() for _ in range(rng.randint(0, 60)))]) for _ in range(12)]
    return spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "", "no header", None])], "doc_id long, markdown string")


def test_row_chunks_are_those_of_the_steps(spark):
    md = documents(spark)
    cut = C.with_table_flags(C.slices(C.regions(md)).where(~C.is_empty_chunk(F.col("content"))))
    kept = C.with_pages(C.with_neighbours(C.drop_near_repeats(cut)), L.line_pages(L.lines(md)))
    columns = ["doc_id", "chunk_index", "content", "start_line", "page_number", "section_path", "has_table", "table_context", "prev_chunk_ids", "next_chunk_ids"]
    want = sorted(map(str, kept.select(*columns).collect()))
    assert len(want) > 40
    for fold in (256, 3):  # the second sends the longer documents through the rounds
        assert sorted(map(str, C.paged_chunks(md, fold_chunks=fold).select(*columns).collect())) == want


def test_row_chunks_shuffle_nothing(spark):
    plan = C.chunk_documents(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_fold_against_all_pairs():
    rng = random.Random(4)
    sets = [rng.sample(range(40), k=rng.choice([0, 1, 10, 20, 30])) for _ in range(20)]
    for _ in range(150):
        some = list(rng.choice(sets))
        if some and rng.random() < 0.6:
            some[0] = 41 + rng.randrange(5)
        sets.append(some)
    kept = []
    for place, words in enumerate(sets):
        near = lambda k, words=words: sets[k] and words and len({*sets[k]} & {*words}) / len({*sets[k]} | {*words}) >= 0.9
        if not any(near(k) for k in kept):
            kept.append(place)
    assert C.first_of_near(sets, 0.9) == kept and len(kept) < len(sets)
