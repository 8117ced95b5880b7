"""Repeated lines against brute force, with bitmaps read back."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docgraph.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))


def brute(rows, least_chars, least_docs):
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    keeper = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in keeper or keeper[key(line)] == doc_id]
        out.append((str(doc_id), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    lines = [f"line {k} é " + "x" * rng.randint(0, 12) for k in range(30)] + ["", " ", "short", "\x0b Padded LINE with Blanks \r", "padded line with blanks", "Ünïcode İ line", "ünïcode İ line"]
    rows = [(k, "\n".join(rng.choices(lines, k=rng.randint(1, 12)))) for k in range(90)]
    rows += [(k, f"the most common line of all\n{k} own line of this text\n" + "the most common line of all") for k in range(100, 180)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "y" * 50_000 + "\nthe most common line of all"), (None, "the most common line of all\nof no id"), (None, "The Most Common line of all ")]
    return [*rows, rows[0], rows[0], (3, "another text of id 3\nthe most common line of all")]


@pytest.mark.parametrize(("least_chars", "least_docs"), [(10, 5), (1, 2), (40, 5)])
def test_dedup_lines(spark, rows, least_chars, least_docs):
    docs = spark.createDataFrame([(k, t, "z", 7) for k, t in rows], "doc_id long, text string, lines string, h1 long").repartition(5)
    found = line_dedup.dedup_lines(docs, least_chars, least_docs)
    assert found.columns == ["doc_id", "text", "lines", "h1", "_lines"]
    assert sorted((str(r.doc_id), r._lines.n_lines, r._lines.n_dropped, r._lines.kept_text) for r in found.collect()) == brute(rows, least_chars, least_docs)


def test_bitmaps_are_runs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.keep_bitmaps(docs, 10, 5)
    assert found.columns == ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"]
    for r in found.collect():
        assert sum(k.length for k in r.keep) == r.n_lines - r.n_dropped
        assert all(a.start + a.length < b.start for a, b in zip(r.keep, r.keep[1:], strict=False))
    joined = docs.join(found.drop("n_lines"), "doc_id").where(F.col("text_hash") == F.xxhash64("text"))
    texts = {(r.doc_id, r.t) for r in joined.select("doc_id", line_dedup.kept_text(F.col("text"), F.col("keep")).alias("t")).collect()}
    assert texts == {(int(k), t) for k, _, _, t in brute([(k, t) for k, t in rows], 10, 5) if k != "None"}


def test_a_common_line_is_spread_over_ranges(spark):
    rows = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("one line that every document of the table holds").alias("text"))
    found = line_dedup.dropped_places(line_dedup.line_places(rows.repartition(8)))
    assert found.count() == 3_999 and found.agg(F.max("id")).first()[0] == 3_998
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = line_dedup.line_places(rows.repartition(8)).repartitionByRange("h1", "h2", F.col("id").desc()).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2_000


def test_no_documents(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
