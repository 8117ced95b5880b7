"""Work that grows with the text, and near repeats without a document in one value."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docgraph.functions import text as T
from docgraph.operators import chunking as C
from docgraph.operators import layout as L


def seconds(df):
    best = 9e9
    for _ in range(2):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return best


def test_scan(spark):
    rows = spark.createDataFrame([([],), (None,), ([5],), (list(range(300)),)], "xs array<int>")
    sums = T.scan(F.col("xs"), F.lit(0), "int", "int", lambda s, x: F.struct((s + x).alias("state"), (s + x).alias("out")), block=7)
    found = [r.s for r in rows.select(sums.alias("s")).collect()]
    assert found[0] == [] and not found[1] and found[2] == [5] and found[3] == [k * (k + 1) // 2 for k in range(300)]


def test_slices_of_a_long_region(spark):
    def sliced(n):
        text = ("x" * 60 + "\n" + "é" * 39 + "\n") * (n // 101)
        return C.slices(spark.createDataFrame([(0, 4, 1, "T", "T", 1000, text)], "doc_id long, line int, level int, title string, section_path string, size int, region string"))

    made = sliced(300_000)
    last = made.orderBy(F.desc("k")).first()
    assert last.start_line == 5 + ("x" * 60 + "\n" + "é" * 39 + "\n").__mul__(300_000 // 101)[: last.k * 1000].count("\n")
    one, two = seconds(sliced(1_000_000)), seconds(sliced(2_000_000))
    assert two < 3 and two < 2.3 * one + 0.3


def test_paths_of_many_headers(spark):
    def headed(n):
        text = "\n".join("#" * (1 + k % 5) + f" t{k}" for k in range(n))
        return L.headers(spark.createDataFrame([(0, text)], "doc_id long, markdown string"))

    assert headed(1_000).where("line = 994").first().section_path == "t990 > t991 > t992 > t993"
    one, two = seconds(headed(4_000)), seconds(headed(8_000))
    assert two < 1.5 and two < 2.3 * one + 0.3


def test_regions_of_many_headers(spark):
    def headed(n):
        return C.regions(spark.createDataFrame([(0, "\n".join(f"# t{k}\nsome text" for k in range(n)))], "doc_id long, markdown string"))

    assert headed(500).count() == 500
    assert seconds(headed(8_000)) < 2.3 * seconds(headed(4_000)) + 0.3


def test_packed_paragraphs(spark):
    def packed(n):
        return C.pack_paragraphs(spark.createDataFrame([(0, "\n\n".join("p" * (k % 150) for k in range(n)))], "doc_id long, markdown string"))

    texts = [r.text for r in packed(400).orderBy("piece").collect()]
    assert "".join(texts) == "\n\n".join("p" * (k % 150) for k in range(400)) + "\n\n" and all(len(t) <= 400 for t in texts)
    assert seconds(packed(8_000)) < 2.3 * seconds(packed(4_000)) + 0.3


def brute(rows, at_least):
    kept = []
    for doc, position, text in sorted(rows):
        own = set(" ".join(text.split())[:1500].split(" ")) - {""}
        if not own or not any(d == doc and w and len(own & w) / len(own | w) >= at_least for d, _, w in kept):
            kept.append((doc, position, own))
    return sorted((d, p) for d, p, _ in kept)


@pytest.mark.parametrize("at_least", [0.9, 0.6])
def test_near_repeats_by_rounds(spark, at_least):
    rng = random.Random(4)
    rows = []
    for doc in range(3):
        vocabulary = [f"w{k}" for k in range(60)]
        chain = rng.sample(vocabulary, 20)
        for position in range(90):
            if position % 3 == 0:  # a chain of neighbours: each near the one before, not the one before that
                chain = chain[1:] + [f"c{position}"]
                text = " ".join(chain)
            else:
                text = " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 12, 25])))
            rows.append((doc, position, text))
        rows += [(doc, 100 + k, "the same text each time") for k in range(20)]
    chunks = spark.createDataFrame(rows, "doc_id long, position int, content string").withColumn("level", F.lit(1))
    expected = brute(rows, at_least)
    for fold in (0, 50, 256):
        found = C.drop_near_repeats(chunks, at_least, fold_chunks=fold)
        assert found.columns == chunks.columns and sorted((r.doc_id, r.position) for r in found.collect()) == expected
    assert C.drop_near_repeats(chunks.limit(0)).count() == 0


def test_near_repeats_of_a_document_of_100000_chunks(spark):
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(20_000)))
    rows = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("position"), F.when(F.col("id") % 10 == 9, F.lit("boiler plate of this document")).otherwise(F.concat_ws(" ", *[word(k) for k in range(12)])).alias("content"))
    assert C.drop_near_repeats(rows).count() == 90_001
