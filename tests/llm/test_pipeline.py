"""Each stage's decisions against its operator's rules, and the whole run."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rng = random.Random(8)
    words = {"en": ["the", "thing", "with", "and", "ation", "of", "on"], "de": ["der", "ung", "nicht", "keit", "ist", "das", "und"]}
    rows = []
    for k in range(200):
        lang = "en" if k % 3 else "de"
        text = " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(rng.randint(20, 80)))
        rows.append((k, "***".join(text.split()) if k % 8 == 0 else text, lang, f"s{k % 3}", len(text)))
    rows += [(200 + k, rows[k][1] + (" extra" if k % 2 else ""), rows[k][2], "s0", 0) for k in range(1, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if "***" in r[1] else 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, language string, score double, size long, taken long, row string, component_id long, key string, bucket int"


@pytest.fixture(scope="module")
def odd(spark, sf):
    """The documents with nulls in every column, empty, blank and letterless texts, a very long one, repeated rows, and columns that stages use as names."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()]
    long = " ".join(rows[1][1].split() * 2000)
    rows += [(None, rows[1][1], "en", "s0", 0), (901, None, "en", "s0", 0), (902, "", None, None, None), (903, " \n\t", "en", None, 1), (904, "12 34 --", None, "s1", 2), (905, long, "en", None, 3), (None, None, None, None, None)]
    rows += [rows[2], rows[2], rows[10]]
    return spark.createDataFrame([(*r, "x", 0.1, 1, 2, "y", 3, "z", 4) for r in rows], CLASHING)


def test_stages_on_odd_rows(spark, sf, odd, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            break
        assert docs.columns == before.columns
        given, kept = [[tuple(r) for r in x.collect()] for x in (before, docs)]
        assert set(kept) <= set(given)  # rows whole, with the columns that have clashing names
        if name == "quality":  # equal texts share their fate, so repeated rows and the null id stay with their text
            assert all(kept.count(r) in (0, given.count(r)) for r in given)
            assert {r[1] for r in kept}.isdisjoint({r[1] for r in given if r not in kept})
        if name == "language":
            assert not any(r[1] is None or not any(c.isalpha() for c in r[1]) for r in kept) and 905 in {r[0] for r in kept}
        if name == "near_copies":
            assert len(kept) == len(set(kept)) and None not in {r[0] for r in kept}  # the null id's text has a lower id too
            assert len({r[1] for r in kept}) == len(kept)
        if name == "mixing":
            assert {r[3] for r in kept} == {r[3] for r in given}  # the null source is one
    per_doc = {}
    for r in docs.collect():
        per_doc.setdefault(r.doc_id, []).append(r)
    assert set(per_doc) == {r.doc_id for r in before.collect()}
    assert len(per_doc[905]) > 10 and all(sum(p.length for p in ps) % ps[0].doc_tokens == 0 for ps in per_doc.values())


def test_stages_on_an_empty_table(spark, sf, odd):
    none = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [set() for _ in corpus_pipeline.STAGES]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        ids[k] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == before.columns
        if name == "quality":
            assert not any("***" in r.text for r in docs.collect()) and docs.count() > 180
        if name == "language":
            assert docs.count() == before.count()
        if name == "near_copies":
            assert not any(200 < i for i in ids[k]) and docs.count() == len(ids[k])  # of a pair the lower id stays
        if name == "mixing":
            assert ids[k] <= ids[k - 1] and docs.count() >= len(ids[k])
        if name == "packing":
            assert ids[k] == ids[k - 1]
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
