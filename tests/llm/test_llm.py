"""Each operator against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgraph.llm import chat, components, jaccard, language, markup, mixing, packing, piece_store, pivot_search, quality_model, quality_rules, queries, shingles, token_counts, url_filter
from docgraph.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def documents(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(n // 2)]
    for k in range(n // 2):
        words = texts[k % 12].split()
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(("\n" if k % 3 else " ").join(words).upper() if k % 4 == 0 else "  ".join(words))
    texts += [None, "", " \t\n", "one", "One two", "one  TWO", "x" * 40_000, "very long " * 9_000]
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, 0) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[5], "en", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text, n):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize(("n", "p"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_components(docs, n, p):
    rows = documents()
    sets = [shingle_set(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    expected = sorted((str(r[0]), len(s), str(least.get(find(i)) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    # the second settles groups by representatives and cuts the rest into blocks
    for options in ({}, {"group_rows": 4, "task_shingles": 120, "broadcast_rows": 0, "hot_rows": 1}):
        found = jaccard.jaccard_components(docs, n, (p, 100), **options).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == expected


def test_keep_one_of_each(docs, none):
    kept = jaccard.keep_one_of_each(docs, 3, (90, 100))
    assert kept.columns == docs.columns
    rows = kept.collect()
    sets = [shingle_set(r.text, 3) for r in rows]
    assert not any(sets[i] and 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i))
    assert sum(not s for s in sets) == 3  # texts without words all stay
    assert jaccard.keep_one_of_each(none).count() == jaccard.jaccard_components(none).count() == 0


def test_sketches_bound_the_symmetric_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)]))
        apart = int(np.bitwise_count(shingles_parity(a) ^ shingles_parity(b)).sum())
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
    edges = jaccard.band_edges(5000, 90, 100)
    for n in range(1, 4000, 7):
        m = n * 100 // 90
        assert np.searchsorted(edges, m, side="right") - np.searchsorted(edges, n, side="right") <= 1


@pytest.mark.parametrize("p", [90, 80, 60])
def test_unrelated_sets_share_few_keys(p):
    rng = np.random.default_rng(p)
    edges = jaccard.band_edges(5000, p, 100)
    starts = np.array(edges)
    unique = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))

    def keys(a):
        band = int(np.searchsorted(starts, len(a), side="right")) - 1
        return np.concatenate([jaccard.part_keys(a, s, edges, p, 100) for s in (band - 1, band) if s >= 0])

    for low, high in ((10, 30), (150, 200), (900, 1000)):
        sets = [unique(n) for n in rng.integers(low, high, 3000)]
        _, counts = np.unique(np.concatenate([np.unique(keys(a)) for a in sets]), return_counts=True)
        assert (counts > 1).sum() <= 30 and counts.max() <= 40  # against 3000 sets; pairs don't grow with the square
    for _ in range(400):  # similar sets share a key, few tokens or many
        a = unique(int(rng.choice([1, 2, 3, 4, 6, 9, 30, 200])))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.9, 0.8, 1.0])], unique(int(rng.integers(0, 1 + len(a) // 3)))]))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= p * len(np.union1d(a, b)) and not np.array_equal(a, b):
            assert len(np.intersect1d(keys(a), keys(b)))


def shingles_parity(a):
    return jaccard.parity(a, 1024)


def test_components(spark):
    edges = [(1, 2), (3, 2), (10, 11), (11, 12), (12, 13), (13, 14), (5, 5), (None, 4)] + [(100, k) for k in range(101, 160)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(1, 1), (2, 1), (3, 1)} | {(k, 10) for k in range(10, 15)} | {(k, 100) for k in range(100, 160)}


def test_word_hashes_see_rows_and_ascii_case():
    hashes, rows = shingles.word_hashes(pa.array(["Ab c", None, "", "ab", "É"]))
    assert rows.tolist() == [0, 2, 2, 2, 3, 4] and hashes[0] == hashes[2]
    again, _ = shingles.word_hashes(pa.array(["x", "Ab c", "é"]).slice(1))
    assert again[:2].tolist() == hashes[:2].tolist() and again[2] != hashes[3]


def test_packing(docs, none):
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = piece_store.piece_store(path).tokenizer
    found = packing.pack_documents(docs, path, batch_items=16).collect()
    ids = {}
    for r in documents():
        own = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        ids.setdefault(r[0], []).append(own)
    by_doc, by_window = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for k, parts in by_doc.items():
        own = ids[k][0]
        for r in parts:
            piece = own[r.start : r.start + r.length]
            assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        assert sum(r.length for r in parts) == sum(map(len, ids[k]))
    for parts in by_window.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist() and sum(r.length for r in parts) <= 4096
    assert packing.pack_documents(none, path).count() == 0


def test_piece_ids_are_the_tokenizers(docs):
    texts = ["it's <|endoftext|> We'LL É naïve x²y ½ 12ab! Straße İst ΣΑΣ b\x1cd \x85 é ﬁ ª µm don't!!?  \n\t\r\x0b <|startoftext|>abc <| A|>B 日本語 don’t ẞ À'S 'tis <|ENDOFTEXT|>", "", " ", "Dot. comma, x., .,"]
    texts += ["'", "'s", "''s", "'ss'ss", "x'", "re'", "'ll'll've", "l'", "'r", "e", "'v", "e ×÷ a×b Ã ", None, "'l", "l'lx'd1'd", "e\u0301 <", "|x"]
    texts += [r[1] for r in documents()]
    for name, splits in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):  # the second is encoded whole
        store = piece_store.piece_store(tokenizer_path(name))
        assert store.splits == splits
        for slice_of in (slice(None), slice(3, 20)):
            for kept in (40_000, 30):
                ids, rows = store.encode(pa.array(texts)[slice_of])
                for k, text in enumerate(texts[slice_of]):
                    assert ids[rows[k] : rows[k + 1]].tolist() == store.tokenizer.encode(text or "", add_special_tokens=False).ids
                store.keep_first(kept)
        store.clear()


def test_differencing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 40, 300):
        sizes = rng.integers(1, 4096, n)
        parts = packing.windows(sizes, 4096)
        assert sorted(k for p in parts for k in p) == list(range(n)) and all(sizes[p].sum() <= 4096 for p in parts)
    two = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert abs(sum([8, 7, 6, 5, 4][k] for k in two[0]) - sum([8, 7, 6, 5, 4][k] for k in two[1])) == 2  # the textbook example


def test_mixing(docs, none):
    found = mixing.mix_sources(docs.withColumn("size", F.lit("clash")), bucket_rows=3).collect()
    size = lambda t: len(WORD.findall(t or ""))
    rows = documents()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(r[0]), size(r[1])) for r in rows)
    total, by = sum(r.size for r in found), {}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    names = sorted([s for s in by if s], key=lambda s: s) + ([None] if None in by else [])
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}
    caps = {s: 2 * by[s][0].source_size for s in names}
    capped = set()
    while True:
        level = (1.5 * total - sum(caps[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        more = {s for s in names if s not in capped and caps[s] <= weight[s] * level}
        if not more:
            break
        capped |= more
    for s in names:
        assert by[s][0].target == pytest.approx(caps[s] if s in capped else weight[s] * level)
        assert abs(sum(r.taken for r in by[s]) - by[s][0].target) < 1
    again = mixing.mix_sources(docs.repartition(7), bucket_rows=50).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mixing.mix_sources(none).count() == 0 == mixing.mix_sources(none, one_task_sources=-1).count()
    rows = lambda df: sorted((str(r.doc_id), str(r.source), r.size, r.target, r.taken) for r in df.collect())
    assert rows(mixing.mix_sources(docs, one_task_sources=0)) == rows(mixing.mix_sources(docs))
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_targets_of_many_sources(spark):
    sizes = spark.range(3_000).select(F.when(F.col("id") > 0, F.concat(F.lit("host"), F.col("id"))).alias("source"), (F.col("id") * 7919 % 1_000).alias("source_size"))
    one, ranges = (sorted(map(str, mixing.source_targets(sizes.repartition(5), one_task=x).collect())) for x in (True, False))
    assert one == ranges and len(one) == 3_000


def test_quality_model(spark, docs, none):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and"]
    good = [(k, " ".join(rng.choices(words, k=rng.randint(3, 60))) + ".") for k in range(300)]
    bad = [(1000 + k, " ".join(w + "***" for w in rng.choices(words, k=30)) if k % 2 else " | ".join(rng.choices(words, k=30))) for k in range(150)]
    table = spark.createDataFrame([(*r, "clash") for r in good + bad], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k < 1000), 0) for k, _ in good + bad] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train_quality_model(table, labels, most_rows=200)
    scored = quality_model.score_quality(table, model)
    assert scored.columns == ["doc_id", "text", "score", "_score"]
    rows = scored.where(quality_model.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 100 and np.mean([(r._score >= 0.5) == (r.doc_id < 1000) for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in quality_model.score_quality(docs, model).collect())
    assert quality_model.score_quality(none, model).count() == 0 and quality_model.keep_good(docs, model).columns == docs.columns
    assert {r["h"] for r in spark.range(30).select(quality_model.held_out(F.col("id")).alias("h"), "id").collect() if (zlib.crc32(str(r["id"]).encode()) % 3 == 1) != r["h"]} == set()
    flat = quality_model.train_quality_model(table, labels.where("quality = 1"))
    assert quality_model.keep_good(table, flat).count() == 450


def test_language_of_pages(spark, tmp_path):
    html = ('<html\n dir="ltr" LANG=\'de-AT\'><head><title>the</title></head><body><!-- the --><script>var the = "<p>";</script><style>p{}</style>'
            "<p class=x>nicht keit&#32;k&ouml;nnen &#x26; &amp;amp; &bogus; AT&T</p></body></html>")  # fmt: skip
    row = spark.createDataFrame([(html,), (None,)], "h string").select(markup.visible_text(F.col("h")).alias("t"), markup.declared_language(F.col("h")).alias("l")).collect()
    assert row[0].t.split() == ["nicht", "keit", "können", "&", "&amp;", "&bogus;", "AT&T"] and row[0].l == "de-AT" and row[1].t is None and row[1].l is None
    hosts = spark.createDataFrame([("a.example.FR",), ("u@b.de:80",), ("10.0.0.1",), ("",)], "h string").select(markup.host_suffix(F.col("h")).alias("s"))
    assert [r.s for r in hosts.collect()] == ["fr", "de", None, None]

    rng = random.Random(4)
    words = {"en": ["the", "thing", "with", "and", "ation"], "de": ["der", "ung", "nicht", "keit", "ist"]}
    text = lambda lang: " ".join(rng.choices(words[lang], k=12))
    spark.createDataFrame([(k, text(lang), lang, "s") for k in range(120) for lang in [list(words)[k % 2]]], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    page = lambda lang, text: f'<html lang="{lang}"><head><title>x</title></head><body><p>{text}</p></body></html>'
    pages = [(k, f"http://h{k % 4}.example.com/", page("en" if k % 2 else "de", text("en" if k % 2 else "de"))) for k in range(40)]
    pages += [(100, "http://new.example.de/", page("", "ung the")), (101, "http://new.example.en/", page("", "ung the")), (102, "http://new.example.com/", page("de", "ung the")), (103, "http://new.example.com/", page("en", "ung the")), (104, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r for r in queries.QUERIES["op8_language_pages"](spark, str(tmp_path)).collect()}
    assert len(out) == len(pages) and all(out[k].kept and out[k].lang == ("en" if k % 2 else "de") for k in range(40))
    assert not out[104].kept
    weight = lambda k, lang: out[k].posterior if out[k].lang == lang else 1 - out[k].posterior
    assert weight(100, "de") > weight(101, "de") and weight(102, "de") > weight(103, "de")  # the suffix and the markup count


def test_language_rejects_foreign_and_letterless(spark):
    rng = random.Random(3)
    words = {"en": ["the", "thing", "with", "and", "ation"], "de": ["der", "ung", "nicht", "keit", "ist"]}
    clean = [(k, " ".join(rng.choices(words[lang], k=12)), lang, f"host{k % 2}") for k in range(200) for lang in [list(words)[k % 2]]]
    foreign = ["Il gatto dorme sul tavolo della cucina mentre fuori piove", "Быстрая лиса прыгает через ленивую собаку", "我们今天去公园散步然后回家吃饭", "Pies śpi na stole w kuchni a na zewnątrz pada deszcz", "zxqv kjwq pfgh wqzx vbnm plok"]
    bare = [None, "", "12 34 -- 56", "*** !!! ***"]
    rows = clean + [(1000 + k, t, "en", "host0") for k, t in enumerate(foreign)] + [(2000 + k, t, "en", "host0") for k, t in enumerate(bare)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.train_language_model(table.where("doc_id < 100"))
    out = {r.doc_id: r.language for r in language.identify_language(table, model, F.col("text"), F.col("lang"), host=F.col("source")).collect()}
    assert all(out[k].kept and out[k].lang == lang for k, _, lang, _ in clean)
    assert all(not out[1000 + k].kept and out[1000 + k].lang == language.OTHER for k in range(len(foreign)))
    assert not any(out[2000 + k].kept for k in range(len(bare)))


def test_language(spark, none):
    rng = random.Random(2)
    words = {"en": ["the", "thing", "with", "and", "ation"], "de": ["der", "ung", "nicht", "keit", "ist"], "fr": ["les", "eaux", "étre", "que", "ç"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=12)), lang, f"{lang}-host" if k % 2 else "mixed") for k in range(240) for lang in [list(words)[k % 3]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = language.train_language_model(table.where("doc_id < 120"))
    found = language.identify_language(table.withColumn("language", F.lit("x")), model, F.col("text"), host=F.col("host"))
    assert found.columns[-2:] == ["language", "_language"]
    assert all(r["_language"]["lang"] == r.lang and r["_language"]["kept"] for r in found.collect())
    # without text, what is declared decides; without that, the suffix; then the host's share
    bare = spark.createDataFrame([(1, None, "DE-at", None, None), (2, "", None, "fr", None), (3, "123", "xx", None, "en-host"), (4, None, None, None, None)], "id long, text string, said string, suffix string, host string")
    both = bare.unionByName(table.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("said"), F.lit(None).cast("string").alias("suffix"), "host"))
    out = {r.id: r.language for r in language.identify_language(both, model, F.col("text"), F.col("said"), F.col("suffix"), F.col("host")).where("text IS NULL OR length(text) < 4").collect()}
    assert [out[k].lang for k in (1, 2, 3)] == ["de", "fr", "en"] and out[4].lang in words
    assert language.identify_language(none, model, F.col("text")).count() == 0
    assert language.train_language_model(none).languages == ["und"]


def test_language_posterior_by_hand(spark):
    """The posterior of every row against the same sum worked out row by row."""
    rng = random.Random(9)
    words = {"en": ["the", "thing", "with", "and"], "de": ["der", "ung", "nicht", "keit"], "fr": ["les", "eaux", "que"]}
    pick = lambda lang, k: " ".join(rng.choices(words[lang], k=k))
    rows = [(k, pick(lang, rng.randint(1, 4)) + (" " + pick("de", 1) if k % 5 == 0 else ""), rng.choice([lang, "EN-us", "de", None, "xx"]), rng.choice(["fr", "com", None]), f"h{k % 4}" if k % 7 else None) for k in range(150) for lang in [rng.choice(list(words))]]
    table = spark.createDataFrame(rows, "id long, text string, said string, suffix string, host string")
    model = language.train_language_model(table.withColumn("lang", F.substring("said", 1, 2)).where("lang IS NOT NULL AND lang != 'xx'"))
    assert model.languages == ["de", "en", "fr"]
    n, names = 3, [*model.languages, language.OTHER]
    means, counts = model.mean_log_likelihood(pa.array([r[1] for r in rows]))
    most = language.LanguageModel(["x"], model.log_p.max(axis=1, keepdims=True)).mean_log_likelihood(pa.array([r[1] for r in rows]))[0][:, 0]
    floor = model.foreign(0.6)
    top = [int(m.argmax()) if f <= 0 else n for m, f in zip(means, floor[means.argmax(axis=1)] - most, strict=True)]
    out = {r.id: r.language for r in language.identify_language(table, model, F.col("text"), F.col("said"), F.col("suffix"), F.col("host")).collect()}
    votes = [(r[3], r[4], t) for r, t in zip(rows, top, strict=True) if t < n]
    share_all = [(sum(v[2] == k for v in votes) + 1 / n) / (len(votes) + 1) for k in range(n)]
    for r, mean, count, t in zip(rows, means, counts, top, strict=True):
        others = list(votes)
        if t < n:
            others.remove((r[3], r[4], t))
        of_suffix, of_host = [v[2] for v in others if v[0] == r[3]], [v[2] for v in others if v[:2] == (r[3], r[4])]
        evidence = []
        for k in range(n + 1):
            e = min(count, 60.0) * ((mean[k] - mean.max()) if k < n else (floor[mean.argmax()] - most[r[0]]))
            e += np.log((of_host.count(k) + 20 * (of_suffix.count(k) + 20 * share_all[k]) / (len(of_suffix) + 20)) / (len(of_host) + 20)) if k < n else np.log(0.01)
            said = {"en-us": "en"}.get((r[2] or "").lower(), r[2])
            for value, trust in ((said, 0.9), (r[3], 0.8)):
                if value in model.languages:
                    e += np.log(trust if value == names[k] else (1 - trust) / 2)
            evidence.append(e)
        weights = np.exp(np.array(evidence) - max(evidence))
        assert out[r[0]].lang == names[int(np.argmax(evidence))] and out[r[0]].posterior == pytest.approx(1 / weights.sum(), rel=1e-9)


def test_bradley_terry_fit_and_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    labels = (x @ [1.5, -1.0, 0.0] + rng.normal(size=120) > 0.3).astype(int)
    model = quality_model.fit_bradley_terry(x, labels, pairs=2000, ridge=0.01)
    z = (x - model.mean) / model.scale
    drawn = np.random.default_rng(0)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    d = z[drawn.choice(good, 2000)] - z[drawn.choice(bad, 2000)]
    w = np.zeros(3)
    for _ in range(4000):  # plain descent of the logistic loss on differences
        w -= 0.5 * (0.01 * w - d.T @ (1 / (1 + np.exp(d @ w))) / 2000)
    assert np.allclose(w, model.weights, atol=1e-6)
    balance = lambda t: ((z @ w >= t) & (labels == 1)).sum() / len(good) + ((z @ w < t) & (labels == 0)).sum() / len(bad)
    assert balance(model.threshold) == pytest.approx(max(balance(t) for t in z @ w), abs=1e-12)
    assert ((model.score(x) >= 0.5) == (z @ model.weights >= model.threshold)).all()


def test_url_filter(spark):
    urls = ["http://a.com/en/1", "https://X.Example.COM/en/77?q", "//no", None, "ftp://example.com", "http://notcom/en/", "http://com/en/#f", "a://b.net/de/80", "a://example.net/de/8", "http://h?x=://y", "x://s.org/es"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, host string")
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block")]

    def judge(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    for bits, rows in ((16, 200_000), (1, 0)):  # a filter that passes nearly all, and shuffled joins, give the same
        found = url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), bits_per_key=bits, broadcast_rows=rows).collect()
        assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found) == sorted([(k, *judge(u)) for k, u in enumerate(urls)] + [(0, *judge(urls[0]))], key=lambda x: (x[0], x[1]))
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.filter_urls(pages, empty).where("rule IS NOT NULL OR verdict != 'allow'").count() == 0
    assert url_filter.filter_urls(pages.limit(0), empty).count() == 0


def test_token_counts(docs, none):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    lengths = sorted(len(token_counts.rank_encoding(path).encode_ordinary(r[1])) if r[1] else 0 for r in documents())
    histogram = token_counts.length_histogram(token_counts.token_lengths(docs, path), band=7).cache()
    rows = {r.n_tokens: r for r in histogram.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert (r.n_docs, r.total_docs, r.total_tokens) == (lengths.count(n), len(lengths), sum(lengths))
        assert r.docs_longer == sum(x > n for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > n) and r.truncated_tokens == sum(min(x, n) for x in lengths)
    limits = [0, 1, 17, 50, 10**6]
    assert {r.context_limit: r.truncated_tokens for r in token_counts.at_limits(histogram, limits).collect()} == {x: sum(min(n, x) for n in lengths) for x in limits}
    half = token_counts.length_at_quantile(histogram, [0.5]).first().n_tokens
    assert sum(n <= half for n in lengths) * 2 >= len(lengths) > sum(n < half for n in lengths) * 2
    assert token_counts.length_histogram(token_counts.token_lengths(none, path)).count() == 0


def test_quality_rules(spark, docs, none):
    def repeats(w):
        seen, covered = {}, set()
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                covered |= {i + k for i in places for k in range(5)}
        return len(covered)

    rng = random.Random(6)
    rows = documents() + [(900, "a b c d e a b c d e a b c d e z\nq\n q\nq\n\n#|", "en", "s", 0), (901, "a a a a a a", "en", "s", 0)]
    for k in range(40):  # few and many different repeated windows, near and far, at the ends and between
        own = [rng.choice("abcdefgh") if k % 2 else f"u{rng.randrange(900)}" for _ in range(rng.randint(3, 400))]
        rows.append((910 + k, " ".join(own + own[: rng.randint(0, len(own))] + [f"v{i}" for i in range(k % 7)] + own[-rng.randint(1, 9) :]), "en", "s", 0))
    table = spark.createDataFrame(rows, DOCS)
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.base_metrics(table).collect())
    expected = []
    for r in rows:
        text = r[1] or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        expected.append((str(r[0]), len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats(w), len(w) < 10 or 100 * repeats(w) > 20 * len(w)))
    assert found == sorted(expected)
    rules = [quality_rules.Rule("short", F.length("text") < 20), quality_rules.Rule("null", F.col("text").isNull()), quality_rules.Rule("upper", F.col("text").rlike("^[^a-z]*$"))]
    ordered = quality_rules.order_rules(docs, rules)
    assert {r.name for r in ordered} == {r.name for r in rules}
    verdict = lambda rs: {str(r.doc_id): r._lang is None for r in quality_rules.quality_cascade(docs, rs, "lang").collect()}
    assert verdict(rules) == verdict(ordered) == verdict(rules[::-1])
    cheap, dear = F.length("text") % 2 == 0, F.length(F.regexp_replace(F.repeat("text", F.lit(200)), r"\P{Lu}+", "")) >= 0  # the dear one rejects more, but not by as much as it costs more
    assert [r.name for r in quality_rules.order_rules(docs.where("length(text) > 5"), [quality_rules.Rule("a_dear", dear), quality_rules.Rule("b_cheap", cheap)], repeats=4)] == ["b_cheap", "a_dear"]
    assert quality_rules.order_rules(none, rules) == rules and quality_rules.base_metrics(none).count() == 0


def test_pivot_search(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 16))
    v = [[float(x) for x in c / np.linalg.norm(c)] for c in (centres[rng.integers(5)] + rng.normal(size=16) * 0.3 for _ in range(400))]
    rows = [(k, x) for k, x in enumerate(v)] + [(400, v[7]), (401, None), (402, [None, *v[0][1:]]), (403, [float("nan"), *v[0][1:]]), (404, [1.0]), (7, v[7]), (20, v[9]), (20, v[9])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, near int").repartition(3)
    usable = table.where(pivot_search.usable_vector(F.col("embedding"))).withColumn("embedding", pivot_search.quantized(F.col("embedding")))
    ints = [(k, tuple(np.floor(1024 * np.array(x)).astype(int).tolist())) for k, x in rows if x and len(x) == 16 and None not in x and np.isfinite(x).all()]
    expected = []
    for q, x in {(k, x) for k, x in ints if k % 20 == 0 or k == 7}:  # id 20 has two vectors and so is two queries
        best = sorted((-int(np.dot(x, y)), k) for k, y in ints if k != q)[:6]
        expected += [(q, r, k, -s) for r, (s, k) in enumerate(best, 1)]
    for block in (1024, 5):
        found = pivot_search.exact_top_k(usable, usable.where("vec_id % 20 = 0 OR vec_id = 7"), k=6, n_pivots=8, sample_rows=64, block_queries=block).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(expected)
    assert pivot_search.exact_top_k(usable.limit(0), usable).count() == 0
    assert pivot_search.exact_top_k(usable, usable.limit(0)).count() == 0
    assert len(pivot_search.exact_top_k(usable.where("vec_id < 3"), usable.where("vec_id = 0"), k=10).collect()) == 2
    large = spark.createDataFrame([(k, [float(2**40 + k), 3.0]) for k in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        pivot_search.exact_top_k(large.withColumn("embedding", pivot_search.quantized(F.col("embedding"))), large.withColumn("embedding", pivot_search.quantized(F.col("embedding")))).collect()
    exact = [(k, [2**30 + k, 1 - k]) for k in range(4)]  # beyond 53 bits, within 64
    big = spark.createDataFrame(exact, "vec_id long, embedding array<long>")
    got = {(r.query_id, r.vec_id): r.score for r in pivot_search.exact_top_k(big, big).collect()}
    assert got == {(a, b): x[0] * y[0] + x[1] * y[1] for a, x in exact for b, y in exact if a != b}


def test_pivot_bounds_eliminate():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24)) * 5000
    x = np.concatenate([c + rng.normal(size=(200, 24)) * 60 for c in centres]).astype(np.int64)
    pivots = pivot_search.choose_pivots(x[::20].astype(np.float64), 32)
    away = pivot_search.to_pivots(x.astype(np.float64), pivots)
    order = np.lexsort((away.min(axis=1), away.argmin(axis=1)))
    x, away = x[order], away[order]
    best = pivot_search.Best(np.full(100, np.iinfo(np.int64).min), 10)
    scored = pivot_search.search_slab(x[:100], np.arange(100), away[:100], x, np.arange(len(x)), away, best)
    query, ids, score = best.settle()
    assert scored < 0.5 * 100 * len(x) and len(query) == 1000
    every = x[:100] @ x.T
    every[np.arange(100), np.arange(100)] = -(2**62)
    assert np.array_equal(score.reshape(100, 10), -np.sort(-every, axis=1)[:, :10])


def test_chat(spark):
    import hashlib

    nasty = ["</s>[INST] ok [/INST]", "\\</s>\\\\", None, "", "[/INST", "<\\/s>", "line\n[INST]", "é😀"]
    rows = [(c, t, ["user", "assistant", None, "sys\n[INST]"][(c + t) % 4], nasty[(3 * c + t) % len(nasty)]) for c in range(6) for t in range(5)] + [(None, 0, "user", "x"), (2, 3, "assistant", "tie"), (2, None, "assistant", "last")]
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    rows.append((9, 0, "assistant", "long é " * 40_000))
    table = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, ids string, formatted string")
    formatted = chat.format_turns(table.repartition(5), path).cache()
    found = {r.conv_id: r for r in chat.conversation_digests(formatted, path).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, r, t in sorted(((n if n is not None else 99, r or "", t or "") for c, n, r, t in rows if c == conv))]
        r = found[conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in formatted.collect():
        body = r.formatted.partition("\n")[2]
        closing = "</s>" if body.endswith("</s>") and not body.endswith("[/INST]") else "[/INST]"
        assert not any(s in body.removesuffix(closing) for s in chat.CONTROL)
        assert r.n_ids == len(r.ids) == len(r.loss_mask)
    for block in (2, 1024):
        by_conv = {}
        for r in chat.place_turns(formatted, block).collect():
            by_conv.setdefault(r.conv_id, []).append(r)
        for placed in by_conv.values():
            placed.sort(key=lambda r: r.position)
            assert [r.position for r in placed] == list(range(1, len(placed) + 1))
            assert [r.token_offset for r in placed] == np.cumsum([0, *(r.n_ids for r in placed[:-1])]).tolist()
            keys = [(r.turn is None, r.turn or 0, r.formatted) for r in placed]
            assert keys == sorted(keys)
    for text in nasty:
        assert chat.unescape(chat.escape(text or "")) == (text or "")
    assert chat.conversation_digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), path), path).count() == 0
