"""Source divergence against brute force, pointer sorting against plain sorting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docgraph.llm import source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least_docs, most_terms):
    rows = [(t, lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        docs = Counter(w for t, _, _ in own for w in set(terms(t)))
        kept = {w for w, n in docs.items() if n >= least_docs}
        counts = {s: Counter() for _, _, s in own}
        for t, _, s in own:
            counts[s].update(w for w in terms(t) if w in kept)
        everything = sum(counts.values(), Counter())

        def share(count, w, kept=kept):
            return 1 + (10**9 * (count[w] + 5)) // (sum(count.values()) + 5 * len(kept))

        for s, count in counts.items():
            pairs = [(sum(abs(share(count, w) - share(other, w)) for w in kept), o) for o, other in counts.items() if o != s]
            apart = [(share(count, w) - share(everything, w), w) for w in kept if count[w] and share(count, w) > share(everything, w)]
            for part, found, most in (("pair", pairs, None), ("term", apart, most_terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def documents():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(10)] + [w * r for w in ("abc", "éß", "Longer", "longerWord", "東京", "x") for r in (1, 2, 3, 7)]
    rows = [("  ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "S1", "é", "z", None])) for _ in range(150)]
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("12 34", "en", "digits"), ("lonely words", "fr", "a"), ("other words", "fr", "b"), ("x" * 30_000, "en", "s1"), ("abc " * 9_000, "en", "s1")]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("options", [{}, {"block_sources": 2, "tile_terms": 3}])
def test_source_divergence(spark, options, monkeypatch):
    rows = documents()
    whole = source_audit.pair_distances
    monkeypatch.setattr(source_audit, "pair_distances", lambda groups, cells: whole(groups, cells, **options))
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "text string, lang string, source string, n long, term string").repartition(3)
    found = source_audit.source_divergence(docs, least_docs=8, most_terms=5)
    assert found.columns == COLUMNS
    expected = brute(rows, 8, 5)
    assert sorted(map(tuple, found.collect())) == expected
    assert {r[0] for r in expected} == {"en", "de", "fr", ""} and all(r[4] == 0 for r in expected if r[0] == "fr")


def test_no_documents(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert source_audit.source_divergence(none).collect() == []


def test_shards_of_one_text_or_many_give_the_same(spark, monkeypatch):
    rows = documents()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    whole = {(r.lang, r.source, r.term): (r.n, r.n_docs) for r in source_audit.term_counts(docs).collect()}
    expected, docs_of = Counter(), Counter()
    for t, lang, source in rows:
        expected.update((lang or "", source or "", w) for w in terms(t))
        docs_of.update({(lang or "", source or "", w) for w in terms(t)})
    assert whole == {k: (n, docs_of[k]) for k, n in expected.items()}


def test_pointers_are_sorted_by_whole_words():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abÿ", k=rng.randint(1, 40))) for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["a" * 8, "a" * 9, "a" * 16, "a" * 17, "", "a" * 8]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    start, length = source_audit.word_pointers(raw, bounds)
    order, run = source_audit.sort_pointers(raw, start, length)
    found = [raw[s : s + n].tobytes() for s, n in zip(start[order], length[order], strict=True)]
    assert found == sorted(w.encode() for t in texts for w in t.split())
    assert [a == b for a, b in zip(found, found[1:], strict=False)] == (np.diff(run) == 0).tolist()
    assert source_audit.shard_counts(pa.array([""]), np.zeros(1, dtype=np.int64))[0].to_pylist() == []
