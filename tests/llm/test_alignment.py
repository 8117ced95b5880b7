"""Token alignment against brute force, galloping against a plain search."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docgraph.llm import alignment
from docgraph.llm.queries import tokenizer_path

PATHS = ("byte_bpe_50k.json", "piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n", "\t\x0b", "one", "One  two\n\nthree", "<|endoftext|> and </s><s> are plain", "naïve façade – 東京タワー 🙂", "a▁b", "\x00\x01", "ﬁﬁ ½ Å",
    "they're we'll it's 3.1415 x=[1,2];", "the the the the", "the the the the", "x" * 30_000, "wordy " * 3_000, "don't\r\nstop  now   ", "Ünïcödé " * 20,
]


def brute(texts):
    one, other = (alignment.tokens_of(tokenizer_path(p)) for p in PATHS)
    rows, in_docs = [], Counter()
    for text in texts:
        a = one.slow.encode(" " + text, add_special_tokens=False).ids if text else []
        b = other.model.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(one.tokens[i] for i in a) != raw or b"".join(other.tokens[i] for i in b) != raw:
            rows.append(([], []))
            continue
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        group = ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(one.tokens[a[i]])
                group[0].append(a[i])
                i += 1
            else:
                at_b += len(other.tokens[b[j]])
                group[1].append(b[j])
                j += 1
            if at_a == at_b:
                groups.append(group)
                group = ([], [])
        links = Counter()
        for x, y in groups:
            links.update({(p, q): m * n for p, m in Counter(x).items() for q, n in Counter(y).items()} if len(groups) == 1 else Counter((p, q) for p in x for q in y))
        rows.append((groups, links))
        in_docs.update(set(links))
    best = defaultdict(int)
    for (p, _), n in in_docs.items():
        best[p] = max(best[p], n)
    out = []
    for groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links = links or Counter()
        out.append(
            (
                sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
                sum(n for p, n in links.items() if in_docs[p] == best[p[0]]), sum(n * in_docs[p] for p, n in links.items()),
            )
        )
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = "abcdefghij ABC ,.'\n 0123 éßλд東🙂 ‍"
    return TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 300))) for _ in range(120)]


@pytest.mark.parametrize("broadcast_pairs", [1_000_000, 0])
def test_alignment_figures(spark, texts, broadcast_pairs, monkeypatch):
    if not broadcast_pairs:  # groups above the limit are paired by distinct ids
        monkeypatch.setattr(alignment, "LARGE_GROUP", 3)
    rows = [*enumerate(texts), (3, "one"), (3, "one"), (None, "One  two")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, a_ids int, row string").repartition(3)
    one, other = map(tokenizer_path, PATHS)
    found = alignment.alignment_figures(alignment.align_tokens(docs, one, other), 32_000, broadcast_pairs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    expected = sorted((str(k), *x) for (k, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == expected
    assert any(r[4] for r in expected) and any(not r[4] for r in expected)


def test_large_groups_are_paired_by_distinct_ids():
    rng = np.random.default_rng(0)
    a_sizes, b_sizes = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    a, b, row = rng.integers(0, 5, a_sizes.sum()), rng.integers(0, 5, b_sizes.sum()), np.sort(rng.integers(0, 4, 60))
    limit, alignment.LARGE_GROUP = alignment.LARGE_GROUP, 10
    try:
        few = alignment.distinct_links(a, b, a_sizes, b_sizes, row, 4, 100)
    finally:
        alignment.LARGE_GROUP = limit
    assert all((x == y).all() for x, y in zip(few, alignment.distinct_links(a, b, a_sizes, b_sizes, row, 4, 100), strict=True))


def test_no_documents(spark):
    one, other = map(tokenizer_path, PATHS)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_figures(alignment.align_tokens(none, one, other), 32_000).count() == 0


def test_gallop_finds_what_a_plain_search_finds():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 4_000):
        ends = np.cumsum(rng.integers(1, 9, n))
        targets = np.sort(rng.integers(1, ends[-1] + 1, 300))
        for guess in (np.zeros(300, dtype=np.int64), np.full(300, n - 1), rng.integers(0, n, 300)):
            assert (alignment.gallop(ends, targets, guess) == np.searchsorted(ends, targets)).all()
