"""What the fitted operators count and score, row by row against plain loops."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgraph.llm import language, quality_model, shingles
from docgraph.llm.markup import declared_language, host_suffix, visible_text
from docgraph.llm.url_filter import url_host

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n", "one", "The the THE cat! #1 | a.b", "été ÉTÉ naïve\n\nx y x y", "z" * 5000, "long text (with) [signs] " * 400, "A,B;C:D?E \"q\" 'r' - _ / \\", "12 34\t56"]


def lower(raw):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def features(text):
    raw = (text or "").encode()
    words = WORD.findall(lower(raw))
    classes = [0] * quality_model._N_CLASSES
    for b in raw:
        group = next((k for k, chars in enumerate(quality_model._CLASSES, 1) if b in chars), None)
        classes[len(quality_model._CLASSES) + 2 if b >= 128 else len(quality_model._CLASSES) + 1 if b in (9, 11, 12, 13, 32) else group or 0] += 1
    n, distinct = len(words), len(set(words))
    again = [sum(words[k] == words[k - step] for k in range(step, n)) for step in (1, 2)]
    rest = [(distinct + 8) / (n + 8), len(raw) / (n + 1) / 10, math.log1p(n) / 10, math.log1p(n) * (distinct + 8) / (n + 8) / 10]
    buckets = [0] * quality_model.WORD_BUCKETS
    for w in words:
        buckets[int(shingles.word_hashes(pa.array([w.decode()]))[0][0]) >> 57] += 1
    return [*(math.sqrt(c / (len(raw) + 30)) for c in classes), *(math.sqrt(a / (n + 8)) for a in again), *(min(r, 4) for r in rest), *(math.sqrt(b / (n + 8)) for b in buckets)]


def test_features_of_every_text():
    found = quality_model.text_features(pa.array(TEXTS))
    for row, text in zip(found, TEXTS, strict=True):
        assert row == pytest.approx(features(text), abs=1e-12)


def test_scores_over_a_table(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "of", "the"], k=30)) for _ in range(60)]
    bad = ["".join(rng.choices("#$%!| ab", k=120)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate([*good, *bad, *TEXTS, good[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id long, quality int")
    model = quality_model.train_quality_model(docs, labels)
    out = {r.doc_id: r.score for r in quality_model.score_quality(docs, model).collect()}
    for k, t in rows:
        z = sum(w * (x - m) / s for w, x, m, s in zip(model.weights, features(t), model.mean, model.scale, strict=True))
        assert out[k] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.slope * (z - model.threshold))))), abs=1e-6)
    held = {r.doc_id for r in docs.where(quality_model.held_out(F.col("doc_id"))).collect()}
    assert all((out[k] >= 0.5) == (k < 60) for k in range(120) if k in held)


def trigrams(text):
    raw = lower((text or "").encode())
    letters = [97 <= b <= 122 or b >= 128 for b in raw]
    c = [b if is_letter else 32 for b, is_letter in zip(raw, letters, strict=True)]
    return [(((c[i] << 16 | c[i + 1] << 8 | c[i + 2]) * 2654435761) % 2**32) >> 16 for i in range(len(raw) - 2) if letters[i + 1]]


def test_training_counts(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(["the", "ünd", "Und", "x1y", "là"], k=rng.randint(0, 12))), rng.choice(["en", "EN-us", "de", "fr", None])) for _ in range(90)] + [(None, "en"), ("", "de"), ("ab", "en"), ("same", "en"), ("same", "en")]
    model = language.train_language_model(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert model.languages == ["de", "en", "fr"]
    for k, name in enumerate(model.languages):
        counts = np.zeros(language.BUCKETS)
        for text, lang in rows:
            if text is not None and lang is not None and lang.lower()[:2] == name:
                for b in trigrams(text):
                    counts[b] += 1
        assert np.allclose(model.log_p[:, k], np.log((counts + 0.5) / (counts + 0.5).sum()))


def test_markup_of_odd_pages(spark):
    pages = [None, "", "<html", '<html lang="de"', "<html lang='fr-FR'><p>a<script>no</script>b</p>", '<HTML LANG=en><body>x' + "y" * 100_000, "<style>" + "z" * 50_000, "no markup & none"]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "id int, html string")
    out = {r.id: (r.text, r.lang) for r in rows.select("id", visible_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("lang")).collect()}
    assert len(out) == len(pages) and "no" not in (out[4][0] or "").split() and (out[5][0] or "").endswith("y" * 100) and out[7][0].startswith("no markup")
    assert (out[4][1] or "").lower().startswith("fr") and (out[5][1] or "").lower() == "en" and not out[0][1] and not out[1][1]
    hosts = spark.createDataFrame([(None,), ("x",), ("http://a.b.DE/x",), ("http://" + "h" * 20_000 + ".com",)], "url string").select(host_suffix(url_host(F.col("url"))).alias("s")).collect()
    assert [(h.s or "") for h in hosts] == ["", "", "de", "com"]
