"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import functools
import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import BLANKS, free_name, materialize, words

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is evaluated once however often ``f`` takes it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit(f"[{SYMBOLS}]")).cast("long")


def line_measures(text: Column) -> Column:
    """struct(n_lines, n_dup_lines): lines that have a word, and those of them that equal an earlier one."""
    worded = F.filter(F.split(_text(text), "\n", -1), lambda line: line.rlike(f"[^{BLANKS}]"))
    return _bind(worded, lambda lines: F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")))


def n_repeat_words(words_of: Column, width: int = 5, few: int = 32) -> Column:
    """Words in ``width``-word windows found twice or more in the list of words, the first finding included.

    Words are hashed once, and windows are hashes of word hashes (64 bits). A text without equal windows ends after a
    distinct count. Else hashes are sorted, and those equal to their neighbour are the repeated ones. The places of up to ``few`` different
    ones are looked for one by one; beyond, hashes are sorted with their places. The places' windows are added up where they don't overlap.
    """

    def repeated(h: Column) -> Column:
        n = F.size(h)
        by_hash = lambda: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(s, F.greatest(k - 1, F.lit(0)))["h"])))
        some = lambda found: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(found, F.get(h, i)))
        many = lambda: F.sort_array(F.transform(_bind(by_hash(), same), lambda x: x["i"]))
        found = lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1)))
        places = _bind(_bind(F.sort_array(h), found), lambda x: F.when(F.size(x) <= few, some(x)).otherwise(many()))
        return F.when(n == F.size(F.array_distinct(h)), F.lit(0)).otherwise(_bind(places, covered))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda x, k: F.least(F.coalesce(F.get(places, k + 1) - x, F.lit(width)), F.lit(width))), F.lit(0), lambda a, b: a + b)

    def windows(h: Column) -> Column:
        n = F.size(h) - (width - 1)
        made = F.transform(F.slice(h, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]))
        return F.when(n < 2, F.lit(0)).otherwise(_bind(made, repeated))

    return _bind(F.transform(words_of, lambda x: F.xxhash64(x)), windows).cast("long")


def word_measures(text: Column) -> Column:
    """struct(n_words, word_chars, n_repeat_words); a text is split into its words once. word_chars counts code points."""
    return _bind(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), n_repeat_words(w).alias("n_repeat_words")),
    )


@dataclass(frozen=True)
class Rule:
    """A named test of a row that is true for what must go."""

    name: str
    rejects: Column


def default_rules(text: Column) -> list[Rule]:
    """Rules beside the base ones, over a text and what ``base_metrics`` found: symbols, shouting, characters per word, repeated lines."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    capitals = F.length(F.regexp_replace(_text(text), r"\P{Lu}+", ""))
    letters = F.length(F.regexp_replace(_text(text), r"\P{L}+", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 100 > n * 30),
        Rule("exclamations", (F.length(_text(text)) - F.length(F.replace(_text(text), F.lit("!"), F.lit("")))) * 100 > n * 40),
        Rule("capitals", (capitals > 20) & _bind(letters, lambda x: (x >= 40) & (capitals * 100 > x * 50))),  # half of 40 letters at least, so the cheaper count comes first
        Rule("word_length", (F.col("word_chars") > n * 20) | (F.col("word_chars") * 2 < n * 3)),
        Rule("dup_lines", F.col("n_dup_lines") * 100 > F.greatest(F.col("n_lines"), F.lit(1)) * 50),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], prepare: Callable[[DataFrame], DataFrame] = lambda docs: docs, sample_rows: int = 2_000, repeats: int = 2, most_times: int = 512) -> list[Rule]:
    """Rules by falling rejection per cost, measured on a sample of about ``sample_rows`` rows of ``docs``.

    ``prepare`` adds the columns that rules need. Cost: the time that the rule takes for the sample, as a pass that evaluates it alone takes longer
    than one that only counts rows, best of ``repeats``, rounded to a power of two. A rule too cheap to be told from a pass's own variation is evaluated eight times as
    often, again and again up to ``most_times``. Equal worths are in order of name. So the order seldom differs between
    runs, though it may; it changes what is evaluated, never which rows are rejected. Selectivity: the share that the rule rejects; a null test rejects
    nothing. The bound doesn't grow with the corpus. An empty table leaves the rules as they are; repeated rows and very long texts are rows like others.
    """
    there = docs.count()
    if not there:
        return list(rules)
    sample = materialize(prepare(materialize(docs.sample(min(1.0, sample_rows / there), seed=3), "rule-sample").coalesce(1)), "rule-measures").coalesce(1)

    time_name = free_name(sample, "time")

    def measured(test: Column, times: int) -> tuple[float, float]:
        rows = sample.withColumn(time_name, F.explode(F.sequence(F.lit(1), F.lit(times))))
        best, share = float("inf"), 0.0
        for _ in range(repeats):
            began = time.perf_counter()
            share = rows.agg(F.avg(F.coalesce(test, F.lit(False)).cast("int"))).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    floor = functools.cache(lambda times: measured(F.col(time_name) < 0, times)[0])

    def cost_and_share(test: Column) -> tuple[float, float]:
        times = 1
        while True:
            took, share = measured(test, times)
            if took - floor(times) > 0.05 or times >= most_times:
                return max(took - floor(times), 1e-3) / times, share
            times *= 8

    worth = {}
    for rule in rules:
        cost, share = cost_and_share(rule.rejects)
        worth[rule.name] = share / 2.0 ** round(math.log2(cost))
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def quality_cascade(docs: DataFrame, rules: list[Rule], name: str = "rejected_by") -> DataFrame:
    """``docs`` with the name of the first rule that rejects each row, null for what stays.

    A CASE expression: a rule is evaluated only for rows that all before it let pass. A null test rejects nothing.
    A column of that name in ``docs`` stays, and the new one gets underscores before its name.
    """
    verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return docs.withColumn(free_name(docs, name), verdict)


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed of every whole text.

    Null, empty and blank texts have no words, symbols or lines, and fail; very long ones are measured whole, in their row. Repeated rows have a row each,
    null ids too; an empty table gives no rows. Other columns of ``docs``, whatever their names, are not read.
    """
    text = F.col("text")
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = read.select("id", "text", word_measures(text).alias("w"), n_symbols(text).alias("n_symbols"), line_measures(text).alias("l"))
    columns = [F.col("id").alias(id_col), F.col("text").alias(text_col), "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words"]
    return measured.select(*columns, ((F.col("w.n_words") < 10) | (100 * F.col("w.n_repeat_words") > 20 * F.col("w.n_words"))).alias("base_failed"))
