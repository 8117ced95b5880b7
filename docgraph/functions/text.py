"""Scalar text expressions. White space is ASCII white space throughout, as Java's ``\\s``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The line that ends a page, and the one that stands for an image.
PAGE_BREAK = "<!-- page break -->"
IMAGE = "<!-- image -->"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once and written once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(items: Column, start: Column, length: Column) -> Column:
    """``length`` items from place ``start`` (from 0), one by one: ``slice`` goes through the whole array each time."""
    return F.when(length > 0, F.transform(F.sequence(start, start + length - 1), lambda i: F.get(items, i))).otherwise(F.slice(F.array(F.get(items, F.lit(0))), F.lit(1), F.lit(0)))


def scan(items: Column, start: Column, state_type: str, out_type: str, step: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """What ``step`` puts out for each item of an array in turn: (state, item) -> struct(state, out), beginning with ``start``.

    A fold that appends to one array copies it for each item; here items are folded in blocks, whose outputs are appended block by block, so
    the time grows with the number of items.
    """
    none, nothing = F.array().cast(f"array<{out_type}>"), F.array().cast(f"array<array<{out_type}>>")

    def within(state: Column, own: Column) -> Column:
        first = F.struct(state.cast(state_type).alias("state"), none.alias("out"))
        return F.aggregate(own, first, lambda acc, x: let(step(acc["state"], x), lambda r: F.struct(r["state"].cast(state_type).alias("state"), F.concat(acc["out"], F.array(r["out"].cast(out_type))).alias("out"))))

    def blocks(all_items: Column) -> Column:
        n = F.coalesce(F.size(all_items), F.lit(0))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(block)), lambda _: n > 0)
        first = F.struct(start.cast(state_type).alias("state"), nothing.alias("done"))
        return F.aggregate(
            starts, first,
            lambda acc, at: let(within(acc["state"], part(all_items, at, F.least(F.lit(block), n - at))), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["done"], F.array(r["out"])).alias("done"))),
            lambda acc: F.flatten(acc["done"]),
        )

    return let(items, blocks)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_numeric(c: Column) -> Column:
    return collapse(c).rlike(r"^[0-9.,%-]+$")


def words(c: Column) -> Column:
    """White-space separated words; none of a blank text."""
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tokens(c: Column, longer_than: int = 0) -> Column:
    """Distinct lower-case alphanumeric tokens."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda t: F.length(t) > longer_than))


def sentences(c: Column, longer_than: int = 10) -> Column:
    """Pieces between runs of ``.!?``, trimmed, of more than ``longer_than`` characters."""
    return F.filter(F.transform(F.split(c, "[.!?]+"), strip), lambda s: F.length(s) > longer_than)


def is_markup_line(c: Column) -> Column:
    """Blank, a heading, a rule or a whole-line comment."""
    s = strip(c)
    return (s == "") | s.startswith("#") | (s.startswith("<!--") & s.endswith("-->")) | s.rlike("^[-=*]{3,}$")


def is_text_line(c: Column) -> Column:
    return ~is_markup_line(c) & c.rlike("[A-Za-z0-9]")


def is_table_line(c: Column) -> Column:
    return strip(c).startswith("|")


def last_index(c: Column, what: str) -> Column:
    """0-based place of the last ``what``, -1 if there is none."""
    n = F.length(c)
    at = F.locate(what[::-1], F.reverse(c))
    return F.when(at > 0, n - at - (len(what) - 1)).otherwise(-1)


def cut_at_sentence(c: Column, most: Column | int, share: float = 0.7) -> Column:
    """First ``most`` characters, back to the last ``. `` or line feed if that is past ``share`` of them, and three dots."""
    head = F.substring(c, F.lit(1), F.lit(most) if isinstance(most, int) else most)
    whole = F.regexp_extract(head, r"(?s)^(.*(?:\.(?= )|\n))", 1)  # up to the last end; without lambdas, as a Python function may read the result
    return F.concat(F.when(F.length(whole) - 1 > F.length(head) * share, whole).otherwise(head), F.lit("..."))


def model_tokens(c: Column) -> Column:
    """Tokens of a text for model limits, where no tokenizer is given: characters by 1.5, rounded down."""
    return F.floor(F.length(c) / 1.5).cast("long")


def tokens_by(encode: Callable[[str], Sequence]) -> Callable[[Column], Column]:
    """Like ``model_tokens`` by a tokenizer: its tokens times 1.3, rounded down; where it fails, the estimate by characters. Null has none."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> int | None:
            if text is None:
                return None
            try:
                return int(len(encode(text)) * 1.3)
            except Exception:  # noqa: BLE001  whatever the tokenizer raises, the estimate stands
                return int(len(text) / 1.5)

        return texts.map(one, na_action="ignore").astype("Int64")

    return count


def billed_tokens(c: Column) -> Column:
    """Tokens of a text for usage: a quarter of its trimmed characters, one at least, none of an empty text."""
    n = F.length(strip(c))
    return F.when(c.isNull() | (F.length(c) == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def page_summary_tokens(n_chunks: Column) -> Column:
    """Estimate for a page summary over that many chunks."""
    return F.floor((500 * n_chunks + 500) / 4).cast("long")


def normalize_page(c: Column) -> Column:
    """Lower case, white space collapsed, then only a-z, 0-9 and blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), "[^a-z0-9 ]", ""))


def distance_to_similarity(d: Column, scale: float = 150.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + d / scale)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
