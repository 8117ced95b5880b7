"""What a page's markup and address say: its visible text, its declared language, its host's suffix."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible_text(html: Column) -> Column:
    """Text outside of comments, scripts, styles, templates, the head and tags, references to characters replaced; null for null."""
    t = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    t = F.regexp_replace(t, r"(?is)<head\b[^>]*>.*?</head\s*>", " ")
    t = F.regexp_replace(t, r"(?s)</?[a-zA-Z!][^>]*>", " ")
    return F.when(t.contains("&"), _without_references(t)).otherwise(t)


def _without_references(t: Column) -> Column:
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, code)])

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10).cast("int")).when(name.startswith("#"), F.substring(name, 2, 7).cast("int")).otherwise(F.try_element_at(names, name))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when((name != "") & valid, F.concat(char, F.regexp_replace(part, r"^[^;]*;", ""))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(t, "&", -1)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))


def declared_language(html: Column) -> Column:
    """The ``lang`` (or else ``xml:lang``) of the html element; null if it has none."""
    tag = F.regexp_extract(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " "), r"(?is)<html\b([^>]*)>", 1)
    found = [F.nullif(F.regexp_extract(tag, rf"(?is)(?:^|\s){name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1), F.lit("")) for name in ("lang", "xml:lang")]
    return F.coalesce(*found)


def host_suffix(host: Column) -> Column:
    """The last label of a host, without its port; null for an address in digits or an empty host."""
    return F.nullif(F.lower(F.regexp_extract(host, r"(?:^|[.@])([A-Za-z][A-Za-z0-9-]*)\.?(?::\d*)?$", 1)), F.lit(""))
