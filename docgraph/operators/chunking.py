"""Chunks: slices of heading regions, with their sections, pages and neighbours."""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.text import PAGE_BREAK, collapse, cut_at_sentence, is_markup_line, is_table_line, is_text_line, let, model_tokens, part, scan, strip
from docgraph.operators.layout import HEADER, header_array, path_array
from docgraph.sources.shared import stored

#: Limits of an embedding model's input.
MOST_CHARS, MOST_TOKENS = 1000, 1500


def chunk_size(total_chars: Column) -> Column:
    """An eighth of the text, 300 at least and 1000 at most."""
    return F.least(F.lit(1000), F.greatest(F.lit(300), F.floor(total_chars / 8))).cast("int")


def _regions_of(hs: Column, ls: Column, size: Column) -> Column:
    """Regions of a document in order, of its headers, its lines and the size of its pieces; without a text line there is none."""

    def region(h: Column, k: Column) -> Column:
        end = F.coalesce(F.get(hs, k + 1)["line"] - 1, F.size(ls))
        own = part(ls, h["line"], end - h["line"])
        text = let(own, lambda x: F.when(F.exists(x, is_text_line), F.concat(F.array_join(x, "\n"), F.lit("\n"))))
        return F.struct(h["line"].alias("line"), h["level"].alias("level"), h["title"].alias("title"), h["section_path"].alias("section_path"), size.alias("size"), text.alias("region"))

    return F.filter(F.transform(hs, region), lambda r: r["region"].isNotNull()).cast("array<struct<line:int,level:int,title:string,section_path:string,size:int,region:string>>")


def regions(md: DataFrame) -> DataFrame:
    """doc_id, line, level, title, section_path, size, region: the lines after each header up to the next; without a text line there is no region."""
    made = let(path_array(header_array(F.col("markdown"))), lambda hs: let(F.split("markdown", "\n", -1), lambda ls: let(chunk_size(F.length("markdown")), lambda size: _regions_of(hs, ls, size))))
    return md.select("doc_id", F.explode(made).alias("r")).select("doc_id", "r.*")  # all is in the exploded array, so no row holds the text


def _pieces(region: Column, size: Column) -> Column:
    """Pieces of ``size`` characters of a region, each with the line feeds before it: array of (content, before)."""
    pieces = F.regexp_extract_all(region, F.concat(F.lit("(?s).{1,"), size, F.lit("}")), F.lit(0))
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    return scan(pieces, F.lit(0), "int", "struct<content:string,before:int>", lambda before, x: F.struct((before + feeds(x)).alias("state"), F.struct(x.alias("content"), before.alias("before")).alias("out")))


def filled_slices(markdown: Column) -> Column:
    """What ``slices`` of ``regions`` gives, with page_number, as an array of a document's row, without empty pieces: all of it is computed from the document's text, so nothing is shuffled."""

    def of_region(r: Column, pages: Column) -> Column:
        return F.transform(
            _pieces(r["region"], r["size"]),
            lambda x: let(r["line"] + 1 + x["before"], lambda at: F.struct(r["level"].alias("level"), r["title"].alias("title"), r["section_path"].alias("section_path"), x["content"].alias("content"), at.alias("start_line"), F.get(pages, at - 1).alias("page_number"))),
        )

    def of_document(ls: Column) -> Column:
        pages = scan(ls, F.lit(1), "int", "int", lambda page, x: F.struct((page + x.contains(PAGE_BREAK).cast("int")).alias("state"), page.alias("out")))
        cut = lambda hs: let(chunk_size(F.length(markdown)), lambda size: let(pages, lambda ps: F.flatten(F.transform(_regions_of(hs, ls, size), lambda r: of_region(r, ps)))))
        return let(path_array(header_array(markdown)), cut)

    every = let(F.split(markdown, "\n", -1), of_document)
    return F.filter(F.transform(every, lambda c, i: F.struct(i.alias("position"), *[c[x].alias(x) for x in ("level", "title", "section_path", "content", "start_line", "page_number")])), lambda c: ~is_empty_chunk(c["content"]))


def slices(regions_df: DataFrame) -> DataFrame:
    """Pieces of ``size`` characters of each region: adds content, start_line and position (from 0, within the document).

    Slice k starts k sizes into the region, and its line is the header's, plus one, plus the line feeds before it. A region is gone through once:
    it is cut by a pattern of so many characters, and the line feeds of the pieces are added up from one to the next.
    """
    cut = regions_df.select("doc_id", "line", "level", "title", "section_path", "size", F.posexplode(_pieces(F.col("region"), F.col("size"))).alias("k", "piece"))
    made = cut.select("doc_id", "line", "level", "title", "section_path", "size", "k", F.col("piece.content").alias("content"), (F.col("line") + 1 + F.col("piece.before")).alias("start_line"))
    return made.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "k")) - 1)


def chunk_heading(title: Column, content: Column, path: Column, position: Column) -> Column:
    """Section title, else the first header in the text, else the path's last part, else a number."""
    inside = F.get(F.filter(F.transform(F.split(content, "\n", -1), lambda x: F.regexp_extract(strip(x), HEADER, 2)), lambda t: t != ""), F.lit(0))
    return F.coalesce(F.nullif(title, F.lit("")), inside, F.nullif(F.element_at(F.split(path, " > "), -1), F.lit("")), F.concat(F.lit("Chunk "), position + 1))


def with_table_flags(chunks: DataFrame) -> DataFrame:
    """Adds has_table, table_context (its first three table lines) and chunk_type."""
    rows = F.filter(F.split("content", "\n", -1), is_table_line)
    made = chunks.withColumn("has_table", F.size(rows) > 0)
    return made.withColumns({"table_context": F.when(F.col("has_table"), F.array_join(F.slice(rows, 1, 3), "\n")), "chunk_type": F.when(F.col("has_table"), "table").otherwise("text")})


def is_empty_chunk(content: Column) -> Column:
    """No line but markup, or none with a letter or digit."""
    return ~F.exists(F.split(content, "\n", -1), lambda x: ~is_markup_line(x) & x.rlike("[A-Za-z0-9]"))


def preview_words(content: Column, most: int = 1500) -> Column:
    """Distinct words of the first characters, white space collapsed."""
    return F.array_distinct(F.filter(F.split(F.substring(collapse(content), 1, most), " "), lambda w: w != ""))


def drop_near_repeats(chunks: DataFrame, at_least: float = 0.9, fold_chunks: int = 256) -> DataFrame:
    """Chunks of each document, in order, without those whose preview words are near those of a chunk kept before.

    Order decides: a chunk that is near a dropped one only stays. Chunks without words always stay. Documents of up to ``fold_chunks`` chunks are
    folded, each in one value of that bounded size. In longer ones, near pairs are found by joins on rare words, and the rule is applied in
    rounds to all documents at once (``kept_by_rounds``); nothing of such a document is in one place. Both give the same rows. The chunks are
    written once and read for each step.
    """
    chunks = stored(chunks, "chunks")
    sets = chunks.select("doc_id", "position", F.array_sort(preview_words(F.col("content"))).alias("words"))
    long = chunks.groupBy("doc_id").count().where(F.col("count") > fold_chunks).select("doc_id")
    if long.isEmpty():
        kept = kept_by_fold(sets, at_least)
    else:
        long = stored(long, "long")
        kept = kept_by_fold(sets.join(long, "doc_id", "left_anti"), at_least).unionByName(kept_by_rounds(sets.join(long, "doc_id", "left_semi"), at_least))
    return chunks.join(kept, ["doc_id", "position"], "left_semi").select(*chunks.columns)


def _near(a: Column, b: Column, at_least: float) -> Column:
    """Jaccard similarity of two sets; sets of too different sizes can't be near, and most pairs end there."""
    n, m = F.size(a), F.size(b)
    alike = let(F.size(F.array_intersect(a, b)), lambda both: both / (n + m - both) >= at_least)
    return F.coalesce(F.when(F.least(n, m) / F.greatest(n, m) >= at_least, alike), F.lit(False))


def first_of_near(sets: list[list[int]], at_least: float) -> list[int]:
    """Places of the sets that stay, in order: those not near one kept before; empty ones always stay.

    Two near sets share at least ``at_least`` of either, so with words in order of rarity they share one of their first few, and only what shares these is compared.
    """
    often = Counter(w for words in sets for w in words)
    kept: list[int] = []
    by_word: dict[int, list[frozenset[int]]] = {}
    for place, words in enumerate(sets):
        n, own = len(words), frozenset(words)
        few = heapq.nsmallest(n - math.ceil(n * at_least - 1e-9) + 1, words, key=lambda w: (often[w], w)) if n else []

        def near(other: frozenset[int], n: int = n, own: frozenset[int] = own) -> bool:
            if min(n, len(other)) / max(n, len(other)) < at_least:
                return False
            both = len(own & other)
            return both / (n + len(other) - both) >= at_least

        if any(near(other) for other in {id(x): x for w in few for x in by_word.get(w, ())}.values()):
            continue
        kept.append(place)
        for w in few:
            by_word.setdefault(w, []).append(own)
    return kept


def kept_places(sets: Column, at_least: float) -> Column:
    """``first_of_near`` of a column of documents' sets of words."""

    @F.arrow_udf("array<int>")
    def run(documents: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(documents), 64):
            some = documents.slice(at, 64)
            per_doc, lists = pc.list_value_length(some).fill_null(0).to_pylist(), some.flatten()
            ends = np.cumsum([0, *pc.list_value_length(lists).fill_null(0).to_pylist()]).tolist()
            codes = lists.flatten().dictionary_encode().indices.to_pylist()
            each = [codes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            first = 0
            for n in per_doc:
                found.append(first_of_near(each[first : first + n], at_least))
                first += n
        return pa.array(found, pa.list_(pa.int32()))

    return run(sets)


def kept_by_fold(sets: DataFrame, at_least: float = 0.9) -> DataFrame:
    """(doc_id, position, words) -> doc_id, position of what stays; a document's sets are one value."""
    every = sets.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "words"))).alias("all")).withColumn("kept", kept_places(F.col("all.words"), at_least))
    return every.select("doc_id", F.explode(F.transform("kept", lambda k: F.get(F.col("all.position"), k))).alias("position"))


def near_pairs_of_sets(sets: DataFrame, at_least: float = 0.9) -> DataFrame:
    """(doc_id, position, words: distinct) -> doc_id, p, q: positions p < q of sets in a document with a Jaccard similarity of ``at_least``.

    Two such sets share at least that part of either, so, with words in order of rarity in the document, each has a shared word among its
    first few: these are joined, and what meets is compared once.
    """
    n = F.col("n")
    each = sets.select("doc_id", "position", F.size("words").alias("n"), F.explode("words").alias("word"))
    ranked = each.withColumn("often", F.count("*").over(Window.partitionBy("doc_id", "word"))).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "position").orderBy("often", "word")))
    prefix = stored(ranked.where(F.col("k") <= n - F.ceil(n * at_least - 1e-9) + 1).select("doc_id", "word", "position", "n"), "prefixes")
    later = prefix.select("doc_id", "word", F.col("position").alias("q"), F.col("n").alias("m"))
    met = prefix.join(later, ["doc_id", "word"]).where((F.col("position") < F.col("q")) & (F.least("n", "m") / F.greatest("n", "m") >= at_least)).select("doc_id", F.col("position").alias("p"), "q").distinct()
    one, other = (sets.select("doc_id", F.col("position").alias(c), F.col("words").alias(f"{c}_words")) for c in "pq")
    return met.join(one, ["doc_id", "p"]).join(other, ["doc_id", "q"]).where(_near(F.col("p_words"), F.col("q_words"), at_least)).select("doc_id", "p", "q")


def kept_by_rounds(sets: DataFrame, at_least: float = 0.9) -> DataFrame:
    """As ``kept_by_fold``, without a document's sets in one value.

    Of equal sets only the first can stay, whatever becomes of it. A round drops what is near an earlier set that stays, and keeps what has no
    undecided earlier neighbour left; the first undecided set of each document is decided in each round, so they end.
    """
    key = ["doc_id", "position"]
    blank = sets.where(F.size("words") == 0).select(*key)
    classes = stored(sets.where(F.size("words") > 0).groupBy("doc_id", F.md5(F.array_join("words", " ").cast("binary")).alias("set")).agg(F.min("position").alias("position"), F.min_by("words", "position").alias("words")), "classes")
    pairs = stored(near_pairs_of_sets(classes, at_least), "near")
    earlier = pairs.select("doc_id", F.col("p").alias("position"), F.col("q"))
    later = pairs.select("doc_id", F.col("q").alias("position")).distinct()
    kept = [classes.select(*key).join(later, key, "left_anti")]
    new, waiting = kept[0], later
    while True:
        gone = new.join(earlier, key).select("doc_id", F.col("q").alias("position"))
        waiting = stored(waiting.join(gone, key, "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        held = waiting.join(earlier, key).select("doc_id", F.col("q").alias("position"))
        new = stored(waiting.join(held, key, "left_anti"), "kept")
        waiting = waiting.join(new, key, "left_anti")
        kept.append(new)
    return functools.reduce(DataFrame.unionByName, kept).unionByName(blank)


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """Numbers chunks from 0 in order and adds up to two ids before and after, and the place in the sequence."""
    by_doc = Window.partitionBy("doc_id")
    numbered = chunks.withColumn("chunk_index", F.row_number().over(by_doc.orderBy("position")) - 1).withColumn("n", F.count("*").over(by_doc).cast("int"))
    i = F.col("chunk_index")
    return numbered.withColumns(
        {
            "prev_chunk_ids": F.filter(F.array(i - 2, i - 1), lambda x: x >= 0),
            "next_chunk_ids": F.filter(F.array(i + 1, i + 2), lambda x: x < F.col("n")),
            "sequential_position": i,
        }
    ).drop("n")


def with_pages(chunks: DataFrame, paged_lines: DataFrame) -> DataFrame:
    """Adds page_number, that of the chunk's first line."""
    return chunks.join(paged_lines.select("doc_id", F.col("line_no").alias("start_line"), "page_number"), ["doc_id", "start_line"], "left")


def paged_chunks(md: DataFrame, at_least: float = 0.9, fold_chunks: int = 256) -> DataFrame:
    """doc_id, chunk_index, content, heading, section and table columns, neighbours, page_number: regions, slices, flags and near repeats of whole documents.

    Of documents of up to ``fold_chunks`` chunks all is computed within their row, and the chunks are written once; nothing is shuffled. The chunks of longer ones are
    written with them, and go on by joins and rounds (``drop_near_repeats``).
    """
    cut = md.select("doc_id", filled_slices(F.col("markdown")).alias("cs"))
    short = F.when(F.size("cs") <= fold_chunks, F.transform("cs", lambda c: preview_words(c["content"])))
    cut = cut.withColumn("short", short).withColumn("kept", F.when(F.col("short").isNotNull(), kept_places(F.col("short"), at_least)))
    own = F.transform("kept", lambda at, k: F.struct(k.alias("chunk_index"), F.size("kept").alias("n"), F.get("cs", at).alias("c")))
    rest = F.transform("cs", lambda c: F.struct(F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("int").alias("n"), c.alias("c")))
    every = stored(cut.select("doc_id", F.explode(F.when(F.col("kept").isNotNull(), own).otherwise(rest)).alias("x")).select("doc_id", "x.chunk_index", "x.n", "x.c.*"), "chunks")
    i, n = F.col("chunk_index"), F.col("n")
    neighbours = {"prev_chunk_ids": F.filter(F.array(i - 2, i - 1), lambda x: x >= 0), "next_chunk_ids": F.filter(F.array(i + 1, i + 2), lambda x: x < n), "sequential_position": i}
    kept = every.where("chunk_index IS NOT NULL").withColumns(neighbours).drop("n")
    long = every.where("chunk_index IS NULL").drop("chunk_index", "n")
    if not long.isEmpty():
        kept = kept.unionByName(with_neighbours(drop_near_repeats(long, at_least, fold_chunks)))
    heading = chunk_heading(F.col("title"), F.col("content"), F.col("section_path"), F.col("position"))
    return with_table_flags(kept).select(
        "doc_id", "chunk_index", "content", F.length("content").alias("chunk_size"), heading.alias("heading"), "section_path", F.col("title").alias("section_title"), F.col("level").alias("section_level"),
        "chunk_type", "table_context", "start_line", "has_table", "prev_chunk_ids", "next_chunk_ids", "sequential_position", "page_number",
    )


def chunk_documents(md: DataFrame) -> DataFrame:
    """``paged_chunks`` without the pages."""
    return paged_chunks(md).drop("page_number")


def fit_embedding(text: Column, tokens: Callable[[Column], Column] = model_tokens, fit: Callable[[Column, int], Column] | None = None) -> Column:
    """struct(text, truncated, tokens): cut to 1000 characters, and where that still exceeds the token limit to 90 % of it; a shorter text to 85 %.

    ``tokens`` counts (``text.tokens_by`` for a tokenizer), ``fit`` cuts to a number of tokens (``fit_tokens_by``).
    """
    safe, fit = int(MOST_TOKENS * 0.85), fit or fit_tokens
    by_chars, by_tokens = F.length(text) > MOST_CHARS, tokens(text) > safe
    short = cut_at_sentence(text, MOST_CHARS)
    fitted = F.when(by_chars & (tokens(short) > MOST_TOKENS), fit(short, int(MOST_TOKENS * 0.9))).when(by_chars, short).when(by_tokens, fit(text, safe)).otherwise(text)
    return F.struct(fitted.alias("text"), (by_chars | by_tokens).alias("truncated"), tokens(fitted).alias("tokens"))


def fit_tokens(text: Column, most_tokens: int) -> Column:
    """Cut to so many tokens, by the character estimate; past 0.7 of them at a sentence's or line's end."""
    most = int(most_tokens * 1.5)
    return F.when(F.length(text) <= most, text).otherwise(cut_at_sentence(text, most))


def fit_tokens_by(encode: Callable[[str], Sequence], decode: Callable[[Sequence], str]) -> Callable[[Column, int], Column]:
    """Like ``fit_tokens`` by a tokenizer: a longer text keeps 95 % of the limit, at a sentence's or line's end if that is past 0.7 of it, and gets three dots.

    If that still encodes to more than the limit, 90 % of it stay, uncut. Where the tokenizer fails, the limit is 1.5 characters a token, and the dots always follow. Null stays null.
    """

    def one(text: str, most: int) -> str:
        try:
            ids = encode(text)
            if len(ids) <= most:
                return text
            head = decode(ids[: int(most * 0.95)])
            if len(encode(head)) > most:
                head = decode(ids[: int(most * 0.9)])
            at = max(head.rfind(". "), head.rfind("\n"))
            made = (head[: at + 1] if at > len(head) * 0.7 else head) + "..."
            return made if len(encode(made)) <= most else decode(ids[: int(most * 0.9)]) + "..."
        except Exception:  # noqa: BLE001  whatever the tokenizer raises, the estimate stands
            return text[: int(most * 1.5)] + "..."

    def fit(text: Column, most_tokens: int) -> Column:
        @F.pandas_udf("string")
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: one(t, most_tokens), na_action="ignore")

        return cut(text)

    return fit


def final_cut(text: Column, tokens: Callable[[Column], Column] = model_tokens) -> Column:
    """The last check before embedding: 1000 characters, or 800 if the tokens still exceed the limit, as they can by a tokenizer (``text.tokens_by``)."""
    once = F.when(F.length(text) > MOST_CHARS, F.concat(F.substring(text, 1, MOST_CHARS), F.lit("..."))).otherwise(text)
    return F.when(tokens(once) > MOST_TOKENS, F.concat(F.substring(once, 1, int(MOST_CHARS * 0.8)), F.lit("..."))).otherwise(once)


def stored_heading(heading: Column, title: Column, path: Column, number: Column) -> Column:
    """A heading for storage: section information in place of none or a bare chunk number."""
    weak = F.coalesce(heading, F.lit("")) == ""
    return F.when(weak | heading.startswith("Chunk "), F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.element_at(F.split(path, " > "), -1), F.lit("")), F.concat(F.lit("Chunk "), number))).otherwise(heading)


def end_line(start: Column, content: Column) -> Column:
    return start + F.size(F.split(content, "\n", -1)) - 1


def chunk_statistics(chunks: DataFrame, tokens: Callable[[Column], Column] = model_tokens, fit: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """Per document: total_chunks, truncated_chunks (cut to the embedding limit, or by the final check), embedding_tokens, llm_tokens (of the whole texts, cut or not).

    ``tokens`` and ``fit`` are as in ``fit_embedding``.
    """
    fitted = chunks.select("doc_id", fit_embedding(F.col("content"), tokens, fit).alias("e"), tokens(F.col("content")).alias("llm"))
    cut = F.col("e.truncated") | (final_cut(F.col("e.text"), tokens) != F.col("e.text"))
    judged = fitted.select("doc_id", "e.tokens", "llm", cut.alias("cut"))
    return judged.groupBy("doc_id").agg(F.count("*").alias("total_chunks"), F.sum(F.col("cut").cast("long")).alias("truncated_chunks"), F.sum("tokens").alias("embedding_tokens"), F.sum("llm").alias("llm_tokens"))


def pack_paragraphs(md: DataFrame, most: int = 400) -> DataFrame:
    """doc_id, piece, text: paragraphs, each with the blank line after it, put together up to ``most`` characters; a longer one stands alone."""
    paragraphs = F.transform(F.split("markdown", "\n\n", -1), lambda p: F.concat(p, F.lit("\n\n")))

    def place(state: Column, p: Column) -> Column:
        """The piece that a paragraph falls in, from its number and length so far."""
        fits = (state["piece"] >= 0) & (state["length"] + F.length(p) <= most)
        piece = F.when(fits, state["piece"]).otherwise(state["piece"] + 1)
        return F.struct(F.struct(piece.alias("piece"), (F.when(fits, state["length"]).otherwise(0) + F.length(p)).alias("length")).alias("state"), piece.alias("out"))

    def join(ps: Column, piece: Column) -> Column:
        first = F.filter(F.transform(piece, lambda x, i: F.when((i == 0) | (x != F.get(piece, i - 1)), i)), lambda i: i.isNotNull())
        return let(first, lambda starts: F.transform(starts, lambda at, k: F.array_join(part(ps, at, F.coalesce(F.get(starts, k + 1), F.size(ps)) - at), "")))

    start = F.struct(F.lit(-1).alias("piece"), F.lit(0).alias("length"))
    packed = let(paragraphs, lambda ps: let(scan(ps, start, "struct<piece:int,length:int>", "int", place), lambda piece: join(ps, piece)))
    return md.where("markdown != ''").select("doc_id", F.posexplode(packed).alias("piece", "text"))
