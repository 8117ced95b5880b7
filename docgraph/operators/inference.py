"""Prompts, one slot for a model call, and the parsing of responses.

The prompts are written for this library; what they carry and how responses are read is fixed by the functions.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.text import let, strip, words
from docgraph.operators.grounding import format_references, supporting_chunks


def _limited(call: Callable, argument, seconds: float | None):
    """``call(argument)``, given up after so many seconds; a call that hangs is left behind in a thread that doesn't keep the worker alive."""
    if seconds is None:
        return call(argument)
    box: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            box.put((call(argument), None))
        except Exception as e:  # noqa: BLE001  handed to the caller
            box.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = box.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no response in {seconds} s") from None
    if error is not None:
        raise error
    return value


def complete(
    prompts: DataFrame,
    model: Callable,
    prompt_col: str = "prompt",
    concurrency: int | None = None,
    in_flight: int = 1,
    batch_size: int | None = None,
    retries: int = 0,
    wait: float = 1.0,
    time_limit: float | None = None,
) -> DataFrame:
    """Adds response and error: what ``model`` makes of each prompt; an exception is that row's error, not the job's.

    ``model`` takes a prompt, or with ``batch_size`` a list of up to so many and gives as many responses; a batch that fails is tried prompt by prompt, as lists of
    one, so that a bad prompt doesn't cost the others theirs. Up to ``in_flight`` calls of a task run at a time. A call that raises or takes longer than
    ``time_limit`` seconds is repeated up to ``retries`` times, after ``wait`` seconds, doubled each time. ``concurrency`` sets the number of partitions,
    and so of tasks that call at a time. Null prompts aren't sent: their response is null. Rows keep their order within a partition.
    """
    rows = prompts.repartition(concurrency) if concurrency else prompts

    def tried(argument) -> tuple:
        for attempt in range(retries + 1):
            try:
                return _limited(model, argument, time_limit), None
            except Exception as e:  # noqa: BLE001  whatever the model raises is kept
                error = f"{type(e).__name__}: {e}"
                if attempt < retries:
                    time.sleep(wait * 2**attempt)
        return None, error

    def whole(batch: list[str]) -> list[tuple]:
        responses, error = tried(batch)
        if error is None and len(responses) == len(batch):
            return [(r, None) for r in responses]
        if len(batch) == 1:
            return [(None, error or f"ValueError: {len(responses)} responses to a prompt")]
        return [x for prompt in batch for x in whole([prompt])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for part in batches:
                asked = [k for k, prompt in enumerate(part[prompt_col]) if prompt is not None]
                sent = part[prompt_col].iloc[asked].tolist()
                step = batch_size or 1
                units = [sent[at : at + step] for at in range(0, len(sent), step)]
                found = [x for unit in pool.map(whole if batch_size else (lambda unit: [tried(unit[0])]), units) for x in unit]
                responses, errors = [None] * len(part), [None] * len(part)
                for k, (response, error) in zip(asked, found, strict=True):
                    responses[k], errors[k] = response, error
                yield part.assign(response=pd.Series(responses, index=part.index, dtype=object), error=pd.Series(errors, index=part.index, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return rows.mapInPandas(run, f"{schema}, response string, error string")


def _ordered_join(order: str, text: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), between)


def page_texts(chunks: DataFrame) -> DataFrame:
    """doc_id, page_number, text: a page's chunks in order with a blank line between."""
    return chunks.where("page_number > 0").groupBy("doc_id", "page_number").agg(_ordered_join("chunk_index", F.col("content"), "\n\n").alias("text"))


def page_contents(requests: DataFrame, chunks: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, page) -> doc_id, page, has_content, used_adjacent, pages_used, chunk_ids, sections, text.

    A page's own chunks, else those one page away, else two: each request is joined with the few page numbers
    around it, an equal join, and the least distance that has chunks stays.
    """
    around = requests.select("doc_id", "page", F.explode(F.sequence(F.col("page") - most, F.col("page") + most)).alias("page_number"))
    found = around.join(chunks.where("page_number > 0"), ["doc_id", "page_number"]).withColumn("away", F.abs(F.col("page_number") - F.col("page")))
    nearest = found.withColumn("least", F.min("away").over(Window.partitionBy("doc_id", "page"))).where("away = least")
    row = F.struct("chunk_index", "page_number", "content", "section_path")
    made = nearest.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.min("least").alias("away"))
    made = made.select(
        "doc_id", "page", (F.col("away") > 0).alias("used_adjacent"), F.array_sort(F.array_distinct("rows.page_number")).alias("pages_used"), F.col("rows.chunk_index").alias("chunk_ids"),
        F.array_distinct(F.filter("rows.section_path", lambda x: F.coalesce(x, F.lit("")) != "")).alias("sections"), F.array_join("rows.content", "\n\n").alias("text"),
    )
    return requests.select("doc_id", "page").join(made, ["doc_id", "page"], "left").withColumn("has_content", F.col("text").isNotNull())


def page_prompt(page: Column, text: Column, task: str, most: int = 3000) -> Column:
    """A prompt over the first characters of a page."""
    return F.concat(F.lit("Page "), page.cast("string"), F.lit(" of a document:\n\n"), F.substring(text, 1, most), F.when(F.length(text) > most, F.lit("...")).otherwise(""), F.lit(f"\n\n{task}"))


#: What a model tends to write before a label.
LABEL_PREFIXES = ["label:", "classification:", "category:", "page type:", "this page is:", "the page is:"]


def clean_label(response: Column) -> Column:
    """First line without quotes, colons and known prefixes; ``Unknown`` if too short, 50 characters at most."""
    front, back = r"^[:\-\"']+\s*", r"\s*[:\-\"']+$"
    out = F.regexp_replace(F.regexp_replace(strip(F.get(F.split(strip(response), "\n", -1), F.lit(0))), front, ""), back, "")
    for prefix in LABEL_PREFIXES:
        out = let(out, _without(prefix, lambda x: F.regexp_replace(strip(x), front, "")))
    return let(out, lambda x: F.when(F.coalesce(F.length(x), F.lit(0)) < 2, "Unknown").when(F.length(x) > 50, F.concat(F.substring(x, 1, 47), F.lit("..."))).otherwise(x))


def _after(text: Column, mark: str) -> Column:
    """Between the first and the second ``mark``; null where there is none."""
    return F.get(F.split(text, mark, -1), F.lit(1))


NO_SUMMARY = "This page holds document content; see the document for details."


def parse_summary(response: Column, most_points: int = 5) -> Column:
    """struct(summary, key_points) of ``SUMMARY:`` and ``KEY_POINTS:`` parts.

    Without a summary mark the first line is the summary. Points lose their bullets; without points, the summary's sentences are points.
    """
    text = strip(response)
    marked = F.split(_after(text, "SUMMARY:"), "KEY_POINTS:", -1)
    summary = F.coalesce(strip(F.get(marked, F.lit(0))), strip(F.get(F.split(text, "\n", -1), F.lit(0))))
    section = F.coalesce(_after(text, "KEY_POINTS:"), F.when(~text.contains("SUMMARY:"), text), F.lit(""))
    lines = F.transform(F.split(section, "\n", -1), strip)
    points = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("SUMMARY:")), lambda x: F.when(x.rlike("^[-*]"), strip(F.regexp_replace(x, r"^[-* ]+", ""))).otherwise(x))
    points = F.filter(points, lambda x: x != "")
    by_sentence = F.transform(F.filter(F.slice(F.split(summary, r"\. ", -1), 1, 5), lambda x: strip(x) != ""), lambda x: F.concat(strip(x), F.lit(".")))
    return F.struct(F.when(summary == "", NO_SUMMARY).otherwise(summary).alias("summary"), F.slice(F.when(F.size(points) > 0, points).otherwise(by_sentence), 1, most_points).alias("key_points"))


def one_sentence(response: Column, most_words: int = 35, least_words: int = 5) -> Column:
    """The first sentence of at least five words in the first line that isn't blank (else its first), cut to 35 words."""
    line = F.get(F.filter(F.transform(F.split(strip(response), "\n", -1), strip), lambda x: x != ""), F.lit(0))
    parts = F.filter(F.transform(F.split(line, r"(?<=[.!?])\s+", -1), strip), lambda x: x != "")
    chosen = F.coalesce(F.get(F.filter(parts, lambda x: F.size(words(x)) >= least_words), F.lit(0)), F.get(parts, F.lit(0)), F.lit(""))
    many = words(chosen)
    cut = F.when(F.size(many) > most_words, F.concat(F.regexp_replace(F.array_join(F.slice(many, 1, most_words), " "), "[ ,;]+$", ""), F.lit("..."))).otherwise(chosen)
    return F.when(cut == "", NO_SUMMARY).otherwise(cut)


def extractive_summary(text: Column, most_words: int = 50) -> Column:
    """struct(summary, key_points) without a model: the first sentence, and those of the first five that are longer than 20 characters."""
    parts = F.split(text, r"\. ", -1)
    first = F.get(parts, F.lit(0))
    many = words(first)
    cut = F.when(F.size(many) > most_words, F.concat(F.regexp_replace(F.array_join(F.slice(many, 1, most_words), " "), "[ ,;]+$", ""), F.lit("..."))).otherwise(first)
    points = F.transform(F.filter(F.slice(parts, 1, 5), lambda x: F.length(strip(x)) > 20), lambda x: F.concat(strip(x), F.lit(".")))
    return F.struct(F.when(cut == "", NO_SUMMARY).otherwise(cut).alias("summary"), points.alias("key_points"))


def range_prompts(page_summaries: DataFrame) -> DataFrame:
    """(doc_id, page_number, summary) -> doc_id, block: lines ``Page n: ...`` in order."""
    line = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(": "), F.col("summary"))
    return page_summaries.groupBy("doc_id").agg(_ordered_join("page_number", line, "\n").alias("block"))


RANGE_TYPE = "array<struct<title:string,start_page:int,end_page:int,summary:string>>"


def json_array(response: Column) -> Column:
    """From the first bracket to the last, as models put text around."""
    return F.regexp_extract(response, r"(?s)(\[.*\])", 1)


def parse_ranges(responses: DataFrame) -> DataFrame:
    """(doc_id, response) -> doc_id, title, start_page, end_page, summary of valid ranges."""
    rows = responses.select("doc_id", F.explode(F.from_json(json_array(F.col("response")), RANGE_TYPE)).alias("r")).select("doc_id", "r.*")
    return rows.where("start_page > 0 AND end_page >= start_page AND trim(summary) != ''")


def ranges_or_pages(ranges: DataFrame, page_summaries: DataFrame) -> DataFrame:
    """Documents without a valid range get a range per page."""
    single = page_summaries.join(ranges.select("doc_id").distinct(), "doc_id", "left_anti")
    return ranges.unionByName(single.select("doc_id", F.concat(F.lit("Page "), F.col("page_number").cast("string")).alias("title"), F.col("page_number").alias("start_page"), F.col("page_number").alias("end_page"), "summary"))


def range_chunks(ranges: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, start_page, end_page, chunk_ids: the chunks on the pages of a range, by an equal join on its pages."""
    paged = ranges.select("doc_id", "start_page", "end_page", F.explode(F.sequence("start_page", "end_page")).alias("page_number"))
    return paged.join(chunks.select("doc_id", "page_number", "chunk_index"), ["doc_id", "page_number"]).groupBy("doc_id", "start_page", "end_page").agg(F.array_sort(F.collect_set("chunk_index")).alias("chunk_ids"))


def supported_ranges(ranges: DataFrame, chunks: DataFrame, top_k: int = 3, at_least: float = 0.1) -> DataFrame:
    """doc_id, title, start_page, end_page, summary, chunk_ids, summary_with_references: each range with the chunks on its pages that support its summary's sentences."""
    key = F.concat_ws(":", "doc_id", "start_page", "end_page", F.xxhash64("title", "summary"))
    keyed = ranges.withColumn("range", key)
    texts = keyed.select(F.col("range").alias("text_id"), F.col("range").alias("doc_id"), F.col("summary").alias("text")).distinct()
    paged = keyed.select("range", "doc_id", F.explode(F.sequence("start_page", "end_page")).alias("page_number")).distinct()
    there = paged.join(chunks.select("doc_id", "page_number", "chunk_index", "content"), ["doc_id", "page_number"]).select(F.col("range").alias("doc_id"), "chunk_index", "content")
    found = supporting_chunks(texts, there, top_k, at_least).select(F.col("text_id").alias("range"), "chunk_ids")
    joined = keyed.join(found, "range").drop("range")
    return joined.withColumn("summary_with_references", F.concat("summary", format_references(F.col("chunk_ids"))))


def supported_overviews(overviews: DataFrame, chunks: DataFrame, top_k: int = 4, at_least: float = 0.12) -> DataFrame:
    """(doc_id, doc_summary, ...) with chunk_ids and summary_with_references: the chunks of the document that support its summary's sentences."""
    texts = overviews.select(F.col("doc_id").alias("text_id"), "doc_id", F.col("doc_summary").alias("text"))
    found = supporting_chunks(texts, chunks, top_k, at_least).select("doc_id", "chunk_ids")
    return overviews.join(found, "doc_id").withColumn("summary_with_references", F.concat("doc_summary", format_references(F.col("chunk_ids"))))


def overview_prompts(page_summaries: DataFrame, most: int = 8000) -> DataFrame:
    """doc_id, prompt over all page summaries, cut to 8000 characters."""
    return range_prompts(page_summaries).select("doc_id", F.concat(F.lit("Page summaries of a document:\n\n"), F.substring("block", 1, most), F.lit("\n\nWrite SUMMARY: and QUERIES: (a list).")).alias("prompt"))


def parse_overview(response: Column, most_queries: int = 10) -> Column:
    """struct(doc_summary, suggested_queries), of a JSON object or of ``SUMMARY:`` and ``QUERIES:`` parts."""
    parsed = F.from_json(F.regexp_extract(response, r"(?s)(\{.*\})", 1), "struct<summary:string,queries:array<string>>")
    summary = strip(F.get(F.split(F.coalesce(_after(response, "SUMMARY:"), F.lit("")), "QUERIES:", -1), F.lit(0)))
    lines = F.split(F.coalesce(_after(response, "QUERIES:"), F.lit("")), "\n", -1)
    listed = F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(strip(x), r"^([-*]|\d+[.)])\s*", ""))), lambda x: x != "")
    return F.struct(F.coalesce(parsed["summary"], summary).alias("doc_summary"), F.slice(F.coalesce(parsed["queries"], listed), 1, most_queries).alias("suggested_queries"))


def context_prompts(used: DataFrame, chunks: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, doc_id, id, place, score) -> query_id, context: ranked chunks with section, heading and relevance."""
    joined = used.where(F.col("place") <= most).join(chunks.select("doc_id", F.col("chunk_index").alias("id"), "section_path", "heading", "content"), ["doc_id", "id"])
    part = F.concat(F.lit("[C"), F.col("id"), F.lit("] "), F.col("section_path"), F.lit(" / "), F.col("heading"), F.lit(" ("), F.format_number("score", 3), F.lit(")\n"), F.col("content"))
    return joined.groupBy("query_id").agg(_ordered_join("place", part, "\n\n---\n\n").alias("context"))


def parse_class(response: Column) -> Column:
    """struct(class, page_number) of ``CLASS:`` and ``PAGE_NUMBER:`` lines; full retrieval where none is known or a page has no number."""
    lines = F.split(strip(response), "\n", -1)
    line = F.upper(F.get(F.filter(lines, lambda x: F.upper(x).contains("CLASS:")), F.lit(0)))
    said = F.when(line.contains("PAGE_SUMMARY"), "PAGE_SUMMARY").when(line.contains("USE_HISTORY"), "USE_HISTORY").otherwise("FULL_RETRIEVAL")
    page_line = F.get(F.filter(lines, lambda x: F.upper(x).contains("PAGE_NUMBER:")), F.lit(0))
    number = F.regexp_extract(F.regexp_replace(F.coalesce(page_line, F.lit("")), "^[^:]*:", ""), r"(\d+)", 1).try_cast("int")
    return F.struct(F.when((said == "PAGE_SUMMARY") & number.isNull(), "FULL_RETRIEVAL").otherwise(said).alias("class"), F.when(said == "PAGE_SUMMARY", number).alias("page_number"))


#: What a model tends to write before a query, where an explanation begins, and what is no query.
QUERY_PREFIXES = ["a related query could be", "a query could be", "related query:", "query:", "the query is", "the query should be"]
EXPLANATION_MARKS = ["?", ".", " -", ":", " or", " could", " should"]
NO_QUERY = ["none", "n/a", "na", "not needed", "sufficient"]


def _unquote(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, '^"+|"+$', ""), "^'+|'+$", ""))


def parse_more(response: Column) -> Column:
    """struct(needs_more, new_query) of ``NEEDS_MORE:`` and ``RELATED_QUERY:`` lines; the query is cleaned, and needs 11 to 199 characters."""
    lines = F.split(response, "\n", -1)
    need = F.get(F.filter(lines, lambda x: F.upper(x).contains("NEEDS_MORE:")), F.lit(0))
    needs = F.coalesce(F.upper(strip(F.element_at(F.split(need, ":", -1), -1))) == "YES", F.lit(False))
    line = F.get(F.filter(lines, lambda x: F.upper(x).contains("RELATED_QUERY:")), F.lit(0))
    q = _unquote(strip(F.regexp_replace(line, "^[^:]*:", "")))
    for prefix in QUERY_PREFIXES:
        q = let(q, _without(prefix, lambda x: _unquote(strip(x))))
    q = let(q, lambda x: F.when(F.lower(x).contains(" or "), _unquote(strip(F.get(F.split(x, " or ", -1), F.lit(0))))).otherwise(x))
    for mark in EXPLANATION_MARKS:
        q = let(q, _before(mark))
    asked = line.isNotNull()

    def judge(x: Column) -> Column:
        valid = F.coalesce(~F.lower(x).isin(*NO_QUERY) & (F.length(x) > 10) & (F.length(x) < 200), F.lit(False))
        return F.struct((needs & (valid | ~asked)).alias("needs_more"), F.when(needs & valid, x).alias("new_query"))

    return let(F.array_join(words(_unquote(q)), " "), judge)


def _without(prefix: str, rest: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A text without a prefix in any case, what remains put through ``rest``."""
    return lambda x: F.when(F.lower(x).startswith(prefix), rest(F.substring(x, F.lit(len(prefix) + 1), F.length(x)))).otherwise(x)


def _before(mark: str) -> Callable[[Column], Column]:
    """What stands before a mark that an explanation follows, if it is long enough."""

    def cut(x: Column) -> Column:
        at = F.locate(mark, x) - 1
        return F.when((at < F.length(x) - 10) & (at > 10), strip(F.substring(x, F.lit(1), at))).otherwise(x)

    return cut


def clean_answer(text: Column) -> Column:
    """Without chunk mentions, doubled signs, blanks before signs and runs of blank lines."""
    for pattern, to in (
        (r"\([Cc]hunk\s+\d+\)", ""), (r"\[[Cc]hunk\s+\d+\]", ""), (r"[Cc]hunk\s+\d+", ""), (r"[ \t]+", " "), (r"\s*,\s*,", ","), (r"\s*\.\s*\.", "."),
        (r" +([,.!?;:])", "$1"), (r" +(\n)", "$1"), (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def follow_up_questions(responses: DataFrame, most: int = 7) -> DataFrame:
    """(query_id, response) -> query_id, place, question: one per line, without bullets or numbers, the first of those that differ in case only."""
    bare = lambda x: strip(F.when(x.rlike("^[-*]"), F.substring(x, F.lit(2), F.length(x))).otherwise(F.regexp_replace(x, r"^\d+[.)]\s*", "")))
    asked = responses.select("query_id", F.posexplode(F.filter(F.transform(F.transform(F.split("response", "\n", -1), strip), bare), lambda x: x != "")).alias("p", "question"))
    first = asked.withColumn("k", F.row_number().over(Window.partitionBy("query_id", F.lower("question")).orderBy("p"))).where("k = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("p"))).where(F.col("place") <= most).select("query_id", "place", "question")


def extraction_context(chunks: DataFrame, most_chunks: int = 30, most_each: int = 800, most: int = 12_000) -> DataFrame:
    """doc_id, context: a document's first chunks, cut, with rules between; a context that is cut ends with a mark."""
    first = chunks.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))).where(F.col("k") <= most_chunks)
    joined = first.groupBy("doc_id").agg(_ordered_join("k", F.substring("content", 1, most_each), "\n\n---\n\n").alias("context"))
    return joined.withColumn("context", F.when(F.length("context") > most, F.concat(F.substring("context", 1, most), F.lit(CUT_MARK))).otherwise(F.col("context")))


#: The kinds of facts to extract, and the mark of a context that was cut.
EXTRACTION_KINDS = ["key_facts", "entities", "dates", "obligations"]
CUT_MARK = "\n...[truncated]"

#: What each kind asks for.
EXTRACTION_TASKS = {
    "key_facts": "Which facts, points and conclusions matter most?",
    "entities": "Which people, organizations, products and places are named?",
    "dates": "Which dates, deadlines and periods are stated?",
    "obligations": "What must be done, and what is promised?",
}


def extraction_prompts(contexts: DataFrame, kinds: list[str] = EXTRACTION_KINDS) -> DataFrame:
    """(doc_id, context) -> doc_id, kind, prompt: one for each kind; a kind that isn't known asks for key facts."""
    task = F.create_map(*[F.lit(x) for pair in EXTRACTION_TASKS.items() for x in pair])
    each = contexts.select("doc_id", "context", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    asked = F.coalesce(F.try_element_at(task, F.col("kind")), F.lit(EXTRACTION_TASKS["key_facts"]))
    return each.select("doc_id", "kind", F.concat(F.lit("Parts of a document:\n\n"), "context", F.lit("\n\n"), asked, F.lit("\nAnswer with a JSON array of strings alone.")).alias("prompt"))


def extracted(responses: DataFrame) -> DataFrame:
    """(doc_id, kind, response) -> doc_id, kind, items; a call that failed (null) has no items."""
    return responses.select("doc_id", "kind", F.coalesce(parse_list(F.col("response")), F.array().cast("array<string>")).alias("items"))


def parse_list(response: Column, most_lines: int = 50) -> Column:
    """The strings of a JSON array that aren't empty, none of a broken one; without an array up to 50 lines that aren't blank."""
    listed = json_array(response)
    lines = F.slice(F.filter(F.transform(F.split(response, "\n", -1), strip), lambda x: x != ""), 1, most_lines)
    items = F.filter(F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.when(listed != "", items).otherwise(lines)


def history_text(messages: DataFrame, last: int = 5, most: int = 600) -> DataFrame:
    """(session_id, id, role, content) -> session_id, history: the last messages, each cut, ``role: content``, blank lines between."""
    recent = messages.withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("id")))).where(F.col("k") <= last)
    line = F.concat("role", F.lit(": "), F.substring("content", 1, most), F.when(F.length("content") > most, "...").otherwise(""))
    return recent.groupBy("session_id").agg(_ordered_join("id", line, "\n\n").alias("history"))


def full_history_text(messages: DataFrame, most: int = 400) -> DataFrame:
    """(session_id, id, role, content, chunks) -> session_id, history: all, with up to two cited chunks under an assistant's message."""
    cited = F.transform(F.filter(F.slice(F.coalesce("chunks", F.array().cast("array<struct<chunk_index:int,content:string>>")), 1, 2), lambda c: F.coalesce(c["content"], F.lit("")) != ""),
                        lambda c: F.concat(F.lit("\n  [Chunk "), c["chunk_index"], F.lit("]: "), F.substring(c["content"], 1, most), F.when(F.length(c["content"]) > most, F.lit("...")).otherwise("")))
    line = F.when(F.col("role") == "user", F.concat(F.lit("User: "), strip(F.col("content")))).otherwise(F.concat(F.lit("Assistant: "), strip(F.col("content")), F.array_join(cited, "")))
    return messages.groupBy("session_id").agg(F.concat(F.lit("Previous conversation:\n"), _ordered_join("id", line, "\n")).alias("history"))
