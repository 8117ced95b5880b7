"""Whole flows: repair and layout of new documents, the build of chunks, graph and summaries, and answers to a batch of queries."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions.text import strip
from docgraph.operators import chunking, dedup, graph, grounding, inference, layout, retrieval, tables, vectors
from docgraph.sources.shared import stored

Embedding = Callable[[DataFrame], DataFrame]

#: Own texts for what can't be answered.
NO_CONTENT = "No content is available for this page."
NO_HISTORY = "There are no earlier messages to answer from."
NO_CHUNKS = "The document holds nothing that answers this question."
NO_ANSWER = "The answer could not be made; please ask again."
NO_INTS = "array<int>"


@dataclass(frozen=True)
class Corpus:
    """What a build makes of (doc_id, markdown); the last four only with a model."""

    chunks: DataFrame
    vectors: DataFrame
    nodes: DataFrame
    edges: DataFrame
    duplicates: DataFrame | None = None
    page_summaries: DataFrame | None = None
    ranges: DataFrame | None = None
    overviews: DataFrame | None = None


def ingest(md: DataFrame) -> DataFrame:
    """(doc_id, markdown) with its tables repaired."""
    return tables.repair_markdown(layout.lines(md))


def hashed(width: int) -> Embedding:
    """The embedding that needs no model: (..., text) with vec."""
    return lambda rows: vectors.hashed_words(rows, "text", width)


def build(md: DataFrame, similar: bool = False, width: int = 64, embed: Embedding | None = None, model: Callable | None = None, **calls) -> Corpus:
    """Chunks with pages, their vectors, the graph, and duplicate pages; with a model also page summaries, page ranges and an overview of each document.

    ``embed`` adds vec to rows with a text (hashed words by default); ``similar`` adds similarity edges. ``calls`` are options of ``inference.complete``. Chunks,
    vectors, edges and every model's responses are written once, as they are read many times after.
    """
    embed = embed or hashed(width)
    md = stored(md, "documents")
    lines = layout.line_pages(layout.lines(md))
    chunks = stored(chunking.with_pages(chunking.chunk_documents(md), lines), "chunks")
    vecs = stored(embed(chunks.select("doc_id", "chunk_index", F.col("content").alias("text"))).select("doc_id", "chunk_index", "vec"), "vectors")
    sections = graph.section_nodes(layout.headers(md))
    nodes = graph.all_nodes(sections, graph.chunk_nodes(chunks), graph.page_nodes(chunks))
    follows = graph.follow_edges(chunks)
    edges = graph.section_edges(sections).unionByName(graph.containment_edges(chunks)).unionByName(graph.page_edges(chunks)).unionByName(follows)
    if similar:
        edges = edges.unionByName(graph.similar_edges(vecs, follows))
    edges = stored(edges, "edges")
    pages = stored(layout.split_pages(md), "pages")
    page_vecs = stored(embed(pages).select("doc_id", "nonblank_page_no", "vec"), "page-vectors")
    duplicates = stored(dedup.duplicate_report(pages, dedup.exact_clusters(pages), dedup.near_pairs(pages, page_vecs)), "duplicates")
    return Corpus(chunks, vecs, nodes, edges, duplicates, *(summaries(chunks, model, **calls) if model else ()))


def _asked(prompts: DataFrame, model: Callable, **calls) -> DataFrame:
    """Prompts with response and error, written, so that no model is called again for what comes after."""
    return stored(inference.complete(prompts, model, **calls), "responses")


def summaries(chunks: DataFrame, model: Callable, **calls) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page summaries, ranges, overviews) of documents, each with the chunks that support it and its references.

    A page's summary is one sentence; a failed call leaves the page's own first sentences. Ranges of pages come from the summaries of a document's pages; a document
    without a valid one has a range per page. Both and the overview are grounded in the chunks of their pages, the overview in all of the document's.
    """
    texts = inference.page_texts(chunks)
    prompts = texts.withColumn("prompt", inference.page_prompt(F.col("page_number"), F.col("text"), "Summarize this page in one sentence."))
    told = _asked(prompts, model, **calls)
    brief = F.when(strip(F.coalesce("response", F.lit(""))) != "", inference.one_sentence(F.col("response"))).otherwise(inference.extractive_summary(F.col("text"))["summary"])
    pages = stored(told.select("doc_id", "page_number", brief.alias("summary")), "page-summaries")
    one_page = pages.select("doc_id", F.col("page_number").alias("start_page"), F.col("page_number").alias("end_page"), F.lit("").alias("title"), "summary")
    supported = inference.supported_ranges(one_page, chunks, 3, 0.08).select("doc_id", F.col("start_page").alias("page_number"), "summary", "chunk_ids", "summary_with_references")
    task = F.lit("\n\nGroup these pages into ranges. Reply with a JSON array of title, start_page, end_page, summary.")
    parted = _asked(inference.range_prompts(pages).select("doc_id", F.concat("block", task).alias("prompt")), model, **calls)
    ranges = inference.ranges_or_pages(inference.parse_ranges(parted.where("response IS NOT NULL").select("doc_id", "response")), pages)
    seen = _asked(inference.overview_prompts(pages), model, **calls)
    overviews = seen.where("response IS NOT NULL").select("doc_id", inference.parse_overview(F.col("response")).alias("o")).select("doc_id", "o.*")
    return stored(supported, "page-summaries"), stored(inference.supported_ranges(ranges, chunks), "ranges"), stored(inference.supported_overviews(overviews, chunks), "overviews")


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def classify(queries: DataFrame, model: Callable, history: DataFrame | None = None, **calls) -> DataFrame:
    """(query_id, doc_id, text) with history, route and page_number: which way each query goes, as the model classes it; full retrieval where it fails."""
    past = inference.history_text(history.withColumnRenamed("query_id", "session_id")).withColumnRenamed("session_id", "query_id") if history is not None else None
    known = queries.join(past, "query_id", "left") if past is not None else queries.withColumn("history", F.lit(None).cast("string"))
    task = "\n\nClass this question.\nReply CLASS: FULL_RETRIEVAL, USE_HISTORY or PAGE_SUMMARY, and PAGE_NUMBER: a number or None."
    prompt = _said("Earlier messages:\n", F.coalesce("history", F.lit("(none)")), "\n\nQuestion: ", F.col("text"), task)
    said = _asked(known.withColumn("prompt", prompt), model, **calls).withColumn("c", inference.parse_class(F.coalesce("response", F.lit(""))))
    way = retrieval.route(F.col("c.class") == "PAGE_SUMMARY", F.coalesce("c.page_number", F.lit(0)), F.col("c.class") == "USE_HISTORY")
    return said.select("query_id", "doc_id", "text", way.alias("route"), "c.page_number")


def page_answers(queries: DataFrame, chunks: DataFrame, model: Callable, **calls) -> DataFrame:
    """(query_id, doc_id, page_number) -> query_id, answer, chunk_ids: a summary with key points of the page, or of the nearest pages with content."""
    asked = queries.select("query_id", "doc_id", F.col("page_number").alias("page"))
    found = asked.join(inference.page_contents(asked.select("doc_id", "page").distinct(), chunks), ["doc_id", "page"])
    task = "Write SUMMARY: three to five sentences, and KEY_POINTS: a list of three to seven."
    told = _asked(found.withColumn("prompt", F.when(F.col("has_content"), inference.page_prompt(F.col("page"), F.col("text"), task, 4000))), model, **calls)
    told = told.withColumn("s", inference.parse_summary(F.coalesce("response", F.lit("")), 7))
    points = F.when(F.size("s.key_points") > 0, _said("\n\nKey points:\n", F.array_join(F.transform("s.key_points", lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    note = F.when(F.col("used_adjacent"), _said("\n\nFrom pages ", F.array_join(F.col("pages_used").cast("array<string>"), ", "), ", as the page holds nothing itself.")).otherwise("")
    answer = F.when(~F.col("has_content"), NO_CONTENT).when(F.col("response").isNull(), NO_ANSWER).otherwise(F.concat("s.summary", points, note))
    return told.select("query_id", answer.alias("answer"), F.coalesce(F.col("chunk_ids").cast(NO_INTS), F.array().cast(NO_INTS)).alias("chunk_ids"))


def history_answers(queries: DataFrame, model: Callable, history: DataFrame | None, **calls) -> DataFrame:
    """(query_id, text) -> query_id, answer, chunk_ids (none): from the earlier messages alone."""
    if history is None:
        told = queries.withColumns({"history": F.lit(None).cast("string"), "response": F.lit(None).cast("string")})
    else:
        past = inference.full_history_text(history.withColumnRenamed("query_id", "session_id")).withColumnRenamed("session_id", "query_id")
        told = _asked(queries.join(past, "query_id", "left").withColumn("prompt", _said(F.col("history"), "\n\nQuestion: ", F.col("text"), "\n\nAnswer from these messages alone.")), model, **calls)
    answer = F.when(F.col("history").isNull(), NO_HISTORY).when(F.col("response").isNull(), NO_ANSWER).otherwise(strip(F.col("response")))
    return told.select("query_id", answer.alias("answer"), F.array().cast(NO_INTS).alias("chunk_ids"))


def _scored(found: retrieval.Pass, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, id, place, score: a seed's similarity, a reranked chunk's likeness to its seed."""
    labelled = retrieval.provenance(found.used, found.seed, found.grown)
    return labelled.select("query_id", "id", "place", F.coalesce("similarity_score", "rerank_score").alias("score")).join(queries.select("query_id", "doc_id"), "query_id")


def retrieve(queries: DataFrame, corpus: Corpus, model: Callable, embed: Embedding, most_passes: int = retrieval.MOST_PASSES, **calls) -> tuple[DataFrame, DataFrame]:
    """(context: query_id, doc_id, id, place, score; passes: query_id, passes) of queries, in rounds over those that still need more.

    A round retrieves for the queries left, asks the model whether that answers them, and goes on with those for which it gives a new query, until none is
    left or ``most_passes`` are made. Later passes take the new query's seeds and the expansions of the first. A query's context is that of its last pass that found anything.
    """
    vecs = corpus.vectors.withColumnRenamed("chunk_index", "id")
    active = queries.select("query_id", "doc_id", "text")
    found = retrieval.first_pass(embed(active), vecs, corpus.edges)
    grown, context, passes = found.grown, stored(_scored(found, queries), "context"), active.select("query_id", F.lit(1).alias("passes"))
    latest = context
    for n in range(1, most_passes):
        task = "\n\nDo these chunks answer the question?\nReply NEEDS_MORE: YES or NO, and RELATED_QUERY: one query or None."
        shown = inference.context_prompts(latest, corpus.chunks, 12).join(active, "query_id")
        said = _asked(shown.select("query_id", "doc_id", _said("Question: ", F.col("text"), "\n\n", F.col("context"), task).alias("prompt")), model, **calls)
        parsed = said.withColumn("m", inference.parse_more(F.coalesce("response", F.lit(""))))
        more = parsed.where(retrieval.next_step(F.lit(n), F.col("m.needs_more"), F.col("m.new_query")) == "second_retrieval")
        active = stored(more.select("query_id", "doc_id", F.col("m.new_query").alias("text")), "active")
        if active.isEmpty():
            break
        again = retrieval.later_pass(embed(active), vecs, grown)
        latest = stored(_scored(again, active), "context")
        context = context.join(latest.select("query_id").distinct(), "query_id", "left_anti").unionByName(latest)
        passes = passes.join(active.select("query_id"), "query_id", "left_anti").unionByName(active.select("query_id", F.lit(n + 1).alias("passes")))
    return stored(context, "context"), passes


def grounded_answers(queries: DataFrame, context: DataFrame, chunks: DataFrame, model: Callable, **calls) -> DataFrame:
    """(query_id, doc_id, text) and their context -> query_id, answer, chunk_ids: answered from up to 15 chunks, and grounded in these only."""
    task = "\n\nAnswer the question from these chunks alone."
    used = context.where(F.col("place") <= retrieval.MOST_CHUNKS)
    shown = queries.join(inference.context_prompts(used, chunks, retrieval.MOST_CHUNKS), "query_id", "left")
    told = _asked(shown.select("query_id", "doc_id", "context", _said("Question: ", F.col("text"), "\n\n", F.col("context"), task).alias("prompt")), model, **calls)
    answer = F.when(F.col("context").isNull(), NO_CHUNKS).when(F.col("response").isNull(), NO_ANSWER).otherwise(inference.clean_answer(F.col("response")))
    told = told.select("query_id", F.col("response").isNotNull().alias("made"), answer.alias("answer"))
    seen = used.join(chunks.select("doc_id", F.col("chunk_index").alias("id"), "content"), ["doc_id", "id"]).select(F.col("query_id").alias("doc_id"), F.col("id").alias("chunk_index"), "content")
    texts = told.where("made").select(F.col("query_id").alias("text_id"), F.col("query_id").alias("doc_id"), F.col("answer").alias("text"))
    cited = grounding.answer_chunks(texts, seen).select(F.col("text_id").alias("query_id"), "chunk_ids")  # a query is its own document here: its context is all there is
    return told.join(cited, "query_id", "left").select("query_id", "answer", F.coalesce(F.col("chunk_ids").cast(NO_INTS), F.array().cast(NO_INTS)).alias("chunk_ids"), "made")


def answer(
    queries: DataFrame, corpus: Corpus, model: Callable, history: DataFrame | None = None, embed: Embedding | None = None, most_passes: int = retrieval.MOST_PASSES, **calls
) -> DataFrame:
    """(query_id, doc_id, text) -> query_id, doc_id, route, passes, answer, chunk_ids, references, questions.

    Each query is classed by the model, and goes one of three ways: a summary of a page, an answer from its earlier messages (``history``: query_id, id, role,
    content, chunks), or retrieval in up to ``most_passes`` passes, an answer from what the last one found, the chunks among these that support it, and
    follow-up questions. ``calls`` are options of ``inference.complete``. Every step is one set-based stage for all queries that go that way; responses are written
    before they are read. A failed call costs its query that step only, and an answer that can't be made is a fixed text without references.
    """
    if embed is None:
        width = corpus.vectors.select(F.size("vec").alias("n")).head()
        embed = hashed(width["n"] if width else 64)
    asked = stored(queries.select("query_id", "doc_id", "text"), "queries")
    routed = stored(classify(asked, model, history, **calls), "routed")
    of = lambda way: routed.where(F.col("route") == way)
    search = of("normal_retrieval")
    context, passes = retrieve(search, corpus, model, embed, most_passes, **calls)
    found = stored(grounded_answers(search, context, corpus.chunks, model, **calls), "answers")
    task = "\n\nPropose three to seven short questions that might follow, one per line after a dash."
    talk = found.where("made").join(search.select("query_id", "text"), "query_id")
    next_said = _asked(talk.select("query_id", _said("Question: ", F.col("text"), "\n\nAnswer: ", F.col("answer"), task).alias("prompt")), model, **calls)
    listed = inference.follow_up_questions(next_said.where("response IS NOT NULL").select("query_id", "response"))
    questions = listed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "question"))), lambda x: x["question"]).alias("questions"))
    parts = [found.drop("made"), page_answers(of("summarize_page"), corpus.chunks, model, **calls), history_answers(of("use_history"), model, history, **calls)]
    answers = functools.reduce(DataFrame.unionByName, parts).join(routed.select("query_id", "doc_id", "route"), "query_id").join(passes, "query_id", "left").join(questions, "query_id", "left")
    return answers.select(
        "query_id", "doc_id", "route", F.coalesce("passes", F.lit(0)).alias("passes"), "answer", "chunk_ids", grounding.format_references(F.col("chunk_ids")).alias("references"),
        F.coalesce("questions", F.array().cast("array<string>")).alias("questions"),
    )
