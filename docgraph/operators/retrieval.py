"""Retrieval for a table of queries: seeds, expansion, rerank, ordered unions and reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.text import distance_to_similarity
from docgraph.operators.graph import expand, expand_prioritized
from docgraph.operators.vectors import nearest, rerank
from docgraph.sources.shared import stored

#: How much a retrieval takes.
SEEDS, EXPANDED_SEEDS, PER_SEED, RERANKED, MOST_CHUNKS, MOST_PASSES = 5, 2, 10, 5, 15, 3


def route(is_page_summary: Column, page_number: Column, is_history: Column) -> Column:
    return F.when(is_page_summary & (page_number > 0), "summarize_page").when(is_history, "use_history").otherwise("normal_retrieval")


def seeds(queries: DataFrame, vectors: DataFrame, k: int = SEEDS, scale: float = 150.0) -> DataFrame:
    """query_id, doc_id, id, distance, rank, score."""
    return nearest(queries, vectors, k).withColumn("score", distance_to_similarity(F.col("distance"), scale))


def seed_expansions(found: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, seed_rank, id, score, rank: the reranked expansion of each of a query's best seeds."""
    key = F.concat_ws(":", "query_id", "rank")
    best = found.where(F.col("rank") <= EXPANDED_SEEDS).select(key.alias("key"), "query_id", F.col("rank").alias("seed_rank"), "doc_id", "id")
    grown = expand_prioritized(best.select(F.col("key").alias("query_id"), "doc_id", F.col("id").alias("chunk_id")), edges, PER_SEED)
    ranked = rerank(best.select(F.col("key").alias("query_id"), "doc_id", "id"), grown.select("query_id", F.col("chunk_id").alias("id")), vectors, RERANKED)
    return ranked.withColumnRenamed("query_id", "key").join(best.select("key", "query_id", "seed_rank"), "key").select("query_id", "seed_rank", "id", "score", "rank")


def ordered_union(parts: list[DataFrame], most: int = MOST_CHUNKS) -> DataFrame:
    """(query_id, id, rank) tables, one after another: each id by its first occurrence, ``most`` at most. query_id, id, stage, place."""
    union = None
    for k, p in enumerate(parts):
        p = p.select("query_id", "id", F.struct(F.lit(k).alias("stage"), F.col("rank").alias("rank")).alias("at"))
        union = p if union is None else union.unionByName(p)
    first = union.groupBy("query_id", "id").agg(F.min("at").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))).where(F.col("place") <= most).select("query_id", "id", F.col("at.stage").alias("stage"), "place")


class Pass(NamedTuple):
    """A retrieval's chunks (query_id, id, stage, place), seeds and expansions (query_id, id, score, rank; expansions with seed_rank)."""

    used: DataFrame
    seed: DataFrame
    grown: DataFrame


def _joined(found: DataFrame, grown: DataFrame) -> Pass:
    return Pass(ordered_union([found, *[grown.where(F.col("seed_rank") == k) for k in range(1, EXPANDED_SEEDS + 1)]]), found, grown)


def first_pass(queries: DataFrame, vectors: DataFrame, edges: DataFrame) -> Pass:
    """Seeds, then the expansion of the first and of the second. Both are written once, as later steps read them again."""
    found = stored(seeds(queries, vectors), "seeds")
    return _joined(found, stored(seed_expansions(found, edges, vectors), "grown"))


def later_pass(new_queries: DataFrame, vectors: DataFrame, grown: DataFrame) -> Pass:
    """Seeds of the new query, then the expansions that the first pass made, for the queries asked."""
    asked = new_queries.select("query_id")
    return _joined(stored(seeds(new_queries, vectors), "seeds"), grown.join(asked, "query_id", "left_semi"))


def initial_retrieval(queries: DataFrame, vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, id, stage, place of the first pass."""
    return first_pass(queries, vectors, edges).used


def second_retrieval(new_queries: DataFrame, vectors: DataFrame, grown: DataFrame) -> DataFrame:
    """query_id, id, stage, place of a later pass, with all expansions in ``grown``."""
    return _joined(seeds(new_queries, vectors), grown).used


def seed_quality(found: DataFrame, at_least: float = 0.3) -> DataFrame:
    """query_id, n_seeds, n_good."""
    return found.groupBy("query_id").agg(F.count("*").alias("n_seeds"), F.count_if(F.col("score") >= at_least).alias("n_good"))


def next_step(iterations: Column, needs_more: Column, new_query: Column) -> Column:
    return F.when(iterations >= MOST_PASSES, "generate_answer").when(needs_more & (F.coalesce(new_query, F.lit("")) != ""), "second_retrieval").otherwise("generate_answer")


def answer_context(first: DataFrame, second: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """(query_id, id, place) of the second pass where a query has one, else of the first."""
    only = first.join(second.select("query_id").distinct(), "query_id", "left_anti")
    return only.select("query_id", "id", "place").unionByName(second.select("query_id", "id", "place")).where(F.col("place") <= most)


def search(queries: DataFrame, vectors: DataFrame, edges: DataFrame, limit: int = 15) -> DataFrame:
    """Search without an answer: the 20 nearest, then what the best five reach, by as many steps as it takes for 15; query_id, id, stage, place."""
    found = stored(nearest(queries, vectors, 20), "nearest")
    grown = expand(found.where("rank <= 5").select("query_id", "doc_id", F.col("id").alias("chunk_id")), edges, most=15)
    return ordered_union([found, grown.select("query_id", F.col("chunk_id").alias("id"), "rank")], limit)


def provenance(used: DataFrame, seed: DataFrame, grown: DataFrame, second: Pass | None = None, page_summary: DataFrame | None = None) -> DataFrame:
    """query_id, id, place, source, similarity_score, rerank_score of each chunk that a query has retrieved.

    Sources are seed, graph_expanded and initial; chunks that only the ``second`` pass found follow as second_seed, second_expanded
    and second_retrieval; ``page_summary`` (query_id, id) are the chunks of queries that summarize a page, by their number.
    """
    labelled = _labelled(Pass(used, seed, grown), "seed", "graph_expanded", "initial")
    if second is not None:
        before = used.groupBy("query_id").agg(F.max("place").alias("before"))
        late = _labelled(second._replace(used=second.used.join(used, ["query_id", "id"], "left_anti")), "second_seed", "second_expanded", "second_retrieval")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "id")) + F.coalesce("before", F.lit(0))
        labelled = labelled.unionByName(late.join(before, "query_id", "left").withColumn("place", place).drop("before"))
    if page_summary is not None:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
        none = F.lit(None).cast("double")
        labelled = labelled.unionByName(page_summary.select("query_id", "id", place.alias("place"), F.lit("page_summary").alias("source"), none.alias("similarity_score"), none.alias("rerank_score")))
    return labelled


def _labelled(found: Pass, as_seed: str, as_grown: str, otherwise: str) -> DataFrame:
    used, seed, grown = found
    own = seed.select("query_id", "id", F.col("score").alias("similarity_score"))
    best = grown.groupBy("query_id", "id").agg(F.max("score").alias("rerank_score"))
    joined = used.join(own, ["query_id", "id"], "left").join(best, ["query_id", "id"], "left")
    source = F.when(F.col("similarity_score").isNotNull(), as_seed).when(F.col("rerank_score").isNotNull(), as_grown).otherwise(otherwise)
    return joined.select("query_id", "id", "place", source.alias("source"), "similarity_score", "rerank_score")


def retrieval_statistics(labelled: DataFrame, all_labels: bool = False) -> DataFrame:
    """query_id, total_chunks_used, seed_chunks, graph_expanded_chunks, reranked_chunks; with ``all_labels`` a count of each further label too."""
    more = ("second_seed", "second_expanded", "second_retrieval", "page_summary") if all_labels else ()
    return labelled.groupBy("query_id").agg(
        F.count("*").alias("total_chunks_used"), F.count_if(F.col("source") == "seed").alias("seed_chunks"), F.count_if(F.col("source") == "graph_expanded").alias("graph_expanded_chunks"), F.count("rerank_score").alias("reranked_chunks"),
        *[F.count_if(F.col("source") == x).alias(f"{x}_chunks") for x in more],
    )


def only_grounded(used: DataFrame, grounded: DataFrame) -> DataFrame:
    """Chunks of ``used`` that (query_id, chunk_ids) names, in that order: query_id, id, place."""
    ids = grounded.select("query_id", F.posexplode("chunk_ids").alias("p", "id"))
    return used.select("query_id", "id").join(ids, ["query_id", "id"]).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("p"))).drop("p")


def lookup(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(request_id, doc_id, ids) -> the chunks asked for, each once, in the caller's order: request_id, place and the chunk's columns."""
    asked = requests.select("request_id", "doc_id", F.posexplode(F.array_distinct("ids")).alias("place", "chunk_index"))
    return asked.join(chunks, ["doc_id", "chunk_index"])
