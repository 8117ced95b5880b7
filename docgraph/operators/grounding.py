"""Links from sentences back to the chunks that support them, and citation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.text import sentences, tokens


def _overlaps(asked: DataFrame, chunks: DataFrame, keys: list[str], longer_than: int) -> DataFrame:
    """keys, chunk_index, n (tokens asked for), score: an equal join on document and token, then a count.

    Both sides are distinct (row, token) lists; the join is on the exploded token, never on all pairs of rows.
    """
    wanted = asked.withColumn("tokens", tokens(F.col("text"), longer_than)).withColumn("n", F.size("tokens"))
    have = chunks.select("doc_id", "chunk_index", F.explode(tokens(F.col("content"), longer_than)).alias("token"))
    pairs = wanted.select("doc_id", *keys, "n", F.explode("tokens").alias("token")).join(have, ["doc_id", "token"])
    counted = pairs.groupBy("doc_id", *keys, "chunk_index").agg(F.count("*").alias("overlap"), F.max("n").alias("n"))
    return counted.withColumn("score", F.col("overlap") / F.greatest(F.col("n"), F.lit(1)))


def supporting_chunks_by_sentence(texts: DataFrame, chunks: DataFrame, top_k: int = 2, at_least: float = 0.1) -> DataFrame:
    """text_id, doc_id, sentence_no, chunk_index, score, rank: the best chunks of each sentence, ties in chunk order.

    texts: (text_id, doc_id, text); chunks: (doc_id, chunk_index, content). A sentence has more than 10 characters, a token more than 2.
    """
    asked = texts.select("text_id", "doc_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "text"))
    scored = _overlaps(asked, chunks, ["text_id", "sentence_no"], 2).where(F.col("score") >= at_least)
    order = Window.partitionBy("text_id", "doc_id", "sentence_no").orderBy(F.desc("score"), "chunk_index")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("text_id", "doc_id", "sentence_no", "chunk_index", "score", "rank")


def supporting_chunks(texts: DataFrame, chunks: DataFrame, top_k: int = 2, at_least: float = 0.1) -> DataFrame:
    """text_id, doc_id, chunk_ids: the sorted union over a text's sentences; empty where nothing supports it."""
    found = supporting_chunks_by_sentence(texts, chunks, top_k, at_least).groupBy("text_id", "doc_id").agg(F.sort_array(F.collect_set("chunk_index")).alias("chunk_ids"))
    return texts.select("text_id", "doc_id").join(found, ["text_id", "doc_id"], "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<int>")))


def answer_chunks(answers: DataFrame, context: DataFrame, top_k: int = 4) -> DataFrame:
    """text_id, doc_id, chunk_ids: the best chunks of a whole answer in rank order; all of its context where none shares a token."""
    scored = _overlaps(answers, context, ["text_id"], 0)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("text_id", "doc_id").orderBy(F.desc("score"), "chunk_index"))).where(F.col("rank") <= top_k)
    found = ranked.groupBy("text_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_index"))), lambda x: x["chunk_index"]).alias("found"))
    every = context.groupBy("doc_id").agg(F.sort_array(F.collect_list("chunk_index")).alias("every"))
    return answers.select("text_id", "doc_id").join(found, ["text_id", "doc_id"], "left").join(every, "doc_id", "left").select("text_id", "doc_id", F.coalesce("found", "every").alias("chunk_ids"))


def format_references(ids: Column) -> Column:
    """``^[C1,C5]``, sorted and distinct; empty for none."""
    known = F.sort_array(F.array_distinct(ids))
    return F.when(F.size(known) > 0, F.concat(F.lit("^["), F.array_join(F.transform(known, lambda i: F.concat(F.lit("C"), i)), ","), F.lit("]"))).otherwise("")


def extract_references(text: Column) -> Column:
    """Sorted distinct ids of all ``^[...]`` groups."""
    groups = F.regexp_extract_all(text, F.lit(r"\^\[([^\]]+)\]"), F.lit(1))
    ids = F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.regexp_extract(x, r"^\s*C(\d+)\s*$", 1))
    return F.sort_array(F.array_distinct(F.transform(F.filter(ids, lambda x: x != ""), lambda x: x.cast("int"))))


def union_references(texts: DataFrame, key: str) -> DataFrame:
    """key, chunk_ids over all texts of a key."""
    return texts.select(key, F.explode(extract_references(F.col("text"))).alias("id")).groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("chunk_ids"))


def cited_in_order(text: Column) -> Column:
    """Ids of ``[C12]`` marks by first appearance, in either case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[C(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def expand_groups(text: Column) -> Column:
    """``^[C1,C5]`` and ``[C1,C5]`` as ``[C1] [C5]``.

    The text is split at the groups, which have no nesting; each group is rewritten and all is put together again.
    """
    group = r"\^?\[C\d+(?:\s*,\s*C\d+)*\]"
    between = F.split(text, group, -1)
    groups = F.regexp_extract_all(text, F.lit(f"({group})"), F.lit(1))
    written = F.transform(groups, lambda g: F.array_join(F.transform(F.regexp_extract_all(g, F.lit(r"C(\d+)"), F.lit(1)), lambda i: F.concat(F.lit("[C"), i, F.lit("]"))), " "))
    return F.array_join(F.zip_with(between, written, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def strip_groups(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\^?\[C\d+(?:\s*,\s*C\d+)*\]", ""))
