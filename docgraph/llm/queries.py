"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.alignment import align_tokens, alignment_figures, tokens_of
from docgraph.llm.chat import conversation_digests, format_turns
from docgraph.llm.common import table
from docgraph.llm.jaccard import jaccard_components
from docgraph.llm.language import identify_language, train_language_model
from docgraph.llm.line_dedup import dedup_lines
from docgraph.llm.markup import declared_language, host_suffix, visible_text
from docgraph.llm.mixing import mix_sources
from docgraph.llm.packing import pack_documents
from docgraph.llm.pivot_search import exact_top_k, quantized, usable_vector
from docgraph.llm.quality_model import held_out, score_quality, train_quality_model
from docgraph.llm.quality_rules import base_metrics, default_rules, order_rules, quality_cascade
from docgraph.llm.source_audit import source_divergence
from docgraph.llm.token_counts import length_histogram, token_lengths
from docgraph.llm.url_filter import filter_urls, url_host


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The listed url prefixes of the url query, as host, path and verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: A conversation whose texts are made of control strings.
PLANTED_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(usable_vector(F.col("embedding"))).select("vec_id", quantized(F.col("embedding")).alias("embedding"))
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), shingle=3, at_least=(90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_cascade(base_metrics(docs), order_rules(docs, default_rules(F.col("text")), prepare=base_metrics))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*columns, (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED_TURNS, "conv_id long, turn long, role string, text string")
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    return conversation_digests(format_turns(turns.unionByName(planted), path), path)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text", "lang", "source"), train_language_model(docs), F.col("text"), declared=F.col("lang"), host=F.col("source"))
    return found.select("doc_id", "language.lang", F.round("language.posterior", 6).alias("posterior"), "language.text_lang", "language.kept")


def op8_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = url_host(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", visible_text(F.col("html")).alias("text"), declared_language(F.col("html")).alias("declared"), host.alias("host"), host_suffix(host).alias("suffix"))
    model = train_language_model(table(spark, sf_dir, "documents"))
    found = identify_language(pages, model, F.col("text"), declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"))
    return found.select("page_id", "language.lang", F.round("language.posterior", 6).alias("posterior"), "language.text_lang", "language.kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality_model(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.kept_text", 256).alias("kept_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment_figures(align_tokens(table(spark, sf_dir, "documents"), one, other), width=len(tokens_of(other).tokens))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_top_k": op1_pivot_top_k,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_format": op7_chat_format,
    "op8_language_id": op8_language_id,
    "op8_language_pages": op8_language_pages,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_source_audit": op11_source_audit,
    "op12_line_dedup": op12_line_dedup,
    "op13_alignment": op13_alignment,
}
