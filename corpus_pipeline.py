"""From raw documents to packed training windows, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``docs``, whatever others it has beside those of ``documents`` and whatever their names.
Every stage reads whole texts, however long, and gives an empty table for an empty one. Nulls, empty texts and
repeated rows are settled as each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import drop, kept_only, materialize, table
from docgraph.llm.jaccard import keep_one_of_each
from docgraph.llm.language import identify_language, train_language_model
from docgraph.llm.mixing import mixed_rows
from docgraph.llm.packing import pack_documents
from docgraph.llm.quality_model import keep_good, train_quality_model
from docgraph.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more.

    Null texts count as empty and are scored too; equal texts, and so repeated rows, share their fate; a tie with 0.5 stays.
    Labels of null ids take no part. Without labels of both kinds every document gets the one kind there is, and stays if there is none.
    """
    return keep_good(docs, train_quality_model(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a posterior of 0.5 or more.

    Null, empty and letterless texts go, as do texts in none of the declared languages. Null languages and sources are no evidence
    and a group of their own. Equal rows share their fate.
    """
    found = identify_language(docs, train_language_model(docs), F.col("text"), declared=F.col("lang"), host=F.col("source"))
    judgement = next(c for c in found.columns if c not in docs.columns)
    return found.where(F.col(judgement)["kept"]).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    The least id stays, of equal ids the least text hash; null ids come last. Repeated rows are one; texts without words all stay.
    """
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, documents repeated where the budget takes a second epoch.

    A null source is a source. Documents without words take no part in a budget and go. Repeated rows count each.
    """
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens: a row per piece.

    Null and empty texts are their end id alone; null ids stay null; repeated rows are packed as often as they come.
    """
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the fitted models and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again; what a stage has written besides is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with kept_only() as keep:
            kept = materialize(stage(spark, docs, sf_dir), name)
            keep.append(kept)
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
