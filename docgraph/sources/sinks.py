"""Sinks. Tables are partitioned by a hash bucket of the document, never by the document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.sources.ledger import BUCKETS, bucketed, dealt, layout

#: Order in which edges come to a graph: of those between the same two nodes, the last one stays.
RELATIONS = ("contains_section", "contains", "belongs_to", "on_page", "follows", "similar_to")


def write_by_document(df: DataFrame, path: str, key: str = "doc_id", buckets: int = BUCKETS, files: int = 1) -> None:
    """Overwrite the buckets that ``df`` has rows of; other buckets stay. ``df`` holds all rows of its buckets.

    A bucket is written by up to ``files`` tasks, a document by one of them. Take more of both for larger tables: the first write fixes both
    numbers for the table, and later ones go by these.
    """
    buckets, files = layout(df.sparkSession, path, buckets, files)
    dealt(bucketed(df, key, buckets), key, files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    write_by_document(chunks, path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(doc_id, chunk_index, embedding); a failed task is run again, so there is no other way for single rows."""
    write_by_document(vectors, path)


def last_edges(edges: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """One edge of each (doc_id, source, target): that of the last relation in ``relations`` (unknown ones first), then the highest similarity."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, relations)), F.col("relation")), F.lit(0))
    rest = [c for c in edges.columns if c not in ("doc_id", "source", "target")]
    best = F.max_by(F.struct(*rest), F.struct(rank.alias("rank"), F.col("similarity"), F.col("relation"))).alias("e")
    return edges.groupBy("doc_id", "source", "target").agg(best).select("doc_id", "source", "target", *[F.col(f"e.{c}").alias(c) for c in rest]).select(*edges.columns)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, relations: tuple[str, ...] = RELATIONS) -> None:
    """Two tables; of equal (source, target) the last relation stays (``last_edges``), as a graph has one edge there."""
    write_by_document(nodes, f"{path}/nodes")
    write_by_document(last_edges(edges, relations), f"{path}/edges")


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON object per document."""
    pack = lambda df, name: df.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "doc_id"])).alias(name))
    pack(nodes, "nodes").join(pack(edges, "edges"), "doc_id", "left").write.mode("overwrite").json(path)


def append_usage(events: DataFrame, path: str, files: int = 8) -> None:
    """Append to a log that is partitioned by day; a day is written by up to ``files`` tasks, dealt by a hash of the whole event."""
    dated = events.withColumn("date", F.to_date("ts"))
    dated.repartition("date", F.pmod(F.xxhash64(*events.columns), F.lit(files))).write.mode("append").partitionBy("date").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Duplicate reports, page mappings, summaries or overviews as JSON lines."""
    reports.write.mode("overwrite").json(path)
