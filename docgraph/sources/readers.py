"""Readers of document folders, stored artifacts, logs and tables. A document's folder is its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.sources import schemas
from docgraph.sources.shared import stored

#: The preferred names of artifacts that come in several versions.
UNIFIED, ALTERNATIVE = "unified", "enhanced"


def _path():
    """A file's path as it is written, without the escapes of an address."""
    raw = F.col("_metadata.file_path")
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def _folder(depth: int = 2):
    """The folder ``depth`` parts from the end of a file's path."""
    return F.element_at(F.split(_path(), "/"), -depth)


def listing(spark: SparkSession, root: str, pattern: str, depth: int = 2) -> DataFrame:
    """doc_id, path, modified, length of files by name; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(_folder(depth).alias("doc_id"), _path().alias("path"), F.col("modificationTime").alias("modified"), "length")


def chosen_only(files: DataFrame, listed: DataFrame, chosen: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``files`` (with a column path) that are in ``chosen``, a part of ``listed``.

    Most files are chosen as a rule, so what is left out is what goes to the tasks, if it isn't over ``broadcast_rows`` paths; nothing at all if there is none. So
    contents aren't shuffled. Beyond that, they are, once, by their path.
    """
    out = stored(listed.select("path").join(chosen.select("path"), "path", "left_anti"), "left-out")
    n = out.count()
    return files if not n else files.join(F.broadcast(out) if n <= broadcast_rows else out, "path", "left_anti")


def markdown_files(spark: SparkSession, root: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, name, markdown: the first markdown file, by path, of each folder under ``root``.

    Which file is first is settled on a listing of names; then the texts are read where they are.
    """
    listed = listing(spark, root, "*.md")
    first = listed.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))).where("k = 1")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select("value", _path().alias("path"), _folder().alias("doc_id"))
    return chosen_only(files, listed, first, broadcast_rows).select("doc_id", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), F.col("value").alias("markdown"))


def _json(spark: SparkSession, root: str, pattern: str, schema: str, lines: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return (reader if lines else reader.option("multiLine", True)).json(root).withColumn("doc_id", _folder())


def page_mappings(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, root, "*_page_mapping.json", schemas.PAGE_MAPPING)


def with_page_mapping(docs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Documents with their mapping; null where there is none."""
    return docs.join(mappings.select("doc_id", "line_to_page", "total_pages"), "doc_id", "left")


def stored_chunks(spark: SparkSession, root: str, pattern: str = "*chunks*.json") -> DataFrame:
    """Chunks with their lines (raw_lines) and text (content)."""
    rows = _json(spark, root, pattern, schemas.CHUNK)
    return rows.withColumn("raw_lines", F.col("content")).withColumn("content", F.array_join("content", "\n"))


def stored_graph(spark: SparkSession, root: str, pattern: str = "*graph*.json") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with their doc_id."""
    rows = _json(spark, root, pattern, schemas.GRAPH)
    return rows.select("doc_id", F.inline("nodes")), rows.select("doc_id", F.inline("edges"))


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines with ts as a timestamp and their date; blank and malformed lines are left out."""
    rows = spark.read.schema(schemas.USAGE + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad IS NULL AND timestamp IS NOT NULL").drop("_bad").withColumn("ts", F.try_to_timestamp("timestamp")).withColumn("date", F.to_date("ts"))


def confidence(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(scores per document, scores per page)."""
    rows = _json(spark, root, "*_confidence.json", schemas.CONFIDENCE)
    pages = rows.select("doc_id", F.explode("pages").alias("page", "s")).select("doc_id", F.col("page").try_cast("int").alias("page_number"), "s.*").where("page_number IS NOT NULL")
    return rows.drop("pages"), pages


def page_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Valid stored page ranges in order."""
    from docgraph.operators.catalog import page_ranges as valid

    return valid(_json(spark, root, "*page_ranges*.json", schemas.PAGE_RANGE).withColumnRenamed("doc_id", "document_id"))


def overviews(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, root, "*overview*.json", schemas.OVERVIEW).withColumnRenamed("doc_id", "document_id")


def duplicate_reports(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, total_pages, pages, score, a row per entry."""
    return _json(spark, root, "*duplicates*.json", schemas.DUPLICATES).select("doc_id", "total_pages", F.inline("duplicates"))


def newest_artifacts(files: DataFrame, kinds: tuple[str, ...] = (UNIFIED, ALTERNATIVE)) -> DataFrame:
    """(doc_id, kind, path, modified) -> the one of each document and kind: a preferred name first, in the order of ``kinds``, then the latest, then the first path."""
    name = F.element_at(F.split("path", "/"), -1)
    priority = F.lit(len(kinds))
    for k, word in reversed(list(enumerate(kinds))):
        priority = F.when(name.contains(word), k).otherwise(priority)
    order = Window.partitionBy("doc_id", "kind").orderBy(priority, F.desc("modified"), "path")
    return files.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def artifact_files(spark: SparkSession, root: str, pattern: str, kind: str) -> DataFrame:
    """doc_id, kind, path, modified of files by name, without opening them."""
    return listing(spark, root, pattern).select("doc_id", F.lit(kind).alias("kind"), "path", "modified")


def newest_graphs(spark: SparkSession, root: str, pattern: str = "*graph*.json") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each document's newest graph file; older ones are left out by their names and times."""
    listed = artifact_files(spark, root, pattern, "graph")
    rows = _json(spark, root, pattern, schemas.GRAPH).withColumn("path", _path())
    kept = chosen_only(rows, listed, newest_artifacts(listed))
    return kept.select("doc_id", F.inline("nodes")), kept.select("doc_id", F.inline("edges"))


def newest_chunks(spark: SparkSession, root: str, pattern: str = "*chunks*.json") -> DataFrame:
    """``stored_chunks`` of each document's newest file."""
    listed = artifact_files(spark, root, pattern, "chunks")
    return chosen_only(stored_chunks(spark, root, pattern).withColumn("path", _path()), listed, newest_artifacts(listed)).drop("path")


def relational(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database (``jdbc:...``) or a Parquet table under a path."""
    if url.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return spark.read.parquet(f"{url.rstrip('/')}/{name}")
