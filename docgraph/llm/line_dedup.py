"""Repeated lines across documents: hashes in ranges, first occurrences kept, run-length bitmaps of kept lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import free_name, lower_ascii, materialize

#: Fixed value: the characters stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
KEEP = "array<struct<start:int,length:int>>"


def text_lines(text: Column) -> Column:
    """The lines of a text, parted by line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What equal lines share: stripped, A-Z in lower case. Pure ASCII takes the faster way to the same result."""
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(lower_ascii(bare))


def line_places(docs: DataFrame, least_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, position, h1, h2 of each line whose key has ``least_chars`` code points: where it is, and its key as 128 hash bits."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(text_lines(F.col(text_col))).alias("position", "line"))
    keyed = lines.where(F.length(F.btrim("line", F.lit(STRIPPED))) >= least_chars).withColumn("key", line_key(F.col("line")))
    return keyed.select("id", "text_hash", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def dropped_places(places: DataFrame, least_docs: int = 5) -> DataFrame:
    """id, text_hash, position of the lines that go: those of keys in ``least_docs`` documents or more, but for the largest id's.

    Rows are range-partitioned by hash and, within a hash, by falling id, so a range holds whole hashes or a stretch of a very common one,
    and the first row of a hash is the occurrence that stays. The sorted ranges are written with their number. What a hash has in all its
    ranges is added up from one partial row per range; the verdict then goes back to each of these ranges by (range, hash), so even a hash
    that a third of all lines share is never in one task.
    """
    of_document = Window.partitionBy("h1", "h2", "id").orderBy("text_hash", "position")  # the ranges satisfy it: no further shuffle
    ranged = places.repartitionByRange("h1", "h2", F.col("id").desc()).withColumn("first", F.row_number().over(of_document) == 1)
    shards = materialize(ranged.withColumn("range", F.spark_partition_id()), "lines")
    keys = shards.groupBy("h1", "h2").agg(F.count_if("first").alias("n_docs"), F.max("id").alias("keeper"), F.min("range").alias("from_range"), F.max("range").alias("to_range")).where(F.col("n_docs") >= least_docs)
    verdicts = keys.select("h1", "h2", "keeper", F.explode(F.sequence("from_range", "to_range")).alias("range"))
    return shards.join(verdicts, ["range", "h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "text_hash", "position")


def dropped_runs(places: DataFrame) -> DataFrame:
    """id, text_hash, n_dropped, runs: per document the stretches of dropped lines, in order."""
    in_document = Window.partitionBy("id", "text_hash").orderBy("position")
    islands = places.withColumn("island", F.col("position") - F.dense_rank().over(in_document)).groupBy("id", "text_hash", "island").agg(F.min("position").alias("start"), F.max("position").alias("last"))
    run = F.struct("start", (F.col("last") - F.col("start") + 1).alias("length"))
    return islands.groupBy("id", "text_hash").agg(F.sum(F.col("last") - F.col("start") + 1).alias("n_dropped"), F.sort_array(F.collect_list(run)).alias("runs"))


def kept_runs(runs: Column, n_lines: Column) -> Column:
    """The stretches between ``runs``."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(n_lines))
    return F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length"))), lambda r: r["length"] > 0).cast(KEEP)


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which lines of each document stay: id, text_hash, n_lines (before), n_dropped, keep, and the columns in ``carry``.

    ``keep`` is a bitmap of lines compressed to its runs of ones (start from 0, length), instead of text; ``kept_text`` applies it. A line
    goes if its key (stripped, A-Z lower-cased) has ``least_chars`` code points, ``least_docs`` documents or more hold it, and this document isn't
    the one of the largest id among them.

    Rows of one id are one document; those with null ids are one too, the smallest. Null and empty texts are one empty line, which stays.
    Every line of a text counts, however long; a line repeated in the document that keeps it stays there each time. Repeated rows
    get equal bitmaps. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    runs = dropped_runs(dropped_places(line_places(docs, least_chars, id_col, text_col), least_docs)).alias("r")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.size(text_lines(F.col(text_col))).alias("n_lines"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")).alias("d")
    joined = own.join(runs, F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.text_hash") == F.col("r.text_hash")), "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("length"))).cast(KEEP)
    keep = F.when(F.col("runs").isNull(), whole).otherwise(kept_runs(F.col("runs"), F.col("n_lines")))
    return joined.select(F.col("d.id").alias(id_col), F.col("d.text_hash").alias("text_hash"), F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), keep.alias("keep"), *[F.col("row").getField(c).alias(c) for c in carry])


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` that ``keep`` names, joined by line feeds."""
    chosen = F.transform(F.array(text_lines(text)), lambda ls: F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(ls, r["start"] + 1, r["length"]))), "\n"))
    return F.element_at(chosen, 1)


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``lines`` (n_lines, n_dropped, kept_text; underscores before its name if it is taken); see ``keep_bitmaps``."""
    name = free_name(docs, "lines")
    found = keep_bitmaps(docs.withColumn(name, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), least_chars, least_docs, (name,), id_col, text_col)
    text = F.col(name).getField(text_col)
    kept = F.when(F.col("n_dropped") == 0, F.coalesce(text, F.lit(""))).otherwise(kept_text(text, F.col("keep")))
    return found.select(*[F.col(name).getField(c).alias(c) for c in docs.columns], F.struct("n_lines", "n_dropped", kept.alias("kept_text")).alias(name))
