"""Streams: the daily usage rollup, documents as they arrive, and the latest event of each document."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docgraph.operators.usage import KINDS
from docgraph.sources.ledger import exists, replace_rows


def usage_stream(spark: SparkSession, path: str, schema, file_format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Events of a folder as files land in it; ts becomes a timestamp, which a watermark needs."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_rollup(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, phase, step, tokens and events per day, bounded by a watermark; in append mode closed days only."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "phase", "step")
    return windows.agg(*[F.sum(k).alias(k) for k in KINDS], F.count("*").alias("events")).select(F.to_date("window.start").alias("day"), "phase", "step", *KINDS, "events")


def latest_events(events: DataFrame, key: str = "document_id") -> DataFrame:
    """document_id and its last event, by time and then by number: of a table, or of a batch of a stream."""
    row = F.struct(*[c for c in events.columns if c != key])
    return events.groupBy(key).agg(F.max_by(row, F.struct("ts", "event_id")).alias("e")).select(key, "e.*")


def _batch_name(checkpoint: str, number: int) -> str:
    """A batch's name in a ledger; another checkpoint counts its batches anew, so it is part of the name."""
    return f"{zlib.crc32(checkpoint.encode()):08x}-{number}"


def write_closed(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Put what a stream gives out in append mode into ``path``, a folder per batch; a batch that is run again overwrites its own folder only.

    A windowed aggregate gives out each window once, when the watermark has passed its end; its state is dropped then, and so are events that come later.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={_batch_name(checkpoint, number)}")

    return result.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_rollup(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a whole rollup at ``path``, days that are still open too: each batch writes what the aggregate has by then in place of what was there.

    In complete mode no event is too late. The state is the result's rows (days by phases and steps), which grow with the days and not with the events.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return result.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_latest(events: DataFrame, path: str, checkpoint: str, key: str = "document_id") -> StreamingQuery:
    """Keep the latest event of each key in the stored table at ``path``.

    The table is the only state: a batch's own latest events are compared with those that its keys have there, and the buckets of keys that have a later
    one now are rewritten, by a ledger, so a batch that is run again changes nothing. An event that comes late is kept out by its time, however late.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest_events(batch, key)
        if exists(spark, f"{path}/_layout"):
            old = spark.read.parquet(path).select(key, F.struct("ts", "event_id").alias("_known"))
            new = new.join(old, key, "left").where(F.col("_known").isNull() | (F.struct("ts", "event_id") > F.col("_known"))).drop("_known")
        replace_rows(new, path, key, batch=_batch_name(checkpoint, number))

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def build_documents(docs: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Run a batch function over newly landed documents and put its rows in place of theirs; a document for which it gives none now loses its rows.

    The function runs once per batch. A batch that is run again after a failure changes nothing if it was done, and otherwise goes on.
    """

    def each(batch: DataFrame, number: int) -> None:
        replace_rows(build(batch), path, key, batch.select(key), _batch_name(checkpoint, number))

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
