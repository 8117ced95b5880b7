"""Stored tables that change by batches: rows of some keys are replaced or deleted, bucket by bucket, safe to stop and to repeat.

A table is a folder of buckets (``bucket=<n>``, a hash of the key). Beside them lie ``_layout`` (number of buckets and of files in each),
``_staged`` (buckets of a batch that aren't in place yet) and ``_ledger`` (a table per batch: its keys and their buckets). Spark's readers skip
all three. One writer at a time changes a table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.sources.shared import delete_path, discard, stored

BUCKETS = 64


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is no such folder."""
    files, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def _move(spark: SparkSession, path: str, to: str) -> None:
    files, place = _place(spark, path)
    target = _place(spark, to)[1]
    files.mkdirs(target.getParent())
    if not files.rename(place, target):
        raise OSError(f"can't move {path} to {to}")


def layout(spark: SparkSession, path: str, buckets: int = BUCKETS, files: int = 1) -> tuple[int, int]:
    """(buckets, files in each) of a table: as its first write has fixed them, and these at that first write."""
    if not (known := names(spark, f"{path}/_layout")):
        known = [f"{buckets}-{files}"]
        system, place = _place(spark, f"{path}/_layout/{known[0]}")
        system.mkdirs(place)
    return tuple(map(int, known[0].split("-")))


def bucketed(df: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def dealt(df: DataFrame, key: str, files: int) -> DataFrame:
    """Rows with a bucket, dealt so that each bucket is written by up to ``files`` tasks and a key by one of them."""
    return df.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(7)), F.lit(files)))


def replace_rows(new: DataFrame, path: str, key: str = "doc_id", ids: DataFrame | None = None, batch: str | None = None, buckets: int = BUCKETS, files: int = 1) -> bool:
    """Put the rows of ``new`` in place of those that the table at ``path`` holds for the keys in ``ids``; those of ``new`` are among these in any case.

    A key in ``ids`` without rows in ``new`` loses its rows. A batch whose name is in the ledger is done already and changes nothing (False is returned).
    ``new`` is evaluated once. Only buckets of these keys are read and written. All is staged first; once the staged folder bears the batch's name the
    batch holds, and whoever comes next puts the rest of its buckets in place (``finish``). Stopped before that, it leaves the table as it was.
    Rows with a null key are added, never replaced.
    """
    spark = new.sparkSession
    finish(spark, path)
    batch = batch or uuid.uuid4().hex
    if exists(spark, f"{path}/_ledger/{batch}"):
        return False
    buckets, files = layout(spark, path, buckets, files)
    fresh = stored(bucketed(new, key, buckets), "fresh")
    keys = fresh.select(key) if ids is None else fresh.select(key).unionByName(ids.select(key))
    gone = stored(bucketed(keys.distinct(), key, buckets), "gone")
    touched = [r[0] for r in gone.select("bucket").distinct().collect()]  # at most as many as there are buckets
    merged = fresh
    if any(n.startswith("bucket=") for n in names(spark, path)):
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        merged = old.join(gone.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
    staged = f"{path}/_staged/{batch}"
    dealt(merged, key, files).write.partitionBy("bucket").parquet(f"{staged}.tmp")
    filled = [int(n.removeprefix("bucket=")) for n in names(spark, f"{staged}.tmp") if n.startswith("bucket=")]
    gone.withColumn("filled", F.col("bucket").isin(filled)).write.parquet(f"{path}/_ledger/{batch}")
    _move(spark, f"{staged}.tmp", staged)  # from here on the batch holds
    finish(spark, path)
    discard(fresh, gone)
    return True


def finish(spark: SparkSession, path: str) -> None:
    """Put staged buckets in place, and drop what was staged of batches that didn't get so far. Done again, it goes on where it was stopped."""
    for name in names(spark, f"{path}/_staged"):
        staged = f"{path}/_staged/{name}"
        if name.endswith(".tmp"):
            delete_path(spark, f"{path}/_ledger/{name.removesuffix('.tmp')}")
        else:
            for bucket, filled in spark.read.parquet(f"{path}/_ledger/{name}").select("bucket", "filled").distinct().collect():
                target, source = f"{path}/bucket={bucket}", f"{staged}/bucket={bucket}"
                if not filled:
                    delete_path(spark, target)
                elif exists(spark, source):
                    delete_path(spark, target)
                    _move(spark, source, target)
        delete_path(spark, staged)


@dataclass(frozen=True)
class Stored:
    """A stored table in a cascade: its folder and key; ``via`` is a parent's (folder, column that names the document, column that this key points to)."""

    path: str
    key: str = "document_id"
    via: tuple[str, str, str] | None = None


def delete_cascade(gone: DataFrame, tables: list[Stored], batch: str | None = None) -> None:
    """Delete documents (the first column of ``gone``) from stored tables, in the order given: children before the parents that they are found by.

    Only buckets that hold rows of these documents are rewritten. With a ``batch`` name, a cascade that was stopped can be run again as a
    whole: tables that are done are left alone, and a parent still has the rows that its children are found by until they are gone.
    """
    spark = gone.sparkSession
    document = gone.columns[0]
    for table in tables:
        finish(spark, table.path)
        if not any(n.startswith("bucket=") for n in names(spark, table.path)):
            continue
        asked = gone.select(F.col(document).alias(table.key))
        if table.via:
            parent, names_document, points_to = table.via
            found = spark.read.parquet(parent).join(gone.select(F.col(document).alias(names_document)).distinct(), names_document, "left_semi")
            asked = found.select(F.col(points_to).alias(table.key))
        buckets, _ = layout(spark, table.path)
        rows = spark.read.parquet(table.path)
        there = rows.select(table.key, "bucket").join(bucketed(asked.distinct(), table.key, buckets), [table.key, "bucket"], "left_semi")
        replace_rows(rows.drop("bucket").limit(0), table.path, table.key, there.select(table.key), batch)
