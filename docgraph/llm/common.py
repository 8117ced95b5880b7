"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as the inside of a regular-expression class.
BLANKS = " \\t-\\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one named in ``spark.checkpoint.dir``.

    Only where none is set and all runs in one process (local tests), a temporary folder becomes the checkpoint folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


#: Where the tables lie that ``materialize`` has written, and those still there in order.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    read = spark.read.schema(df.schema).parquet(path)
    _PATHS[read] = path
    return read


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``materialize`` has written and nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` gave, once nothing reads it any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            drop_tables(df.sparkSession, [path])


@contextmanager
def kept_only() -> Iterator[list[DataFrame]]:
    """Tables written within are deleted at its end, but for those put into the list."""
    before, keep = set(_WRITTEN), []
    yield keep
    there = {_PATHS[df] for df in keep}
    if keep:
        drop_tables(keep[0].sparkSession, [p for p in _WRITTEN if p not in before and p not in there])


def words(text: Column) -> Column:
    """Maximal runs of characters other than the six blanks; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", -1), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of ``rows`` rows at most from here on: whole texts are long, and both the JVM and Python hold a batch of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def array_slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[pa.Array]:
    """``slices`` of one column."""
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", most_bytes):
        yield part.column(0)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` whose ``column`` holds about ``most_bytes`` at most; one longer row is a range of its own."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
    ends = np.cumsum(np.nan_to_num(sizes.to_numpy(zero_copy_only=False).astype(np.float64)))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0.0
        to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def free_memory() -> None:
    """Give memory that a finished task has left unused in this worker back to the system; workers live on and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def longs(a: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the signed longs that Spark knows."""
    return pa.array(np.ascontiguousarray(a).view(np.int64))
