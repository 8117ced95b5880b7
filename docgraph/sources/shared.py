"""Tables between the steps of an operator, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one of ``spark.checkpoint.dir``, or else (local tests) the context's checkpoint folder."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as a table in the shared folder and read back: a lost executor costs a re-read, not all that led here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[read] = path
    return read


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` gave, once nothing reads it any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            delete_path(df.sparkSession, path)
