"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of the session's spark.checkpoint.dir; where none is set, a local session gets its own and others fail."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="heddle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Has Spark delete a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def folder(spark: SparkSession, *, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, place = _folder(spark, path)
    files.deleteOnExit(place)
    return path


def stored(df: DataFrame, *, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, which cuts its lineage.

    The shuffle files of the write go when it ends, as nothing reads them again; the table goes when the
    application ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = folder(spark, name=name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        files, place = _folder(t.sparkSession, _paths.pop(t))
        files.delete(place, True)


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place
