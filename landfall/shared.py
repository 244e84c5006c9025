"""Intermediate results in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.

    Without that setting a local session gets a temporary folder. On a cluster no folder of one machine
    would do, so that is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="landfall-"))
        base = _own_dir[0]
    return f"{base.rstrip('/')}/landfall-{name}-{uuid.uuid4().hex}"


def folder(spark: SparkSession, path: str):
    """Hadoop's file system and path of a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = folder(spark, path)
    return bool(system.exists(place))


def until_exit(spark: SparkSession, path: str) -> str:
    """Have a written folder deleted when the driver ends."""
    system, place = folder(spark, path)
    system.deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: lineage ends there.

    The folder is deleted by ``released``, or when the driver ends.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(until_exit(df.sparkSession, path))
    rows.stored_at = path
    return rows


def released(*frames: DataFrame) -> None:
    """Delete the folders of stored frames that nothing reads any more."""
    for frame in frames:
        system, place = folder(frame.sparkSession, frame.stored_at)
        system.delete(place, True)
