"""Folders for written tables, where driver and executors both see them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple, str] = {}


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path not used yet in the folder that spark.checkpoint.dir names. Only where all tasks run on this machine may the session name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='riskspark-files-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/riskspark/{tag}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's view of a path: its file system, and the path itself."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stamp(spark: SparkSession, path: str) -> tuple:
    """Changes when files under a path are added, removed or written anew."""
    fs, at = file_system(spark, path)
    size = fs.getContentSummary(at)
    return path, fs.getFileStatus(at).getModificationTime(), size.getLength(), size.getFileCount()


def kept(spark: SparkSession, tag: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build() makes of the files at `sources`, written once to the shared folder and read from there as long as those files stay the same.

    tag tells apart what is made of the same sources. Later plans begin at the written table, so its lineage is run once in a session and a lost executor
    costs no more than its own tasks.
    """
    key = (spark.sparkContext.applicationId, tag, *[stamp(spark, s) for s in sources])
    path = _kept.get(key)
    if path is not None:
        fs, at = file_system(spark, f"{path}/_SUCCESS")
        path = path if fs.exists(at) else None  # the folder may have been cleared
    if path is None:
        path = new_folder(spark, tag)
        build().write.parquet(path)
        _kept[key] = path
    return spark.read.parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of its own in the shared folder: its lineage ends there."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
