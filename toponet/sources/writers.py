"""Snapshots and atomic publishing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SNAPSHOT_COLUMNS = ["work_id", "title_norm", "place_count"]


def snapshot_columns(index: DataFrame) -> DataFrame:
    """The part of the catalogue that other devices match against."""
    return index.select(*SNAPSHOT_COLUMNS)


def write_snapshot(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """Write a table as parquet, sorted inside files so that statistics prune."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(path)


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path itself."""
    path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path_.getFileSystem(spark._jsc.sc().hadoopConfiguration()), path_


def published_version(spark: SparkSession, root: str) -> str | None:
    """The version that readers see: the pointer with the largest number."""
    files, path = _files(spark, f"{root}/pointers")
    if not files.exists(path):
        return None
    numbers = [int(x.getPath().getName()) for x in files.listStatus(path)]
    if not numbers:
        return None
    return spark.read.schema("version string").json(f"{root}/pointers/{max(numbers)}").first().version


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that readers see."""
    return spark.read.parquet(f"{root}/versions/{published_version(spark, root)}/{name}")


def publish(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str,
    gates: Callable[[dict[str, DataFrame]], dict[str, DataFrame]],
) -> str:
    """Write all tables under a new version, check what was written, then switch the pointer.

    ``gates`` gets the written tables and returns violating rows by rule; any row leaves the
    old version in place. Pointers are numbered and appear by a rename, so readers see the
    old version or the whole new one, and of two writers of one number one fails.
    """
    before = published_version(spark, root)
    folder = f"{root}/versions/{version}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    written = {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in tables.items()}
    for name, df in gates(written).items():
        if not df.isEmpty():
            raise ValueError(f"not published, {name} violated")
    made = f"{root}/pointer-{uuid.uuid4().hex}"
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.json(made)
    files, path = _files(spark, f"{root}/pointers")
    files.mkdirs(path)
    number = max([int(x.getPath().getName()) for x in files.listStatus(path)], default=0) + 1
    if published_version(spark, root) != before or not files.rename(
        _files(spark, made)[1], _files(spark, f"{root}/pointers/{number}")[1]
    ):
        raise RuntimeError("another version was published meanwhile")
    return folder
