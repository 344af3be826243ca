"""File readers with explicit schemas; malformed rows are kept aside and countable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import HARVEST_LOCATION, PLAQUE, RATINGS_DUMP
from .records import library_rows

c = F.col


def read_ratings_dump(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ratings dump (gzip or plain)."""
    return spark.read.csv(
        path, schema=RATINGS_DUMP, sep="\t", header=True, nullValue="\\N", mode="PERMISSIVE"
    )


def read_harvest(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited location harvest, unreadable lines in ``_corrupt_record``."""
    schema = HARVEST_LOCATION.add("_corrupt_record", "string")
    return spark.read.schema(schema).option(
        "columnNameOfCorruptRecord", "_corrupt_record"
    ).json(path)


def read_plaques(spark: SparkSession, path: str) -> DataFrame:
    """Plaque dump with quoted line breaks."""
    return spark.read.csv(path, schema=PLAQUE, header=True, multiLine=True, escape='"')


def read_library(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Library export; the header decides the columns, every column is text."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return library_rows(raw, source)


def read_archive(spark: SparkSession, watched: str, rated: str, source: str, user_id: int) -> DataFrame:
    """The two files of an archive, merged: ratings win over the watched list."""
    from ..operators.library import merge_libraries

    def part(path: str) -> DataFrame:
        rows = read_library(spark, path, source)
        return rows.select(
            F.lit(user_id).alias("user_id"), F.monotonically_increasing_id().alias("item_id"),
            "title", "year", "imdb_id", "rating", "source",
        )

    return merge_libraries(part(watched), part(rated))


def appearances(locations: DataFrame) -> DataFrame:
    """One row per (location, movie) appearance of a harvest, with its frame count."""
    rows = locations.select(
        c("id").alias("location_id"), "name", "lat", "lng", "address",
        F.explode("appearances").alias("a"),
    )
    return rows.select(
        "location_id", "name", "lat", "lng", "address",
        c("a.movie_id").alias("movie_id"), c("a.scene").alias("scene"),
        c("a.as_name").alias("as_name"), F.size("a.frames").alias("frames"),
    )


def with_detail(pairs: DataFrame, details: DataFrame) -> DataFrame:
    """Movie-page pairs completed by the location page's appearance, when there is one."""
    return pairs.join(details, ["location_id", "movie_id"], "left")
