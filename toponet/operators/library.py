"""Personal libraries: filters, merging, ordering, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fold
from .numbering import group_ranks

c = F.col

INTERESTED = ["like", "known", "saved"]


def library_key(imdb_id: Column, title: Column, year: Column) -> Column:
    """Identity of an item: its id, else title and year."""
    text = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    named = F.concat(text, F.lit(":"), F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(imdb_id, named)


def library_entries(works: DataFrame, library: DataFrame, tolerance: int = 1) -> DataFrame:
    """First item of each user that is the work: same title, year within one."""
    held = works.select(
        "work_id", c("year").alias("w_year"), fold.normalize_title(c("title")).alias("key")
    ).filter(c("key") != "")
    rows = library.withColumn("key", fold.normalize_title(c("title"))).join(held, "key")
    close = c("w_year").isNull() | c("year").isNull() | (
        F.abs(c("w_year") - c("year")) <= tolerance
    )
    return rows.filter(close).groupBy("user_id", "work_id").agg(
        F.min(F.struct("item_id", "rating")).alias("_e")
    ).select("user_id", "work_id", c("_e.item_id").alias("item_id"), c("_e.rating").alias("rating"))


def passes_library(entries: DataFrame, min_rating: float = 0.0) -> DataFrame:
    """Works a user holds, rated at least so high when a bar is set."""
    return entries if min_rating <= 0 else entries.filter(c("rating") >= min_rating)


def passes_public(works: DataFrame, ratings: DataFrame, bar: float = 0.0) -> DataFrame:
    """Works at or above a public rating on the ten-point scale; unrated ones fail."""
    if bar <= 0:
        return works
    good = ratings.filter((c("source") == "imdb") & (c("score") / 10 >= bar)).select("work_id")
    return works.join(good.distinct(), "work_id", "left_semi")


def merge_libraries(current: DataFrame, imported: DataFrame) -> DataFrame:
    """One item per key: later values win where they state something, sources unite.

    Both inputs: user_id, item_id (order), title, year, imdb_id, rating, source.
    """
    key = library_key(c("imdb_id"), c("title"), c("year"))
    old = current.withColumn("key", key)
    rest = [x for x in old.columns if x not in ("user_id", "key")]
    last = old.groupBy("user_id", "key").agg(F.max_by(F.struct(*rest), "item_id").alias("_r"))
    old = last.select("user_id", "key", *[c(f"_r.{x}").alias(x) for x in rest], F.lit(0).alias("_turn"))
    new = imported.withColumn("key", key).withColumn("_turn", F.lit(1))
    both = old.unionByName(new)
    order = F.struct("_turn", "item_id")
    return both.groupBy("user_id", "key").agg(
        F.max_by("title", order).alias("title"),
        F.max_by("year", order).alias("year"),
        F.max_by("rating", F.when(c("rating").isNotNull(), order)).alias("rating"),
        F.sort_array(F.collect_set("source")).alias("sources"),
    )


def sort_library(items: DataFrame) -> DataFrame:
    """Rank per user: own rating (unrated last), places held, title."""
    bucket = F.when(c("rating").isNull(), 1).otherwise(-F.floor("rating").cast("int"))
    order = [c("rating").desc_nulls_last(), F.desc("place_count"), c("title"), c("item_id")]
    return group_ranks(items, ["user_id"], order, bucket, "rank")


def natural_key(tmdb_id: Column, imdb_id: Column, title_norm: Column, year: Column) -> Column:
    """Identity of a work row: one id, else the other, else title and year."""
    named = F.concat(
        F.lit("title:"), title_norm, F.lit(":"), F.coalesce(year.cast("string"), F.lit(""))
    )
    return F.coalesce(
        F.concat(F.lit("tmdb:"), tmdb_id), F.concat(F.lit("imdb:"), imdb_id), named
    )


def latest_choices(decisions: DataFrame) -> DataFrame:
    """Interested cards by the latest decision on each."""
    last = decisions.groupBy("user_id", "card_id").agg(
        F.max_by("choice", F.struct("ts", "event_id")).alias("choice")
    )
    return last.filter(c("choice").isin(INTERESTED))
