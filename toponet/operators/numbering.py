"""Running numbers and neighbours without one-task or one-group windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_ids(df: DataFrame, order: list[str], lead: str, width: int, name: str) -> DataFrame:
    """Number rows 1..N by ``order`` whose first column is the integer ``lead``.

    Rows are cut into ranges of ``width`` values of ``lead``. Each range is
    sorted on its own; the only ordered pass over everything is the running sum
    over one count per range. Any mix of range sizes gives the same numbers as
    one global window.
    """
    ranged = df.withColumn("_range", F.floor(F.col(lead) / width).cast("long"))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # Counts shrink again to one row per super range before the unpartitioned sum.
    counts = counts.withColumn("_super", F.floor(F.col("_range") / 4096).cast("long"))
    supers = counts.groupBy("_super").agg(F.sum("_n").alias("_s"))
    before = Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("_super", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_super").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.join(supers, "_super").select(
        "_range",
        (F.col("_base") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_start"),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_rn", F.row_number().over(inside))
        .join(starts, "_range")
        .withColumn(name, (F.col("_start") + F.col("_rn")).cast("long"))
        .drop("_range", "_rn", "_start")
    )


def dense_ids_on_key(df: DataFrame, order: list[str], lead: str, width: int, name: str) -> DataFrame:
    """As ``dense_ids``, for rows that a join on ``lead`` has dealt out already.

    Rows are numbered inside their key, where they lie; only one count per key travels to
    find where the key starts.
    """
    counts = df.groupBy(lead).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_range", F.floor(F.col(lead) / width).cast("long"))
    ranges = counts.groupBy("_range").agg(F.sum("_n").alias("_n"))
    ranges = ranges.withColumn("_super", F.floor(F.col("_range") / 4096).cast("long"))
    supers = ranges.groupBy("_super").agg(F.sum("_n").alias("_s"))
    up_to = Window.unboundedPreceding, -1
    before = Window.orderBy("_super").rowsBetween(*up_to)
    supers = supers.select("_super", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_super").orderBy("_range").rowsBetween(*up_to)
    bases = ranges.join(supers, "_super").select(
        "_range", (F.col("_base") + F.coalesce(F.sum("_n").over(within), F.lit(0))).alias("_base")
    )
    earlier = Window.partitionBy("_range").orderBy(lead).rowsBetween(*up_to)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(bases, "_range").select(
        F.col(lead).alias("_key"), (F.col("_base") + F.col("_before")).alias("_start")
    )
    inside = Window.partitionBy(lead).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(starts.hint("merge"), F.col(lead) == F.col("_key"))
        .withColumn(name, (F.col("_start") + F.col("_rn")).cast("long"))
        .drop("_rn", "_key", "_start")
    )


def group_ranks(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str
) -> DataFrame:
    """``row_number`` per key that splits large keys over many tasks.

    ``bucket`` must not decrease along ``order`` (a coarse form of its first
    column). Rows are numbered inside (key, bucket); a bucket's start is the sum
    of the counts of the key's earlier buckets, a table of counts only.
    """
    cut = df.withColumn("_b", bucket)
    counts = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_b").alias("_sb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    numbered = cut.withColumn("_rn", F.row_number().over(inside))
    match = F.col("_b").eqNullSafe(F.col("_sb"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        numbered.join(starts, match)
        .withColumn(name, (F.col("_start") + F.col("_rn")).cast("int"))
        .drop("_b", "_sb", "_rn", "_start", *[f"_k_{k}" for k in keys])
    )


def with_previous(
    df: DataFrame, keys: list[str], rank: str, columns: list[str], prefix: str = "prev_"
) -> DataFrame:
    """Columns of the row before, found by (key, rank - 1) instead of a key window."""
    before = df.select(
        *keys,
        (F.col(rank) + 1).alias(rank),
        *[F.col(c).alias(f"{prefix}{c}") for c in columns],
    )
    return df.join(before, [*keys, rank], "left")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key; Spark limits each task's group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_top", rank).filter(F.col("_top") <= k).drop("_top")
