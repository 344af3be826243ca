"""Bounded closure over a type hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def ancestry(edges: DataFrame, depth: int = 4, seeds: DataFrame | None = None) -> DataFrame:
    """(type_id, ancestor) up to ``depth`` steps, the type itself included.

    Each round extends the newest level only and keeps distinct pairs, so many
    paths between two types cost one row.
    """
    if seeds is None:
        seeds = edges.select("type_id").distinct()
    up = edges.select(c("type_id").alias("ancestor"), "parent_id").distinct()
    level = seeds.select("type_id", c("type_id").alias("ancestor"))
    found = level
    for _ in range(depth):
        level = level.join(up, "ancestor").select("type_id", c("parent_id").alias("ancestor")).distinct()
        found = found.unionByName(level)
    return found.distinct()


def kinds(pairs: DataFrame, roots: dict[str, list[int]]) -> DataFrame:
    """Per type: number of ancestors and which roots it reaches."""
    return pairs.groupBy("type_id").agg(
        F.count(F.lit(1)).alias("ancestors"),
        *[F.bool_or(c("ancestor").isin(ids)).alias(name) for name, ids in roots.items()],
    )
