"""Map read models: what may be drawn, clusters, points, one row per coordinate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts, geo
from .numbering import top_per_key

MAP_THRESHOLD = 0.4
MAX_FILMS_PER_POINT = 40
MAX_ROWS_PER_RESPONSE = 1000

c = F.col


def supported_subjects(evidence: DataFrame, subject_type: str) -> DataFrame:
    """Subjects with evidence that does not contradict; one row each."""
    keep = (c("subject_type") == subject_type) & ~c("agrees").eqNullSafe(F.lit(False))
    return evidence.filter(keep).select("subject_id").distinct()


def mappable(places: DataFrame, evidence: DataFrame) -> DataFrame:
    """Verified, located, real places with enough confidence and some support."""
    base = places.filter(
        c("lat").isNotNull()
        & (c("place_class") != "fictional")
        & (c("confidence") >= MAP_THRESHOLD)
        & (c("status") == "verified")
    )
    ids = supported_subjects(evidence, "place").withColumnRenamed("subject_id", "place_id")
    return base.join(ids, "place_id", "left_semi")


def in_view(df: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Rows inside (west, south, east, north)."""
    return df if box is None else df.filter(geo.in_viewport(c("lat"), c("lng"), *box))


def at_works(
    places: DataFrame, links: DataFrame, works: DataFrame | None = None,
    work_id: int | None = None, kinds: list[str] | None = None,
) -> DataFrame:
    """Places that some work (of these kinds) is linked to."""
    if work_id is not None:
        one = links.filter(c("work_id") == work_id).select("place_id")
        places = places.join(one, "place_id", "left_semi")
    if kinds is not None:
        named = works.filter(c("kind").isin(kinds)).select("work_id")
        linked = links.join(named, "work_id", "left_semi").select("place_id").distinct()
        places = places.join(linked, "place_id", "left_semi")
    return places


def visible_queue(submissions: DataFrame) -> DataFrame:
    """Queue rows shown as candidates: located, not rejected, not yet promoted."""
    return submissions.filter(
        (c("status") != "rejected")
        & geo.has_point(c("lat"), c("lng"))
        & c("place_id").isNull()
    )


def grid_clusters(places: DataFrame, zoom: int, limit: int | None = 2000) -> DataFrame:
    """One row per grid cell: centre, size, best-known name, any studio."""
    step = geo.cluster_cell(zoom)
    cells = places.groupBy(
        geo.grid_id(c("lng"), step).alias("gx"), geo.grid_id(c("lat"), step).alias("gy")
    ).agg(
        F.avg("lat").alias("lat"),
        F.avg("lng").alias("lng"),
        F.count(F.lit(1)).alias("cluster_count"),
        F.min_by("name", F.struct(-c("confidence"), c("name"))).alias("sample_name"),
        F.bool_or(c("place_class") == "studio_interior").alias("has_studio"),
    )
    return _largest(cells, limit)


def queue_clusters(queue: DataFrame, zoom: int, limit: int | None = 2000) -> DataFrame:
    """Grid cells of queue rows with the number of distinct works behind them."""
    step = geo.cluster_cell(zoom)
    cells = queue.groupBy(
        geo.grid_id(c("lng"), step).alias("gx"), geo.grid_id(c("lat"), step).alias("gy")
    ).agg(
        F.avg("lat").alias("lat"),
        F.avg("lng").alias("lng"),
        F.count(F.lit(1)).alias("cluster_count"),
        F.count_distinct("work_id").alias("work_count"),
        F.min("place_name").alias("sample_name"),
    )
    return _largest(cells, limit)


def _largest(cells: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return cells
    return cells.orderBy(F.desc("cluster_count"), "gy", "gx").limit(limit)


def rating_columns(ratings: DataFrame, sources: list[str]) -> DataFrame:
    """One row per work with the first source that rates it, in the given order."""
    picked = ratings.filter(c("source").isin(sources)).groupBy("work_id")
    rank = F.array_position(F.lit(sources), c("source"))
    return picked.agg(
        F.min_by(F.struct("source", "score", "votes"), rank).alias("_r")
    ).select(
        "work_id",
        c("_r.source").alias("rating_source"),
        c("_r.score").alias("rating_score"),
        c("_r.votes").alias("rating_votes"),
    )


def queue_points(queue: DataFrame, works: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row per coordinate (five decimals) with its films, at most 40 by title.

    The films of a coordinate are made distinct before they are ranked, and the
    ranking keeps 40 per task before the shuffle, so a coordinate that holds a
    large part of the queue never gathers in one task.
    """
    rows = (
        queue.join(works.select("work_id", "title", "year", "kind"), "work_id")
        .join(rating_columns(ratings, ["imdb", "tmdb"]), "work_id", "left")
        .withColumn("glat", F.round("lat", 5))
        .withColumn("glng", F.round("lng", 5))
    )
    points = rows.groupBy("glat", "glng").agg(
        F.min_by("place_name", F.struct(F.length("place_name"), c("place_name"))).alias("place_name"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("work_id").alias("work_count"),
        F.when(F.bool_or(c("status") == "verified"), "verified").otherwise("pending").alias("status"),
    )
    film = [
        "work_id", "title", "year", "kind", "place_name", "source_kind", "source_url", "status",
        "rating_source", "rating_score", "rating_votes", "source_sentence",
    ]
    films = rows.select("glat", "glng", *film).distinct()
    films = top_per_key(films, ["glat", "glng"], [c(x) for x in ["title", *film]], MAX_FILMS_PER_POINT)
    films = films.groupBy("glat", "glng").agg(
        F.sort_array(
            F.collect_list(F.struct("title", *[x for x in film if x != "title"]))
        ).alias("films")
    )
    return points.join(films, ["glat", "glng"])


def subject_counts(evidence: DataFrame, subject_type: str, key: str) -> DataFrame:
    """Evidence rows per subject."""
    return (
        evidence.filter(c("subject_type") == subject_type)
        .groupBy(c("subject_id").alias(key))
        .agg(F.count(F.lit(1)).alias("evidence_count"))
    )


def with_counts(places: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Places with their numbers of evidence rows and links, zero included."""
    proof = subject_counts(evidence, "place", "place_id")
    works = links.groupBy("place_id").agg(F.count(F.lit(1)).alias("work_count"))
    zero = F.lit(0).cast("long")
    return (
        places.join(proof, "place_id", "left")
        .join(works, "place_id", "left")
        .withColumn("evidence_count", F.coalesce("evidence_count", zero))
        .withColumn("work_count", F.coalesce("work_count", zero))
    )


def points_in_view(
    places: DataFrame, evidence: DataFrame, links: DataFrame,
    box: tuple[float, float, float, float], limit: int = 2000,
) -> DataFrame:
    """Mappable places of a viewport, most certain first.

    The cut comes before the counts are joined: only the kept places need them.
    """
    kept = (
        in_view(mappable(places, evidence), box)
        .orderBy(F.desc("confidence"), "name", "place_id")
        .limit(limit)
    )
    return with_counts(kept, evidence, links)


def point_features(rows: DataFrame, cap: int = MAX_ROWS_PER_RESPONSE) -> DataFrame:
    """One map feature per row as JSON, with a flag when the cap was reached."""
    badge = facts.point_badge(
        c("place_class") == "studio_interior", c("place_class"), c("geocode_precision")
    )
    url = F.when(
        c("wikidata_id").isNotNull(),
        F.concat(F.lit("https://www.wikidata.org/wiki/"), c("wikidata_id")),
    )
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(
                F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")
            ).alias("geometry"),
            F.struct(
                "place_id", "wikidata_id", "name", "place_class", "geocode_precision",
                "confidence", badge.alias("badge"), url.alias("source_url"),
            ).alias("properties"),
        )
    )
    total = rows.agg(F.count(F.lit(1)).alias("n")).select(c("n") >= cap).scalar()
    return rows.select(
        "place_id",
        badge.alias("badge"),
        url.alias("source_url"),
        feature.alias("feature"),
        total.alias("truncated"),
    )


def fictional_places(places: DataFrame, links: DataFrame, limit: int | None = 200) -> DataFrame:
    """Places that are never pinned, with the number of links to them."""
    rows = places.filter(c("place_class") == "fictional")
    counts = links.groupBy("place_id").agg(F.count(F.lit(1)).alias("work_count"))
    rows = rows.join(counts, "place_id", "left").select(
        "place_id", "wikidata_id", "name",
        F.coalesce("work_count", F.lit(0).cast("long")).alias("work_count"),
    )
    return rows if limit is None else rows.orderBy("name", "place_id").limit(limit)


def films_in_view(points: DataFrame, on_lot: Column) -> DataFrame:
    """Works of the queue rows in view: places, distinct spots, only on a lot."""
    return points.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("place_count"),
        F.count_distinct("lat", "lng").alias("distinct_places"),
        F.bool_and(on_lot).alias("on_a_lot_only"),
    )
