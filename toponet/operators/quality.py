"""Data-quality jobs: every function returns the violating rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as fa

c = F.col

# Accepted values of closed columns.
RELATIONS = [
    "filming_location", "narrative_location", "studio_of", "recorded_at", "replica",
    "inspiration_for", "author_place", "artist_place", "lived_here", "worked_here", "wrote_here",
    "died_here", "buried_here", "commemorated_here",
]
PLACE_CLASSES = [
    "real_exterior", "real_interior", "studio_interior", "fictional", "narrative_real", "unknown",
]


def evidence_without_source(evidence: DataFrame, columns: list[str]) -> DataFrame:
    """Evidence that names neither a URL nor a reference."""
    stated = F.lit(False)
    for name in columns:
        stated = stated | F.coalesce(F.length(F.trim(name)) > 0, F.lit(False))
    return evidence.filter(~stated)


def facts_without_evidence(
    links: DataFrame, creator_links: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Facts of works and people that nothing supports."""

    def missing(facts: DataFrame, key: str, kind: str, label: str) -> DataFrame:
        proof = evidence.filter(c("subject_type") == kind).select(
            c("subject_id").alias(key)
        ).distinct()
        rows = facts.join(proof, key, "left_anti")
        return rows.select(
            F.lit(label).alias("subject_type"), c(key).alias("fact_id"), "place_id", "relation_kind"
        )

    return missing(links, "link_id", "link", "work").unionByName(
        missing(creator_links, "fact_id", "creator_link", "creator")
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row; NULLs count as equal."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(c("row_count") > 1)


def bad_coordinates(places: DataFrame) -> DataFrame:
    """Out of range, or only one of the two numbers."""
    lat, lng = c("lat"), c("lng")
    half = lat.isNull() != lng.isNull()
    out = F.coalesce((F.abs(lat) > 90) | (F.abs(lng) > 180), F.lit(False))
    reason = F.when(half, "half_a_coordinate").when(out, "out_of_range")
    return places.withColumn("violation", reason).filter(c("violation").isNotNull())


def bad_geocodes(rows: DataFrame) -> DataFrame:
    """Located rows without a source of the point, or whose id only echoes it."""
    echo = (c("geocode_source") == "wikidata") & (c("geocode_source_id") == c("wikidata_id"))
    reason = F.when(
        c("lat").isNotNull() & c("geocode_source").isNull(), "no_geocode_source"
    ).when(echo, "id_echoes_geocode")
    return rows.withColumn("violation", reason).filter(c("violation").isNotNull())


def bad_person_relations(creator_links: DataFrame) -> DataFrame:
    """Relations a person cannot have."""
    return creator_links.filter(~c("relation_kind").isin(fa.CREATOR_RELATIONS))


def outside_values(df: DataFrame, column: str, accepted: list[str]) -> DataFrame:
    """Rows whose value is not one of the accepted ones."""
    return df.filter(~F.coalesce(c(column).isin(accepted), F.lit(False)))


def repair_scale(ratings: DataFrame) -> DataFrame:
    """Scores written on the ten-point scale by mistake go to 0..100; running it
    twice changes nothing."""
    low = (c("source") == "imdb") & (c("score") > 0) & (c("score") <= 10)
    return ratings.withColumn("repaired", F.coalesce(low, F.lit(False))).withColumn(
        "score", F.when(low, c("score") * 10).otherwise(c("score"))
    )


def repair_precision(places: DataFrame) -> DataFrame:
    """A coordinate of an identified place is a point, whatever was recorded."""
    wrong = c("wikidata_id").isNotNull() & c("lat").isNotNull() & (c("geocode_precision") == "none")
    return places.withColumn("repaired", F.coalesce(wrong, F.lit(False))).withColumn(
        "geocode_precision", F.when(wrong, "point").otherwise(c("geocode_precision"))
    )
