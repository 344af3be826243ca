"""Snap points to buildings, confirm street names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, phrases
from ..functions.fold import normalize_name
from . import spatial

c = F.col

SEARCH_M, MAX_SEARCH_M, MAX_MOVE_M, STREET_M = 60.0, 150.0, 100.0, 30.0
# Precisions that need the building to say the name; words for a kind of
# building; last words of street names.
VAGUE = ["city", "country", "region", "state", "none"]
BUILDING_KINDS = [
    "the", "church", "chapel", "cathedral", "abbey", "building", "hotel", "theatre", "theater",
    "station", "museum", "pub", "tower",
]
STREET_WORDS = [
    "street", "st", "road", "rd", "lane", "avenue", "ave", "square", "terrace", "mews", "place",
    "row", "walk", "gardens", "close", "crescent", "way", "grove", "hill", "yard", "drive",
    "parade", "embankment", "passage", "court", "alley", "boulevard", "circus",
]


def _same_building(place: Column, building: Column) -> Column:
    """Equal names, or one has a single word for the kind of building more."""
    a, b = F.split(place, " "), F.split(building, " ")
    a_short = F.size(a) < F.size(b)
    short = F.when(a_short, a).otherwise(b)
    long = F.when(a_short, b).otherwise(a)
    n = F.size(long)
    first_same = F.get(long, F.lit(0)) == F.get(short, F.lit(0))
    extra = F.when(first_same, F.element_at(long, -1)).otherwise(F.get(long, F.lit(0)))
    rest = F.array_join(short, " ")
    cut_end = F.array_join(F.slice(long, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")
    cut_front = F.array_join(F.slice(long, F.lit(2), F.greatest(n - 1, F.lit(0))), " ")
    one_more = (
        (F.size(short) >= 2)
        & (n - F.size(short) == 1)
        & extra.isin(BUILDING_KINDS)
        & ((cut_end == rest) | (cut_front == rest))
    )
    return (place != "") & (building != "") & ((place == building) | one_more)


def confirming_columns(points: DataFrame) -> DataFrame:
    """Comparable forms of a point's name, made once before any join."""
    at = r"(?i)^(\d+[a-z]?)\s+(.+)$"
    rows = points.withColumn("_head", phrases.place_head(c("name")))
    return rows.select(
        *points.columns,
        normalize_name(c("name")).alias("p_name"),
        normalize_name(c("_head")).alias("p_head"),
        normalize_name(F.regexp_extract("_head", at, 1)).alias("p_door"),
        normalize_name(F.regexp_extract("_head", at, 2)).alias("p_road"),
    )


def building_confirms() -> Column:
    """The building (o_name, o_door, o_road) bears the place's name, or its address."""
    named = _same_building(c("p_name"), c("o_name")) | _same_building(c("p_head"), c("o_name"))
    addressed = (c("p_door") != "") & (c("p_door") == c("o_door")) & (c("p_road") == c("o_road"))
    return named | F.coalesce(addressed, F.lit(False))


def snap_to_buildings(
    points: DataFrame, buildings: DataFrame, entrances: DataFrame | None = None,
    radius_m: float = SEARCH_M,
) -> DataFrame:
    """Position of each point on its building, or the reason it stays.

    ``points``: id, name, precision, lat, lng. ``buildings``: building_id, b_name,
    house_number, b_street, ring and box columns of ``spatial.polygons``.
    ``entrances``: building_id, entrance_id, main, e_lat, e_lng. A point only
    meets buildings of its cell; counts per point decide, so no list is gathered.
    """
    radius = min(radius_m, MAX_SEARCH_M) if radius_m > 0 else SEARCH_M
    known = buildings.select(
        "building_id", "ring", "south", "north", "west", "east",
        normalize_name(F.coalesce("b_name", F.lit(""))).alias("o_name"),
        normalize_name(c("house_number")).alias("o_door"),
        normalize_name(c("b_street")).alias("o_road"),
    )
    near = spatial.polygon_candidates(confirming_columns(points), known, radius + 1)
    near = near.select(
        "id", "building_id", "p_name", "p_head", "p_door", "p_road", "o_name", "o_door", "o_road",
        spatial.in_ring(c("lat"), c("lng"), c("ring")).alias("inside"),
        spatial.metres_to_line(c("lat"), c("lng"), c("ring")).alias("metres"),
    )
    near = near.select("id", "building_id", "inside", "metres", building_confirms().alias("fits"))
    close = c("metres") <= radius
    confirmed = (c("inside") | close) & c("fits")
    stats = near.groupBy("id").agg(
        *[
            x
            for label, test in (("in", c("inside")), ("near", close), ("named", confirmed))
            for x in (
                F.count(F.when(test, 1)).alias(f"n_{label}"),
                F.min(F.when(test, c("building_id"))).alias(f"b_{label}"),
            )
        ]
    )
    rows = points.join(stats, "id", "left")
    vague = F.coalesce(F.lower("precision").isin(VAGUE), F.lit(True))
    zero = F.lit(0)
    n_in, n_near, n_named = (F.coalesce(f"n_{x}", zero) for x in ("in", "near", "named"))
    reason = (
        F.when(~geo.valid_coordinate(c("lat"), c("lng")), "no_coordinate")
        .when(vague & (n_named == 1), "confirmed_by_name")
        .when(vague & (n_named > 1), "ambiguous_named")
        .when(vague, "area_not_a_building")
        .when(n_in == 1, "inside_footprint")
        .when(n_in > 1, "ambiguous_overlap")
        .when(n_near == 1, "only_building_nearby")
        .when(n_near == 0, "no_buildings")
        .otherwise("ambiguous_neighbours")
    )
    chosen = (
        F.when(reason == "confirmed_by_name", c("b_named"))
        .when(reason == "inside_footprint", c("b_in"))
        .when(reason == "only_building_nearby", c("b_near"))
    )
    rows = rows.select("id", "lat", "lng", reason.alias("reason"), chosen.alias("building_id"))
    rows = rows.join(buildings.select("building_id", "ring"), "building_id", "left")
    if entrances is None:
        rows = rows.withColumn("_e", F.lit(None).cast("struct<k:int,entrance_id:bigint,lat:double,lng:double>"))
    else:
        # An entrance counts when it is a vertex of the ring; the main one wins.
        doors = entrances.join(buildings.select("building_id", "ring"), "building_id").filter(
            F.exists("ring", lambda p: (p["lat"] == c("e_lat")) & (p["lng"] == c("e_lng")))
        )
        best = doors.groupBy("building_id").agg(
            F.min(
                F.struct(
                    F.when(c("main"), 0).otherwise(1).alias("k"), "entrance_id",
                    c("e_lat").alias("lat"), c("e_lng").alias("lng"),
                )
            ).alias("_e")
        )
        rows = rows.join(best, "building_id", "left")
    rows = rows.withColumn("_c", spatial.ring_centroid(c("ring"))).withColumn(
        "_in", spatial.in_ring(c("lat"), c("lng"), c("ring"))
    )
    centre_in = spatial.in_ring(c("_c.lat"), c("_c.lng"), c("ring"))
    via = (
        F.when(c("building_id").isNull(), None)
        .when(c("_e").isNotNull(), "entrance")
        .when(c("_c").isNotNull() & centre_in, "centroid")
        .when(c("_in"), "original_inside")
    )
    rows = rows.withColumn("via", via)
    to = {
        x: F.when(c("via") == "entrance", c(f"_e.{x}"))
        .when(c("via") == "centroid", c(f"_c.{x}"))
        .when(c("via") == "original_inside", c(x))
        for x in ("lat", "lng")
    }
    rows = rows.withColumn("to_lat", to["lat"]).withColumn("to_lng", to["lng"])
    moved = geo.half_up(geo.haversine_m(c("lat"), c("lng"), c("to_lat"), c("to_lng")))
    far = F.coalesce(moved > MAX_MOVE_M, F.lit(False))
    outcome = (
        F.when(c("building_id").isNotNull() & c("via").isNull(), "no_usable_position")
        .when(far & c("_in"), "kept_point_inside_large_footprint")
        .when(far, "snap_too_far")
        .otherwise(c("reason"))
    )
    snapped = c("via").isNotNull() & ~(far & ~c("_in"))
    moves = snapped & ~far
    return rows.select(
        "id",
        snapped.alias("snapped"),
        outcome.alias("reason"),
        F.when(moves, c("via")).alias("via"),
        F.when(snapped, c("building_id")).alias("building_id"),
        F.when(moves, c("to_lat")).otherwise(c("lat")).alias("lat"),
        F.when(moves, c("to_lng")).otherwise(c("lng")).alias("lng"),
        F.when(moves, moved).otherwise(0.0).alias("moved_m"),
    )


def street_name(name: Column) -> Column:
    """Normalized street a phrase names (house number dropped), NULL when none."""
    head = F.trim(F.regexp_replace(phrases.place_head(name), r"(?i)^\d+[a-z]?\s+", ""))
    key = normalize_name(head)
    words = F.split(key, " ")
    return F.when((F.size(words) >= 2) & F.element_at(words, -1).isin(STREET_WORDS), key)


def confirm_streets(points: DataFrame, streets: DataFrame) -> DataFrame:
    """Street of the same name within 30 m of the point; the nearest one.

    ``streets``: street_id, s_name, ring (an open line) and its box.
    """
    asked = points.withColumn("wanted", street_name(c("name")))
    # The name joins too, so a crowded cell only compares equal names.
    lines = streets.withColumn("s_key", normalize_name(c("s_name")))
    near = spatial.polygon_candidates(
        asked.filter(c("wanted").isNotNull()), lines, STREET_M + 1
    ).filter(c("wanted") == c("s_key"))
    metres = spatial.metres_to_line(c("lat"), c("lng"), c("ring"), closed=False)
    best = near.withColumn("m", metres).filter(c("m") <= STREET_M).groupBy("id").agg(
        F.min(F.struct("m", "street_id")).alias("_b")
    )
    reason = (
        F.when(c("lat").isNull(), "no_coordinate")
        .when(c("wanted").isNull(), "not_a_street_name")
        .when(c("_b").isNull(), "no_such_street_here")
        .otherwise("on_named_street")
    )
    return asked.join(best, "id", "left").select(
        "id", reason.alias("reason"), c("_b.street_id").alias("street_id"), c("_b.m").alias("metres")
    )
