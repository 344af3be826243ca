"""Distance, nearest, polygon and corridor joins over cell keys.

Every join here is an equi join on a cell number with an exact residual test.
No side is hinted to broadcast: Spark broadcasts a side when its measured size
allows and shuffles (with skew splitting) when it does not. Name keys multiply
a table after Spark has estimated it; those joins always shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import computed

c = F.col

# A little under the true metres per degree, so that a cell is never too small.
_DEGREE_M = 111000.0
_COLUMNS = 1 << 32


def row_of(lat: Column, size_m: float) -> Column:
    """Number of the band of latitude, ``size_m`` high."""
    return F.floor(lat * (_DEGREE_M / size_m)).cast("long")


def rows_around(lat: Column, radius_m: float, size_m: float) -> Column:
    """Bands that can hold a point within ``radius_m``."""
    reach = radius_m / _DEGREE_M
    return F.sequence(row_of(lat - reach, size_m), row_of(lat + reach, size_m))


def _columns_in_row(row: Column, size_m: float) -> Column:
    """Number of cells around the globe in a row, none narrower than the size."""
    step = size_m / _DEGREE_M
    edge = F.least(F.lit(89.9), F.greatest(F.abs(row * step), F.abs((row + 1) * step)))
    around = F.floor(360.0 * _DEGREE_M / size_m * F.cos(F.radians(edge))).cast("long")
    return F.greatest(F.lit(1).cast("long"), around)


def cell_of(lat: Column, lng: Column, size_m: float) -> Column:
    """Cell number of a point for cells of at least ``size_m`` each way."""
    row = row_of(lat, size_m)
    n = _columns_in_row(row, size_m)
    col = F.pmod(F.floor((lng + 180) / 360 * n).cast("long"), n)
    return row * _COLUMNS + col


def cover(lat: Column, lng: Column, radius_m: Column, size_m: float) -> Column:
    """Cells that can hold a point within ``radius_m``; the date line wraps."""
    reach = radius_m / _DEGREE_M
    edge = F.least(F.lit(89.9), F.abs(lat) + reach)
    width = F.least(F.lit(180.0), reach / F.cos(F.radians(edge)))
    rows = F.sequence(row_of(lat - reach, size_m), row_of(lat + reach, size_m))

    def columns(row: Column) -> Column:
        n = _columns_in_row(row, size_m)
        first = F.floor((lng - width + 180) / 360 * n).cast("long")
        last = F.least(F.floor((lng + width + 180) / 360 * n).cast("long"), first + n - 1)
        return F.transform(F.sequence(first, last), lambda x: row * _COLUMNS + F.pmod(x, n))

    return F.array_distinct(F.flatten(F.transform(rows, columns)))


def box_cover(south: Column, north: Column, west: Column, east: Column, size_m: float) -> Column:
    """Cells of a latitude/longitude box that does not cross the date line."""
    rows = F.sequence(row_of(south, size_m), row_of(north, size_m))

    def columns(row: Column) -> Column:
        n = _columns_in_row(row, size_m)
        first = F.floor((west + 180) / 360 * n).cast("long")
        last = F.floor((east + 180) / 360 * n).cast("long")
        return F.transform(F.sequence(first, last), lambda x: row * _COLUMNS + F.pmod(x, n))

    return F.flatten(F.transform(rows, columns))


def shuffled(exploded: DataFrame) -> DataFrame:
    """``exploded`` for a join that must not broadcast it.

    Spark estimates rows after an explode by the table before it, so a side that has grown many
    times over would still be sent whole through the driver.
    """
    return exploded.hint("merge")


def within_radius(
    anchors: DataFrame, points: DataFrame, radius: Column | float, size_m: float,
    metres: Column, limit: Column | None = None,
) -> DataFrame:
    """Pairs of an anchor (``a_lat``, ``a_lng``) and a point (``lat``, ``lng``).

    ``metres`` is the exact distance in terms of those columns; ``radius`` may
    differ per anchor. ``limit`` replaces the plain ``metres <= radius`` test.
    """
    radius = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius
    around = anchors.filter(c("a_lat").isNotNull() & c("a_lng").isNotNull()).withColumn(
        "_cell", F.explode(cover(c("a_lat"), c("a_lng"), radius, size_m))
    )
    placed = points.filter(c("lat").isNotNull() & c("lng").isNotNull()).withColumn(
        "_cell", cell_of(c("lat"), c("lng"), size_m)
    )
    near = around.join(placed, "_cell").withColumn("metres", metres)
    return near.filter(c("metres") <= radius if limit is None else limit).drop("_cell")


def great_circle() -> Column:
    """Metres between anchor and point columns."""
    return geo.haversine_m(c("a_lat"), c("a_lng"), c("lat"), c("lng"))


def whole_metres() -> Column:
    """Great-circle metres rounded half up, as the matching rules compare them."""
    return geo.half_up(great_circle())


def nearest_k(
    origins: DataFrame, key: str, points: DataFrame, point_key: str, k: int,
    start_m: float = 2000.0,
) -> DataFrame:
    """``k`` nearest points of every origin, ties by point key.

    Rings of growing radius: an origin is answered by the first ring that holds
    ``k`` points, since everything nearer is inside it too. Only unanswered
    origins go on. A coordinate shared by many points keeps its first ``k``,
    which cannot change an answer and keeps a crowded coordinate small.
    """
    from ..session import cut_lineage
    from .numbering import top_per_key

    thin = top_per_key(
        points.filter(c("lat").isNotNull()).select(point_key, "lat", "lng"),
        ["lat", "lng"], [c(point_key)], k,
    )
    left = origins.select(key, "a_lat", "a_lng")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("metres", point_key))
    radius, answers = start_m, None
    while True:
        last = radius > 20_100_000
        ring = within_radius(left, thin, radius, radius, great_circle())
        best = ring.withColumn("rank", rank).filter(c("rank") <= k)
        best = cut_lineage(best.select(key, point_key, "metres", "rank"))
        full = best.filter(c("rank") == k).select(key)
        done = best if last else best.join(full, key, "left_semi")
        answers = done if answers is None else answers.unionByName(done)
        if last:
            return answers
        left = cut_lineage(left.join(full, key, "left_anti"))
        if left.isEmpty():
            return answers
        radius *= 8


def polygons(vertices: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ring: ordered vertices, bounding box, other columns dropped."""
    return vertices.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(order, "lat", "lng"))),
            lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng")),
        ).alias("ring"),
        F.min("lat").alias("south"),
        F.max("lat").alias("north"),
        F.min("lng").alias("west"),
        F.max("lng").alias("east"),
    )


def in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Ray casting: an odd number of edges cross the ray."""

    def crossing(e: Column) -> Column:
        straddles = (e["a_lat"] > lat) != (e["b_lat"] > lat)
        rise = F.when(straddles, e["b_lat"] - e["a_lat"])
        at = (e["b_lng"] - e["a_lng"]) * (lat - e["a_lat"]) / rise + e["a_lng"]
        return F.coalesce(lng < at, F.lit(False))

    return (F.size(ring) >= 3) & (F.size(F.filter(ring_edges(ring), crossing)) % 2 == 1)


def ring_edges(ring: Column, closed: bool = True) -> Column:
    """Edges of a ring (or of an open line) as (a_lat, a_lng, b_lat, b_lng)."""
    stop = F.size(ring) if closed else F.size(ring) - 1

    def edge(i: Column) -> Column:
        p = F.get(ring, i)
        q = F.get(ring, (i + 1) % F.size(ring))
        return F.struct(
            p["lat"].alias("a_lat"), p["lng"].alias("a_lng"),
            q["lat"].alias("b_lat"), q["lng"].alias("b_lng"),
        )

    return F.when(
        stop > 0, F.transform(F.sequence(F.lit(0), F.greatest(stop - 1, F.lit(0))), edge)
    )


def metres_to_line(lat: Column, lng: Column, ring: Column, closed: bool = True) -> Column:
    """Whole metres from a point to the nearest edge, on a local plane."""
    scale = F.cos(F.radians(lat))
    m = geo.METRES_PER_DEGREE

    def distance(e: Column) -> Column:
        ax, ay = (e["a_lng"] - lng) * scale * m, (e["a_lat"] - lat) * m
        bx, by = (e["b_lng"] - lng) * scale * m, (e["b_lat"] - lat) * m
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        along = F.when(length == 0, 0.0).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), (-ax * dx - ay * dy) / length))
        )
        nx, ny = ax + along * dx, ay + along * dy
        return F.sqrt(nx * nx + ny * ny)

    return geo.half_up(F.array_min(F.transform(ring_edges(ring, closed), distance)))


def ring_centroid(ring: Column) -> Column:
    """Area centroid as (lat, lng); NULL for a ring without area."""
    origin = F.get(ring, F.lit(0))

    def add(acc: Column, e: Column) -> Column:
        ax, ay = e["a_lng"] - origin["lng"], e["a_lat"] - origin["lat"]
        bx, by = e["b_lng"] - origin["lng"], e["b_lat"] - origin["lat"]
        cross = ax * by - bx * ay
        return F.struct(
            (acc["area"] + cross).alias("area"),
            (acc["lat"] + (ay + by) * cross).alias("lat"),
            (acc["lng"] + (ax + bx) * cross).alias("lng"),
        )

    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"))
    total = F.aggregate(ring_edges(ring), zero, add)
    return F.when(
        (F.size(ring) >= 3) & (total["area"] != 0),
        F.struct(
            (origin["lat"] + total["lat"] / (3 * total["area"])).alias("lat"),
            (origin["lng"] + total["lng"] / (3 * total["area"])).alias("lng"),
        ),
    )


def polygon_candidates(
    points: DataFrame, rings: DataFrame, margin_m: float = 0.0, size_m: float = 1000.0
) -> DataFrame:
    """Points joined to the rings whose (widened) bounding box holds them."""
    pad = margin_m / _DEGREE_M
    wide = F.lit(pad) / F.cos(F.radians(F.least(F.lit(89.9), F.greatest(
        F.abs(c("south")), F.abs(c("north"))) + pad)))
    boxed = (
        rings.withColumn("south", c("south") - pad)
        .withColumn("north", c("north") + pad)
        .withColumn("_w", wide)
        .withColumn("west", c("west") - c("_w"))
        .withColumn("east", c("east") + c("_w"))
        .withColumn(
            "_cell", F.explode(box_cover(c("south"), c("north"), c("west"), c("east"), size_m))
        )
        .drop("_w")
    )
    placed = points.filter(c("lat").isNotNull() & c("lng").isNotNull()).withColumn(
        "_cell", cell_of(c("lat"), c("lng"), size_m)
    )
    inside = c("lat").between(c("south"), c("north")) & c("lng").between(c("west"), c("east"))
    return placed.join(boxed, "_cell").filter(inside).drop("_cell", "south", "north", "west", "east")


def points_in_polygons(
    points: DataFrame, point_key: str, rings: DataFrame, ring_key: str
) -> DataFrame:
    """First (smallest key) polygon of every point that lies in one."""
    hits = polygon_candidates(points, rings).filter(in_ring(c("lat"), c("lng"), c("ring")))
    return hits.groupBy(point_key).agg(F.min(ring_key).alias(ring_key))


def along_path(
    points: DataFrame, point_key: str, path: DataFrame, path_key: str, order: str,
    corridor_m: float,
) -> DataFrame:
    """Points within the corridor of a path: nearest path point and distance.

    A point lies in one cell, where it meets the list of a path's distinct points around that cell: each pair of
    path and point, which is the result, is made once and not shuffled.
    """
    size = max(2 * corridor_m, 50.0)
    around = (
        path.filter(c("lat").isNotNull() & c("lng").isNotNull())
        .groupBy(path_key, c("lat").alias("a_lat"), c("lng").alias("a_lng")).agg(F.min(F.struct(order)).alias("_o"))
        .withColumn("_cell", F.explode(cover(c("a_lat"), c("a_lng"), F.lit(float(corridor_m)), size)))
    )
    listed = around.groupBy(path_key, "_cell").agg(F.collect_list(F.struct("a_lat", "a_lng", "_o")).alias("_at"))
    spots = points.filter(c("lat").isNotNull() & c("lng").isNotNull()).select(point_key, "lat", "lng").distinct()
    spots = spots.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(point_key))).withColumn(
        "_cell", cell_of(c("lat"), c("lng"), size)
    )
    near = shuffled(listed).join(spots, "_cell")

    def metres(at: Column) -> Column:
        return geo.haversine_m(at["a_lat"], at["a_lng"], c("lat"), c("lng"))

    def told(at: Column) -> Column:
        return F.struct(metres(at).alias("metres"), at["_o"][order].alias(order))

    # Most lists hold one point, whose distance is compiled.
    only = F.get("_at", F.lit(0))
    one = near.filter(F.size("_at") == 1).withColumn("metres", metres(only)).filter(c("metres") <= corridor_m).select(
        path_key, point_key, "_n", F.struct("metres", only["_o"][order].alias(order)).alias("_b")
    )
    more = computed(near.filter(F.size("_at") > 1), _b=F.array_min(F.transform("_at", told))).filter(
        c("_b.metres") <= corridor_m
    ).select(path_key, point_key, "_n", "_b")
    found = one.unionByName(more)
    # Only a point key at several places can meet a path twice.
    best = found.filter(c("_n") == 1).drop("_n").unionByName(
        found.filter(c("_n") > 1).groupBy(path_key, point_key).agg(F.min("_b").alias("_b"))
    )
    return best.select(
        path_key,
        point_key,
        c("_b.metres").alias("metres_off"),
        c(f"_b.{order}").alias("along"),
    )


# Lengths at which a name's end (and start) becomes a join key.
AFFIX_TIERS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64]


def _affix_keys(name: Column, sides: str, all_tiers: bool) -> Column:
    """Join keys under which a shorter and a longer matching name meet.

    A name that is an end (start) of another shares its last (first) ``t``
    characters for every tier ``t`` up to its own length. The shorter name uses
    its largest tier, the longer one all tiers, so every match meets and long
    names hardly meet anything else.
    """
    tiers = F.filter(F.lit(AFFIX_TIERS), lambda t: t <= F.char_length(name))
    if not all_tiers:
        tiers = F.slice(tiers, -1, 1)

    def keys(tag: str, piece) -> Column:
        return F.transform(
            tiers,
            lambda t: F.concat(F.lit(tag), t.cast("string"), F.lit(":"), piece(name, t)),
        )

    return F.concat(*[keys(tag, F.right if tag == "e" else F.left) for tag in sides])


def near_named_pairs(
    left: DataFrame, right: DataFrame, radius_m: float, metres: Column | None = None
) -> DataFrame:
    """Pairs within ``radius_m`` whose normalized names match.

    ``left`` brings ``a_id, a_name, a_lat, a_lng``, ``right`` ``id, name, lat,
    lng``; other columns travel along, and ids are unique on each side. The join
    key is (cell, piece of the name), so a crowded coordinate with many different
    names does not pair them all. Each pair is made once and not shuffled again.
    """
    from ..functions.fold import names_match

    distance = whole_metres() if metres is None else metres
    reach = radius_m + 1.0
    left = left.filter(c("a_lat").isNotNull() & (c("a_name") != ""))
    right = right.filter(c("lat").isNotNull() & (c("name") != ""))
    # The side with one length of keys is the one that is copied to the cells around it.
    a_cell, a_around = cell_of(c("a_lat"), c("a_lng"), reach), cover(c("a_lat"), c("a_lng"), F.lit(reach), reach)
    b_cell, b_around = cell_of(c("lat"), c("lng"), reach), cover(c("lat"), c("lng"), F.lit(reach), reach)
    found = None
    for left_all in (True, False):
        a = left.withColumn("_cell", a_cell if left_all else F.explode(a_around))
        b = right.withColumn("_cell", F.explode(b_around) if left_all else b_cell)
        a = a.withColumn("_key", F.explode(_affix_keys(c("a_name"), "es", left_all)))
        b = b.withColumn("_key", F.explode(_affix_keys(c("name"), "es", not left_all)))
        pairs = shuffled(a).join(shuffled(b), ["_cell", "_key"])
        longer = F.char_length("a_name") >= F.char_length("name")
        pairs = pairs.filter(longer if left_all else ~longer)
        # Names that match at both ends meet twice, and only one of the two rows stays.
        long, short = (c("a_name"), c("name")) if left_all else (c("name"), c("a_name"))
        pairs = pairs.filter(c("_key").startswith("e") == long.endswith(short))
        found = pairs if found is None else found.unionByName(pairs)
    found = found.filter(names_match(c("a_name"), c("name"))).withColumn("metres", distance)
    return found.filter(c("metres") <= radius_m).drop("_cell", "_key")


def near_a_namesake(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` within ``radius_m`` whose normalized name matches, once or a few times.

    ``left``: a_name, a_lat, a_lng, ``right``: name, lat, lng. Names are compared once per cell, and the search
    for a row ends at its first namesake: pairs of rows are not made.
    """
    from ..functions.fold import names_match

    reach = radius_m + 1.0
    left = left.filter(c("a_lat").isNotNull() & (c("a_name") != "")).withColumn(
        "_cell", F.explode(cover(c("a_lat"), c("a_lng"), F.lit(reach), reach))
    )
    right = right.filter(c("lat").isNotNull() & (c("name") != "")).withColumn("_cell", cell_of(c("lat"), c("lng"), reach))
    asked, held = left.select("_cell", "a_name").distinct(), right.select("_cell", "name").distinct()
    names = None
    for left_all in (True, False):
        a = asked.withColumn("_key", F.explode(_affix_keys(c("a_name"), "es", left_all)))
        b = held.withColumn("_key", F.explode(_affix_keys(c("name"), "es", not left_all)))
        met = shuffled(a).join(shuffled(b), ["_cell", "_key"]).filter(names_match(c("a_name"), c("name")))
        names = met if names is None else names.unionByName(met)
    names = names.select("_cell", "a_name", c("name").alias("_name")).distinct()
    there = right.select(c("_cell").alias("_b_cell"), "name", "lat", "lng")
    on = (c("_cell") == c("_b_cell")) & (c("_name") == c("name")) & (whole_metres() <= radius_m)
    sought = shuffled(left).join(shuffled(names), ["_cell", "a_name"])
    return sought.join(shuffled(there), on, "left_semi").drop("_cell", "_name")
