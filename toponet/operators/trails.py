"""Story trails: numbering, legs, runs, chapters, walking order, tiles, stops.

A trail has any number of stops; where one is written, ``bounded_trails`` may hold it to
24. The walking order is searched from every start up to that size; longer trails are
ordered too, from their first stop, and improved up to ``MATRIX_STOPS`` stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial
from .grouped import grouped_map
from .numbering import group_ranks, top_per_key, with_previous

c = F.col

MAX_STOPS = 24
MATRIX_STOPS, LONG_PASSES = 1000, 2
LONG_LEG_M = 3000.0
ROUTER_STOPS = 5
CHAPTER_KM, NAMING_KM = 50.0, 40.0
CORRIDOR_M, MAX_TILES, WALK_ZOOMS = 120.0, 400, (13, 14)


def bounded_trails(stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stops of trails within the size limit, and the works beyond it with a reason."""
    sizes = stops.groupBy("work_id").agg(F.count(F.lit(1)).alias("stops"))
    small = sizes.filter(c("stops") <= MAX_STOPS).select("work_id")
    large = sizes.filter(c("stops") > MAX_STOPS).withColumn("reason", F.lit("too_many_stops"))
    return stops.join(small, "work_id", "left_semi"), large


def renumber(scenes: DataFrame) -> DataFrame:
    """Scenes 1..N per work; of a repeated index the first row stays."""
    rest = [x for x in scenes.columns if x not in ("work_id", "sequence_index")]
    first = scenes.groupBy("work_id", "sequence_index").agg(F.min(F.struct(*rest)).alias("_r"))
    rows = first.select("work_id", "sequence_index", "_r.*")
    return group_ranks(
        rows, ["work_id"], [c("sequence_index")], F.floor(c("sequence_index") / 4096), "position"
    )


def legs(stops: DataFrame) -> DataFrame:
    """Stops with the metres from the stop before (NULL for the first)."""
    ranked = group_ranks(
        stops, ["work_id"], [c("sequence_index")], F.floor(c("sequence_index") / 4096), "rank"
    )
    pairs = with_previous(ranked, ["work_id"], "rank", ["lat", "lng"])
    metres = geo.haversine_m(c("prev_lat"), c("prev_lng"), c("lat"), c("lng"))
    return pairs.withColumn("leg_m", metres)


def path_length(with_legs: DataFrame) -> DataFrame:
    """Length and long legs of every trail."""
    return with_legs.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("stops"),
        F.sum("leg_m").alias("path_m"),
        F.count(F.when(c("leg_m") > LONG_LEG_M, 1)).alias("long_legs"),
    )


def walk_runs(with_legs: DataFrame) -> DataFrame:
    """Pieces of at most five stops walked in one go; neighbours share an end."""
    order = Window.partitionBy("work_id").orderBy("rank")
    run = F.sum(F.when(c("leg_m") > LONG_LEG_M, 1).otherwise(0)).over(order)
    rows = with_legs.withColumn("run", run)
    inside = Window.partitionBy("work_id", "run")
    rows = rows.withColumn("p", F.row_number().over(inside.orderBy("rank")) - 1).withColumn(
        "n", F.count(F.lit(1)).over(inside)
    )
    step = ROUTER_STOPS - 1
    own = F.floor(c("p") / step).cast("int")
    shared = F.when((c("p") % step == 0) & (c("p") > 0), own - 1)
    pieces = F.filter(
        F.array(own, shared), lambda k: k.isNotNull() & (k * step < c("n") - 1)
    )
    return rows.filter(c("n") >= 2).select(
        "work_id", "run", F.explode(pieces).alias("piece"), "sequence_index"
    )


def distinct_stops(placed: DataFrame) -> DataFrame:
    """Best-precision stop per text position, without stops near an earlier kept one.

    ``placed``: work_id, at, stop_id, precision_rank, lat, lng; one bounded trail
    per work, folded in order.
    """
    best = placed.groupBy("work_id", "at").agg(
        F.min(F.struct((-c("precision_rank")).alias("p"), "stop_id", "lat", "lng")).alias("_b")
    )
    ordered = best.groupBy("work_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("at", c("_b.stop_id").alias("stop_id"), c("_b.lat").alias("lat"), c("_b.lng").alias("lng"))
            )
        ).alias("stops")
    )

    def fold(kept, stop):
        near = F.exists(
            kept,
            lambda k: F.coalesce(
                geo.haversine_m(k["lat"], k["lng"], stop["lat"], stop["lng"]) <= 40.0, F.lit(False)
            ),
        )
        return F.when(near, kept).otherwise(F.concat(kept, F.array(stop)))

    empty = F.filter("stops", lambda s: F.lit(False))
    return ordered.select("work_id", F.explode(F.aggregate("stops", empty, fold)).alias("s")).select(
        "work_id", "s.at", "s.stop_id"
    )


def next_stops(walkers: DataFrame, stops: DataFrame, by: str) -> DataFrame:
    """Next unvisited stop of each walker: in sequence, or the nearest.

    ``walkers``: user_id, trail_id, lat, lng, visited (highest visited index).
    """
    left = walkers.join(
        stops.select(
            c("work_id").alias("trail_id"), "sequence_index", c("lat").alias("s_lat"), c("lng").alias("s_lng")
        ),
        "trail_id",
    ).filter(c("sequence_index") > c("visited"))
    metres = geo.half_up(geo.haversine_m(c("lat"), c("lng"), c("s_lat"), c("s_lng")))
    left = left.withColumn("metres", metres)
    if by == "nearest":
        left = left.filter(c("metres").isNotNull())
        order = F.struct("metres", "sequence_index")
    else:
        order = F.struct("sequence_index", "metres")
    best = left.groupBy("user_id").agg(F.min(order).alias("_b"))
    return best.select(
        "user_id",
        c("_b.sequence_index").alias("sequence_index"),
        c("_b.metres").alias("metres"),
        geo.walking_minutes(c("_b.metres")).alias("eta_minutes"),
        F.coalesce(c("_b.metres") <= 35, F.lit(False)).alias("arrived"),
    )


def chapters(stops: DataFrame, cities: DataFrame) -> DataFrame:
    """Chapter of every stop: single linkage at 50 km inside a work, named by the
    nearest city within 40 km of the chapter's centre, else by its first stop.

    Stops meet on (work, cell); links become components.
    """
    from ..plans.grouping import components

    nodes = stops.filter(c("lat").isNotNull()).select(
        "work_id", "sequence_index", "lat", "lng",
        F.xxhash64("work_id", "sequence_index").alias("node_id"),
        (c("name") if "name" in stops.columns else F.lit(None).cast("string")).alias("stop_name"),
    )
    size = CHAPTER_KM * 1000
    spots = nodes.groupBy("work_id", "lat", "lng").agg(F.min("node_id").alias("spot"))
    a = spots.select(
        "work_id", c("spot").alias("a"), c("lat").alias("a_lat"), c("lng").alias("a_lng")
    ).withColumn("_cell", F.explode(spatial.cover(c("a_lat"), c("a_lng"), F.lit(size), size)))
    b = spots.withColumn("_cell", spatial.cell_of(c("lat"), c("lng"), size))
    near = a.join(b, ["work_id", "_cell"]).filter(
        (c("a") < c("spot")) & (spatial.great_circle() <= size)
    ).select("a", c("spot").alias("b"))
    rows = (
        nodes.join(spots, ["work_id", "lat", "lng"])
        .join(components(near), c("spot") == c("node"), "left")
        .withColumn("chapter_key", F.coalesce("component", "spot"))
    )
    groups = rows.groupBy("work_id", "chapter_key").agg(
        F.min("sequence_index").alias("first"), F.count(F.lit(1)).alias("stops"),
        F.avg("lat").alias("lat"), F.avg("lng").alias("lng"),
        F.min_by("stop_name", "sequence_index").alias("first_name"),
    )
    around = cities.select("name", c("lat").alias("a_lat"), c("lng").alias("a_lng"))
    named = spatial.within_radius(
        around, groups, NAMING_KM * 1000, NAMING_KM * 1000, spatial.great_circle()
    ).groupBy("work_id", "chapter_key").agg(F.min(F.struct("metres", "name"))["name"].alias("city"))
    out = group_ranks(groups, ["work_id"], [c("first")], F.floor(c("first") / 4096), "chapter")
    return out.join(named, ["work_id", "chapter_key"], "left").select(
        "work_id", "chapter", "first", "stops", F.coalesce("city", "first_name", F.lit("Elsewhere")).alias("name")
    )


WALK_ROW = "work_id long, walk_index int, sequence_index int, path_km double"


def walking_order(stops: DataFrame) -> DataFrame:
    """Short walking order of each trail: nearest neighbour from every start (from the
    first stop only on trails over ``MAX_STOPS``), improved by reversing pieces, the
    shortest path kept. One trail is one task's work."""
    import numpy as np
    import pandas as pd

    def improve(path: list[int], d: np.ndarray) -> list[int]:
        n, passes = len(path), 0
        better = True
        while better and (n <= MAX_STOPS or passes < LONG_PASSES):
            better, passes = False, passes + 1
            for i in range(n - 1):
                for j in range(i + 1, n):
                    change = 0.0
                    if i > 0:
                        change += d[path[i - 1], path[j]] - d[path[i - 1], path[i]]
                    if j < n - 1:
                        change += d[path[i], path[j + 1]] - d[path[j], path[j + 1]]
                    if change < -1e-9:
                        path[i : j + 1] = path[i : j + 1][::-1]
                        better = True
        return path

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence_index").reset_index(drop=True)
        lat, lng = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lng"].to_numpy())
        n = len(pdf)

        def km_between(i, j):
            h = (
                np.sin((lat[i] - lat[j]) / 2) ** 2
                + np.cos(lat[i]) * np.cos(lat[j]) * np.sin((lng[i] - lng[j]) / 2) ** 2
            )
            return 2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

        every = np.arange(n)
        d = km_between(every[:, None], every[None, :]) if n <= MATRIX_STOPS else None
        best, best_km = list(range(n)), float(sum(km_between(i, i + 1) for i in range(n - 1)))
        if n >= 3:
            best = None
            for start in range(n if n <= MAX_STOPS else 1):
                path, left = [start], np.delete(every, start)
                while len(left):
                    near = d[path[-1], left] if d is not None else km_between(path[-1], left)
                    at = int(np.argmin(near))
                    path.append(int(left[at]))
                    left = np.delete(left, at)
                if d is not None:
                    path = improve(path, d)
                km = float(sum(km_between(a, b) for a, b in zip(path, path[1:])))
                if best is None or km < best_km:
                    best, best_km = path, km
        return pd.DataFrame(
            {
                "work_id": pdf["work_id"].iloc[0],
                "walk_index": np.arange(1, n + 1),
                "sequence_index": pdf["sequence_index"].to_numpy()[best],
                "path_km": best_km,
            }
        )

    located = stops.filter(c("lat").isNotNull()).select("work_id", "sequence_index", "lat", "lng")
    return grouped_map(located, "work_id", order, WALK_ROW)


def corridor_tiles(with_legs: DataFrame) -> DataFrame:
    """Map tiles along each trail in first-seen order, at most 400 per trail, and how
    many there would be.

    A leg of any length is a rectangle of tiles per zoom. Of each leg only the first
    ``2 * MAX_TILES`` tiles are made: fewer than ``MAX_TILES`` of them can be known
    from earlier legs, so no later tile of it can be among the first ``MAX_TILES``.
    The count is the area of the union of the rectangles.
    """
    mid = (c("prev_lat") + c("lat")) / 2
    dlat = CORRIDOR_M / geo.METRES_PER_DEGREE
    dlng = F.lit(CORRIDOR_M) / (
        geo.METRES_PER_DEGREE * F.greatest(F.lit(0.2), F.cos(F.radians(mid)))
    )
    south, north = F.least("prev_lat", "lat") - dlat, F.greatest("prev_lat", "lat") + dlat
    west, east = F.least("prev_lng", "lng") - dlng, F.greatest("prev_lng", "lng") + dlng
    boxes = F.array(*[
        F.struct(
            F.lit(z).alias("z"), geo.tile_x(west, z).alias("x0"), geo.tile_x(east, z).alias("x1"),
            geo.tile_y(north, z).alias("y0"), geo.tile_y(south, z).alias("y1"),
        )
        for z in WALK_ZOOMS
    ])
    legs_ = with_legs.filter(c("prev_lat").isNotNull()).select("work_id", "rank", boxes.alias("boxes"))
    rectangles = legs_.select("work_id", "rank", F.explode("boxes").alias("b")).select("work_id", "rank", "b.*")
    rows = c("y1") - c("y0") + 1
    upto = F.least((c("x1") - c("x0") + 1) * rows, F.lit(2 * MAX_TILES))
    tiles = _first_rectangles(rectangles).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), (upto - 1).cast("long")))).select(
        "work_id", "rank", "z", (c("x0") + F.floor(c("k") / rows)).cast("long").alias("x"),
        (c("y0") + c("k") % rows).cast("long").alias("y"),
    )
    seen = tiles.groupBy("work_id", "z", "x", "y").agg(F.min("rank").alias("leg"))
    first = top_per_key(seen, ["work_id"], [c("leg"), c("z"), c("x"), c("y")], MAX_TILES)
    return first.join(_union_area(rectangles), "work_id").withColumn("truncated", c("wanted") > MAX_TILES)


def _first_rectangles(rectangles: DataFrame) -> DataFrame:
    """Rectangles up to the first of each work that alone has ``MAX_TILES`` tiles.

    All its tiles come before those first seen in a later leg or zoom, so none of these is among the first.
    """
    area = (c("x1") - c("x0") + 1) * (c("y1") - c("y0") + 1)
    at = F.struct("rank", "z")
    filled = F.min(F.when(area >= MAX_TILES, at)).over(Window.partitionBy("work_id"))
    return rectangles.withColumn("_filled", filled).filter(c("_filled").isNull() | (at <= c("_filled"))).drop("_filled")


def _union_area(rectangles: DataFrame) -> DataFrame:
    """Tiles of the union of each work's rectangles: strips between x edges, then y intervals."""
    keys = ["work_id", "z"]
    edges = rectangles.select(*keys, F.explode(F.array("x0", c("x1") + 1)).alias("x")).distinct()
    strips = edges.withColumn("next", F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))).filter(
        c("next").isNotNull()
    )
    parts = rectangles.join(strips, keys).filter((c("x") >= c("x0")) & (c("x") <= c("x1"))).select(
        *keys, "x", "next", "y0", "y1"
    ).distinct()
    before = Window.partitionBy(*keys, "x").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    fresh = c("y1") - F.greatest(c("y0"), F.coalesce(F.max("y1").over(before) + 1, c("y0"))) + 1
    return parts.select("work_id", ((c("next") - c("x")) * F.greatest(fresh, F.lit(0))).alias("n")).groupBy(
        "work_id"
    ).agg(F.sum("n").cast("long").alias("wanted"))


def place_scenes(scenes: DataFrame, links: DataFrame) -> DataFrame:
    """Scenes set on the links of their work and place: filming links first, then the
    oldest; each link takes one scene."""
    order = [
        (c("relation_kind") != "filming_location").cast("int"), c("created_at"), c("link_id")
    ]
    free = links.withColumn(
        "turn", F.row_number().over(Window.partitionBy("work_id", "place_id").orderBy(*order))
    ).select("work_id", "place_id", "turn", "link_id", "relation_kind")
    asked = scenes.withColumn(
        "turn",
        F.row_number().over(Window.partitionBy("work_id", "place_id").orderBy("sequence_index")),
    )
    return asked.join(free, ["work_id", "place_id", "turn"])


def trail_stops(placed: DataFrame, places: DataFrame) -> DataFrame:
    """Stops of a trail: located, never fictional, in story order."""
    real = places.filter(c("lat").isNotNull() & (c("place_class") != "fictional")).select(
        "place_id", "name", "lat", "lng", "geocode_precision"
    )
    return placed.join(real, "place_id")


def trail_candidates(links: DataFrame, places: DataFrame, works: DataFrame, ratings: DataFrame,
                     box: tuple[float, float, float, float], minimum: int, limit: int) -> DataFrame:
    """Famous films with enough walkable places in a box."""
    good = places.filter(
        geo.in_viewport(c("lat"), c("lng"), *box)
        & c("geocode_precision").isin("point", "building", "street")
    ).select("place_id")
    walkable = links.select("work_id", "place_id").distinct().join(good, "place_id", "left_semi")
    counts = walkable.groupBy("work_id").agg(F.count(F.lit(1)).alias("walkable"))
    fame = c("score") / 10 * F.log10(c("votes").cast("double"))
    rated = ratings.filter((c("source") == "imdb") & (c("votes") >= 1000)).select(
        "work_id", fame.alias("fame")
    )
    return (
        works.filter(c("kind") == "film").select("work_id", "title")
        .join(counts.filter(c("walkable") >= minimum), "work_id")
        .join(rated, "work_id")
        .orderBy(F.desc("fame"), "work_id")
        .limit(limit)
    )
