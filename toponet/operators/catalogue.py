"""Catalogue, A-Z directory, city pages and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fold, geo, ratings as ra
from . import spatial
from .numbering import top_per_key

c = F.col

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def catalogue_index(works: DataFrame, submissions: DataFrame) -> DataFrame:
    """Works with at least one located, unrejected queue row."""
    counts = (
        submissions.filter((c("status") != "rejected") & c("lat").isNotNull())
        .groupBy("work_id")
        .agg(F.count(F.lit(1)).alias("place_count"))
    )
    return works.join(counts, "work_id").withColumn(
        "title_norm", fold.normalize_title(c("title"))
    )


def letter_totals(index: DataFrame) -> DataFrame:
    """Works and places per letter."""
    return index.groupBy(fold.letter_bucket(c("title_norm")).alias("letter")).agg(
        F.count(F.lit(1)).alias("works"), F.sum("place_count").alias("points")
    )


def letter_page(index: DataFrame, letter: str, page: int, per_page: int = 100) -> DataFrame:
    """One page of a letter with its position; out-of-range pages are clamped.

    The total is a scalar subquery over the same filtered rows.
    """
    wanted = letter.lower() if letter.lower() in LETTERS else "#"
    size = max(1, min(per_page, 500))
    rows = index.withColumn("sort_key", fold.directory_sort_key(c("title_norm"))).filter(
        fold.letter_bucket(c("title_norm")) == wanted
    )
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    held = total.first()["n"]
    pages = max(1, -(-held // size))
    current = min(max(page, 1), pages)
    offset = (current - 1) * size
    return (
        rows.orderBy("sort_key", c("year").asc_nulls_last(), "work_id")
        .offset(offset)
        .limit(size)
        .select(
            "work_id", "title", "place_count",
            F.lit(held).cast("long").alias("total_works"),
            F.lit(current).alias("page"),
            F.lit(current < pages).alias("has_next"),
        )
    )


def near_anchors(anchors: DataFrame, submissions: DataFrame) -> DataFrame:
    """Located queue rows within each anchor's radius (1 to 200 km).

    Rows that agree in work, name and point are counted before the spatial
    join, so copies of one place cross it once.
    """
    rows = (
        submissions.filter((c("status") != "rejected") & geo.has_point(c("lat"), c("lng")))
        .groupBy("work_id", "place_name", "lat", "lng")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    around = anchors.select(
        "anchor_id", c("lat").alias("a_lat"), c("lng").alias("a_lng"),
        (F.greatest(F.lit(1.0), F.least(F.coalesce("radius_km", F.lit(20.0)), F.lit(200.0))) * 1000)
        .alias("radius_m"),
    )
    return spatial.within_radius(around, rows, c("radius_m"), 5000.0, spatial.great_circle())


def anchor_totals(near: DataFrame, anchors: DataFrame) -> DataFrame:
    """Works and points per anchor, zero included."""
    per_work = near.groupBy("anchor_id", "work_id").agg(F.sum("n").alias("n"))
    totals = per_work.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("works"), F.sum("n").alias("points")
    )
    zero = F.lit(0).cast("long")
    return anchors.select("anchor_id").join(totals, "anchor_id", "left").select(
        "anchor_id", F.coalesce("works", zero).alias("works"), F.coalesce("points", zero).alias("points")
    )


def city_works(near: DataFrame, works: DataFrame, limit: int = 60) -> DataFrame:
    """Works of each anchor by places held, with up to six place names and totals."""
    names = near.groupBy("anchor_id", "work_id", "place_name").agg(F.sum("n").alias("n"))
    grouped = names.groupBy("anchor_id", "work_id").agg(F.sum("n").alias("place_count"))
    first = top_per_key(names, ["anchor_id", "work_id"], [c("place_name")], 6)
    first = first.groupBy("anchor_id", "work_id").agg(
        F.sort_array(F.collect_list("place_name")).alias("places")
    )
    totals = grouped.groupBy("anchor_id").agg(
        F.count(F.lit(1)).alias("total_works"), F.sum("place_count").alias("total_points")
    )
    rows = grouped.join(works.select("work_id", "title"), "work_id")
    best = top_per_key(
        rows, ["anchor_id"], [F.desc("place_count"), c("title"), c("work_id")], max(1, min(limit, 200))
    )
    return best.join(first, ["anchor_id", "work_id"]).join(totals, "anchor_id")


def cities_by_country(cities: DataFrame) -> DataFrame:
    """Cities nested by country, both ordered by works; the city table is a dimension."""
    return cities.groupBy("country_id").agg(
        F.sum("works").alias("works"),
        F.transform(
            F.sort_array(F.collect_list(F.struct((-c("works")).alias("w"), "name"))),
            lambda x: x["name"],
        ).alias("cities"),
    )


def mapped_works(links: DataFrame, works: DataFrame, mappable: DataFrame, ratings: DataFrame) -> DataFrame:
    """Works with mapped places, and their ratings in display order."""
    on_map = links.join(mappable.select("place_id"), "place_id", "left_semi")
    pairs = on_map.select("work_id", "place_id").distinct()
    counts = pairs.groupBy("work_id").agg(F.count(F.lit(1)).alias("place_count"))
    order = F.array_position(F.lit(ra.RATING_ORDER), c("source"))
    # At most one row per (work, source), so the list is short.
    lists = ratings.groupBy("work_id").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), "source", "score"))).alias("ratings")
    )
    return works.join(counts, "work_id").join(lists, "work_id", "left")


def notable(works: DataFrame, rated: DataFrame, limit: int = 5) -> DataFrame:
    """Most notable works of ``rated`` (source, score, votes per work)."""
    value = ra.notability(c("rating_source"), c("rating_score"), c("rating_votes"))
    rows = works.join(rated, "work_id").withColumn("notability", value)
    return rows.filter(c("notability").isNotNull()).orderBy(
        F.desc("notability"), "title", "work_id"
    ).limit(limit)


def interests_deck(links: DataFrame, places: DataFrame, works: DataFrame, ratings: DataFrame,
                   lat: float, lng: float, radius_km: float = 25.0, limit: int = 60,
                   books: int = 20) -> DataFrame:
    """Cards to choose interests from: famous non-books, then books, near ones first."""
    import math

    dlat = radius_km / 111.0
    dlng = radius_km / (111.0 * max(math.cos(math.radians(lat)), 0.2))
    near = c("lat").between(lat - dlat, lat + dlat) & c("lng").between(lng - dlng, lng + dlng)
    pairs = links.select("work_id", "place_id").distinct().join(
        places.select("place_id", "lat", "lng"), "place_id"
    )
    placed = pairs.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("places"), F.count(F.when(near, 1)).alias("nearby")
    )
    fame = F.round(c("score") / 10 * F.log10(c("votes").cast("double")), 3)
    rated = ratings.filter((c("source") == "imdb") & (c("votes") >= 1000)).select(
        "work_id", fame.alias("fame")
    )
    ranked = works.select("work_id", "title", "kind").join(placed, "work_id").join(
        rated, "work_id", "left"
    )
    here = (c("nearby") > 0).desc()
    screen = ranked.filter((c("kind") != "book") & c("fame").isNotNull()).orderBy(
        here, F.desc("fame"), "work_id"
    ).limit(limit)
    print_ = ranked.filter(c("kind") == "book").orderBy(here, F.desc("places"), "work_id").limit(books)
    return screen.unionByName(print_)


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of a normalized text, words padded."""

    def pieces(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.char_length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))
        )

    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, pieces)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    left, right = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(left, right))
    return both / F.nullif(F.size(left) + F.size(right) - both, F.lit(0))


def search_works(works: DataFrame, links: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Title search: exact, prefix, word start, then trigram likeness above 0.2."""
    q = F.lit(query)
    title = c("title_norm")
    rows = works.withColumn("title_norm", fold.normalize_title(c("title"))).withColumn(
        "likeness", F.coalesce(similarity(title, q), F.lit(0.0))
    )
    inside = F.instr(title, f" {query}") > 0
    rank = (
        F.when(title == q, 4.0).when(title.startswith(query), 3.0).when(inside, 2.0)
        .otherwise(1.0 + c("likeness"))
    )
    found = rows.filter(
        (q != "") & (title.startswith(query) | inside | (c("likeness") > 0.2))
    ).withColumn("rank", rank)
    counts = links.join(found.select("work_id"), "work_id", "left_semi").groupBy("work_id").agg(
        F.count(F.lit(1)).alias("link_count")
    )
    return (
        found.join(counts, "work_id", "left")
        .withColumn("link_count", F.coalesce("link_count", F.lit(0).cast("long")))
        .orderBy(F.desc("rank"), F.desc("link_count"), F.length("title"), "title", "work_id")
        .limit(max(1, min(limit, 25)))
    )


def city_suggestions(candidates: DataFrame, limit: int = 5) -> DataFrame:
    """Inhabited places first, then fame, population and the shorter name."""
    lived_in = c("population").isNotNull() | c("area_km2").isNotNull()
    return candidates.orderBy(
        lived_in.desc(), F.desc("sitelinks"), F.coalesce("population", F.lit(0)).desc(),
        F.length("name"), "city_id",
    ).limit(max(1, limit))


def works_per_host(pages: DataFrame) -> DataFrame:
    """Sites by the number of pages they hold."""
    host = F.parse_url("url", F.lit("HOST"))
    return pages.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("page_count"))


def nearby_works(links: DataFrame, max_works: int = 5, max_per_work: int = 6) -> DataFrame:
    """Works with the most places, at most six places each."""
    counts = links.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "work_id").limit(max_works)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "work_id"))
    best = best.withColumn("work_rank", rank)  # over at most ``max_works`` rows
    rows = links.join(best, "work_id")
    return top_per_key(rows, ["work_id"], [c("narrative_order"), c("link_id")], max_per_work)


def balanced_kinds(counts: DataFrame, kinds: list[str], max_works: int) -> DataFrame:
    """Works taken in turn from each kind, the largest of a kind first."""
    turn = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "work_id"))
    known = counts.filter(c("kind").isin(kinds)).withColumn("turn", turn).filter(
        c("turn") <= max_works
    )
    place = F.array_position(F.lit(kinds), c("kind"))
    return known.orderBy("turn", place).limit(max_works)


def with_totals(rows: DataFrame, value: str) -> DataFrame:
    """Row count and sum beside every row, computed once as scalar subqueries."""
    count = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    total = rows.agg(F.sum(value).alias("s")).scalar()
    return rows.withColumn("total_works", count).withColumn("total_points", total)


def label_ceiling(queue: DataFrame, works: DataFrame, rated: DataFrame, limit: int = 8) -> DataFrame:
    """Coordinates labelled with their most notable work, the best ``limit`` of them.

    Each coordinate first keeps its own best work (a fixed-size aggregate), then
    one top-k over coordinates.
    """
    value = ra.notability(c("rating_source"), c("rating_score"), c("rating_votes"))
    ranked = works.select("work_id", "title").join(rated, "work_id").withColumn("v", value)
    spots = queue.select("work_id", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))
    best = (
        spots.join(ranked.filter(c("v").isNotNull()), "work_id")
        .groupBy("lat", "lng")
        .agg(F.min(F.struct((-c("v")).alias("v"), "title", "work_id")).alias("_b"))
    )
    return best.orderBy(
        "_b.v", "_b.title", "_b.work_id", "lat", "lng"
    ).limit(limit).select("lat", "lng", c("_b.title").alias("title"))


def membership(works: DataFrame, owned: DataFrame, located: DataFrame) -> DataFrame:
    """Works with flags: owned by somebody, located somewhere."""
    return (
        works.join(owned.distinct().withColumn("_o", F.lit(True)), "work_id", "left")
        .join(located.distinct().withColumn("_l", F.lit(True)), "work_id", "left")
        .select(
            "work_id",
            F.coalesce("_o", F.lit(False)).alias("in_library"),
            F.coalesce("_l", F.lit(False)).alias("has_places"),
        )
    )
