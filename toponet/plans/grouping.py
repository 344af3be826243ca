"""Shapes and mergeable pairs of places (groups follow below)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import normalize_name
from ..operators import spatial
from ..session import computed
from . import blocks

c = F.col

MERGE_RADIUS_M = 40.0
PRECISE = ["point", "building", "street"]


def shapes(places: DataFrame) -> DataFrame:
    """One row per distinct (name, point, class, precision, id).

    Rows of one shape always end in one group, so everything after works on
    shapes: a coordinate copied a million times is one row here.
    """
    return (
        places.filter(c("lat").isNotNull())
        .withColumn("name", normalize_name(c("name")))
        .groupBy("name", "lat", "lng", "place_class", "geocode_precision", "wikidata_id")
        .agg(F.min("place_id").alias("id"), F.count(F.lit(1)).alias("members"))
    )


def mergeable_pairs(shapes_: DataFrame) -> DataFrame:
    """Pairs of shapes that may be one place: near, alike, no contradicting id."""
    fine = shapes_.filter(c("geocode_precision").isin(PRECISE))
    a = fine.select(
        c("id").alias("a_id"), c("name").alias("a_name"), c("lat").alias("a_lat"),
        c("lng").alias("a_lng"), c("place_class").alias("a_class"),
        c("geocode_precision").alias("a_precision"), c("wikidata_id").alias("a_wikidata"),
    )
    pairs = spatial.near_named_pairs(a, fine, MERGE_RADIUS_M)
    same_kind = (c("a_class") == c("place_class")) & (c("a_precision") == c("geocode_precision"))
    no_conflict = (
        c("a_wikidata").isNull() | c("wikidata_id").isNull() | (c("a_wikidata") == c("wikidata_id"))
    )
    return pairs.filter((c("a_id") < c("id")) & same_kind & no_conflict).select(
        "a_id", c("id").alias("b_id"), "metres"
    )


#: Edges up to which a round is one task. A round never has more than the one before.
LITTLE = 50_000


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.inline(F.array(F.struct("u", "v"), F.struct(c("v").alias("u"), c("u").alias("v")))))


def _small_round(pairs: DataFrame) -> DataFrame:
    """Both stars over few edges, without a shuffle or a join."""
    there = Window.partitionBy("u")
    least = _both_ways(pairs.coalesce(1)).withColumn("m", F.least(F.min("v").over(there), "u"))
    large = least.filter(c("v") > c("u")).select(c("v").alias("u"), c("m").alias("v")).distinct()
    made = F.array(F.struct("u", c("m").alias("v")), F.struct(c("v").alias("u"), c("m").alias("v")))
    small = large.withColumn("m", F.min("v").over(there)).select(F.inline(made))
    return small.filter(c("u") != c("v")).distinct()


def _round(pairs: DataFrame) -> DataFrame:
    """The same over any number of edges; a hub's edges need not lie together."""
    both = _both_ways(pairs)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").filter(c("v") > c("u")).select(
        c("v").alias("u"), c("m").alias("v")
    ).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").filter(c("v") != c("m")).select(
        c("v").alias("u"), c("m").alias("v")
    )
    return small.unionByName(low.select("u", c("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge list (a, b); the component is its smallest node.

    Alternating large-star and small-star rounds: the number of rounds grows with
    the logarithm of the longest chain, and a hub's edges are re-pointed instead
    of multiplied. Every round is checkpointed; two aggregates decide when the
    edge set stands still. A few edges go in one task: five shuffles of a few rows
    each cost far more tasks, files and plans than they are worth.
    """
    from ..session import cut_lineage

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    pairs = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).filter(c("u") != c("v")).distinct()
    pairs = cut_lineage(pairs)
    before = state(pairs)
    while before[0]:
        pairs = cut_lineage(_small_round(pairs) if before[0] <= LITTLE else _round(pairs))
        after = state(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(c("v").alias("node"), c("v").alias("component")).distinct()
    return pairs.select(c("u").alias("node"), c("v").alias("component")).unionByName(roots)


def greedy_groups(edges: DataFrame, every: bool) -> DataFrame:
    """(node, group) of the nodes in an edge list, greedy in node order.

    A node joins the first group in which every (or any) member is its
    neighbour, else it opens one; the group is named by its first node. Two
    nodes can only share a group along a chain of edges, so the pass runs per
    connected component, in blocks of bounded size, and equals the pass over everything.
    """
    from ..session import cut_lineage

    edges = cut_lineage(edges.select("a", "b"))
    return blocks.greedy(edges, components(edges), every)


def place_groups(places: DataFrame) -> DataFrame:
    """Group of every located place: near-duplicates that all merge pairwise."""
    distinct = shapes(places)
    edges = mergeable_pairs(distinct).select(c("a_id").alias("a"), c("b_id").alias("b"))
    grouped = greedy_groups(edges, every=True)
    keyed = distinct.join(grouped, c("id") == c("node"), "left").withColumn(
        "group_id", F.coalesce("grp", "id")
    )
    match = ["name", "lat", "lng", "place_class", "geocode_precision"]
    placed = places.filter(c("lat").isNotNull()).withColumn("_n", normalize_name(c("name")))
    on = placed["_n"] == keyed["name"]
    for x in match[1:]:
        on = on & (placed[x] == keyed[x])
    on = on & placed["wikidata_id"].eqNullSafe(keyed["wikidata_id"])
    # Coarse places never merge, not even equal ones: each stays its own group.
    fine = placed["geocode_precision"].isin(PRECISE)
    rows = placed.join(keyed.select(*[keyed[x] for x in match], "wikidata_id", "group_id"), on)
    return rows.select(
        placed["place_id"], placed["wikidata_id"], placed["confidence"],
        F.when(fine, c("group_id")).otherwise(placed["place_id"]).alias("group_id"),
    )


def surviving_places(groups: DataFrame, links: DataFrame) -> DataFrame:
    """One row per group: the kept place, members, distinct works of all members."""
    order = F.struct(
        c("wikidata_id").isNull(), -F.coalesce("confidence", F.lit(0.0)), c("place_id")
    )
    kept = groups.groupBy("group_id").agg(
        F.min_by("place_id", order).alias("place_id"), F.count(F.lit(1)).alias("merged_count")
    )
    works = (
        links.select("work_id", "place_id")
        .join(groups.select("place_id", "group_id"), "place_id")
        .select("group_id", "work_id").distinct()
        .groupBy("group_id").agg(F.count(F.lit(1)).alias("works"))
    )
    return kept.join(works, "group_id", "left").withColumn(
        "works", F.coalesce("works", F.lit(0).cast("long"))
    )


DONORS = ["moviemaps", "permit_record", "wikipedia"]


#: Names of a work up to which one row holds and compares them all.
FEW_NAMES = 64


def _clusters_of(names: Column) -> Column:
    """(id, name, cluster_id) of the few ``names`` (id, name) of a work, in id order.

    A name joins the first cluster that holds a match, else it opens one.
    """
    from ..functions.fold import names_match

    kind = "array<struct<id:bigint,name:string,words:int,cluster_id:bigint>>"

    def add(made: Column, one: Column) -> Column:
        alike = F.filter(made, lambda x: names_match(x["name"], one["name"], (x["words"], one["words"])))
        first = F.array_min(F.transform(alike, lambda x: x["cluster_id"]))
        row = F.struct(
            one["id"].alias("id"), one["name"].alias("name"), one["words"].alias("words"),
            F.coalesce(first, one["id"]).alias("cluster_id"),
        )
        return F.concat(made, F.array(row).cast(kind))

    counted = F.transform(
        F.array_sort(names),
        lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), F.size(F.split(x["name"], " ")).alias("words")),
    )
    return F.aggregate(counted, F.array().cast(kind), add)


def _many_name_clusters(heads: DataFrame) -> DataFrame:
    """(work_id, name, cluster_id) of works with any number of names, which meet on their affixes."""
    from ..functions.fold import names_match

    a = heads.select("work_id", c("name").alias("a_name"), c("id").alias("a_id"))
    pairs = None
    for left_all in (True, False):
        left = a.withColumn("_k", F.explode(spatial._affix_keys(c("a_name"), "es", left_all)))
        right = heads.withColumn("_k", F.explode(spatial._affix_keys(c("name"), "es", not left_all)))
        found = spatial.shuffled(left).join(spatial.shuffled(right), ["work_id", "_k"]).filter(c("a_id") < c("id"))
        found = found.filter(names_match(c("a_name"), c("name"))).select(
            c("a_id").alias("a"), c("id").alias("b")
        )
        pairs = found if pairs is None else pairs.unionByName(found)
    grouped = greedy_groups(pairs.distinct(), every=False)
    return heads.join(grouped, c("id") == c("node"), "left").select(
        "work_id", "name", F.coalesce("grp", "id").alias("cluster_id")
    )


def name_clusters(submissions: DataFrame) -> DataFrame:
    """Cluster of every named queue row within its work.

    Names are compared once per (work, name), in order of first appearance; all
    rows of one name stay together. The names of a work are one row where they are
    few. Those of a work with very many names meet on their affixes, so it is not
    paired with itself.
    """
    from ..operators.numbering import top_per_key
    from ..session import cut_lineage, snapshot

    rows = submissions.filter(c("work_id").isNotNull()).select(
        "id", "work_id", "place_name", "source_kind", "lat", "lng"
    )
    named = snapshot(computed(rows, name=normalize_name(c("place_name"))).filter(c("name") != ""))
    heads = named.groupBy("work_id", "name").agg(F.min("id").alias("id"))
    listed = snapshot(
        top_per_key(heads, ["work_id"], [c("id")], FEW_NAMES + 1).groupBy("work_id")
        .agg(F.collect_list(F.struct("id", "name")).alias("names"))
    )
    few = listed.filter(F.size("names") <= FEW_NAMES).select("work_id", F.inline(_clusters_of(c("names"))))
    keyed = few.select("work_id", "name", "cluster_id")
    crowded = listed.filter(F.size("names") > FEW_NAMES).select("work_id")
    if not crowded.isEmpty():
        many = cut_lineage(heads.join(crowded, "work_id", "left_semi"))
        keyed = keyed.unionByName(cut_lineage(_many_name_clusters(many)))
    return named.join(spatial.shuffled(keyed), ["work_id", "name"])


def corroborations(clusters: DataFrame) -> DataFrame:
    """Queue rows that another source confirms: how many, which sources, borrowed point.

    The cluster table holds who is in which cluster; rows carry counts instead of
    the list of all others, which would be quadratic in the cluster.
    """
    donor_rank = F.array_position(F.lit(DONORS), c("source_kind"))
    has_point = c("lat").isNotNull() & c("lng").isNotNull()
    donor = F.when(
        has_point & (donor_rank > 0),
        F.struct(donor_rank.alias("r"), "id", "lat", "lng", "source_kind"),
    )
    per_source = clusters.groupBy("cluster_id", "source_kind").agg(
        F.count(F.lit(1)).alias("n"), F.min(donor).alias("donor")
    )
    totals = per_source.groupBy("cluster_id").agg(
        F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("kinds"), F.min("donor").alias("donor"),
        F.sort_array(F.collect_list(F.struct("source_kind", "n"))).alias("sources"),  # a handful of kinds
    )
    rows = clusters.filter(c("source_kind").isNotNull()).join(totals.filter(c("kinds") > 1), "cluster_id")
    all_kinds = F.array_compact(F.transform("sources", lambda x: x["source_kind"]))
    its = F.get(F.filter("sources", lambda x: x["source_kind"] == c("source_kind")), F.lit(0))["n"]
    borrows = ~has_point & c("donor").isNotNull() & (c("donor.id") != c("id"))
    return rows.select(
        "id",
        "cluster_id",
        (c("n_all") - its).alias("others"),
        F.array_remove(all_kinds, c("source_kind")).alias("other_kinds"),
        F.when(borrows, c("donor.id")).alias("donor_id"),
        F.when(borrows, c("donor.lat")).otherwise(c("lat")).alias("lat"),
        F.when(borrows, c("donor.lng")).otherwise(c("lng")).alias("lng"),
        F.when(borrows, F.concat(c("donor.source_kind"), F.lit("_via_corroboration")))
        .alias("geocode_source"),
    )


def corroboration_lists(clusters: DataFrame) -> DataFrame:
    """(cluster_id, source_kind, rows): the rows of each source in clusters that several sources hold.

    A row is confirmed by all rows of its cluster's other sources: its list is every list of the
    cluster but its own source's. So all lists together are as long as the queue, while one per
    row would be quadratic in the cluster.
    """
    # Rows are dealt out once; a cluster's lists, a handful, lie together.
    lists = clusters.repartition("cluster_id").groupBy("cluster_id", "source_kind").agg(
        F.sort_array(F.collect_list(F.struct("id", "place_name"))).alias("rows")
    )
    there = Window.partitionBy("cluster_id")
    kinds = lists.withColumn("_a", F.min("source_kind").over(there)).withColumn("_b", F.max("source_kind").over(there))
    return kinds.filter(c("_a") != c("_b")).drop("_a", "_b")


# --- same spot -----------------------------------------------------------------------
SAME_POINT_M = 5.0


def _prefix_match(a, b):
    """Equal names, or one goes on after the other with a blank."""
    return (a == b) | b.startswith(F.concat(a, F.lit(" "))) | a.startswith(F.concat(b, F.lit(" ")))


def spot_groups(stops: DataFrame) -> DataFrame:
    """Stops collapsed to spots: within 5 m, or within 40 m and a name prefix.

    ``stops``: stop_id (text), name, lat, lng. Works on distinct (name, point).
    Components are built over points: neighbours within 5 m plus name matches
    within 40 m. The pairs of all names on one crowded point are never made; a
    stop is tested against what the names of a group's points allow together.
    """
    from ..session import cut_lineage

    # Stops and shapes are read several times below; both become snapshots.
    stops = cut_lineage(stops.withColumn("key", normalize_name(c("name"))))
    shaped = stops.groupBy("key", "lat", "lng").agg(F.min("stop_id").alias("first_stop"))
    shaped = cut_lineage(shaped.withColumn("point", F.xxhash64("lat", "lng")))
    points = shaped.select(c("point").alias("id"), "lat", "lng").distinct()
    around = cut_lineage(
        spatial.within_radius(
            points.select(c("id").alias("a"), c("lat").alias("a_lat"), c("lng").alias("a_lng")),
            points, MERGE_RADIUS_M + 0.5, 50.0, spatial.whole_metres(), c("metres") <= MERGE_RADIUS_M,
        ).select("a", c("id").alias("b"), (c("metres") <= SAME_POINT_M).alias("close"))
    )
    near = around.filter("close").select("a", "b")
    # A name prefix ends before a blank: both sides meet on every such prefix.
    words = F.split("key", " ")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " ")
    )
    shorter = shaped.filter(c("key") != "").select(
        c("point").alias("a"), c("key").alias("_k"), c("lat").alias("a_lat"), c("lng").alias("a_lng")
    )
    longer = shaped.filter(c("key") != "").select(
        c("point").alias("b"), F.explode(prefixes).alias("_k"), "lat", "lng"
    )
    size = MERGE_RADIUS_M + 1
    left = shorter.withColumn(
        "_cell", F.explode(spatial.cover(c("a_lat"), c("a_lng"), F.lit(size), size))
    )
    right = longer.withColumn("_cell", spatial.cell_of(c("lat"), c("lng"), size))
    named = spatial.shuffled(left).join(spatial.shuffled(right), ["_cell", "_k"]).filter(
        spatial.whole_metres() <= MERGE_RADIUS_M
    ).select("a", "b")
    comps = components(near.unionByName(named).filter(c("a") != c("b")))
    rows = shaped.join(comps, c("point") == c("node"), "left").withColumn(
        "component", F.coalesce("component", "point")
    )

    made = blocks.same_spots(
        rows.select(c("first_stop").alias("node"), "key", "point", "component"),
        around.select(c("a").alias("p"), c("b").alias("q"), "close"),
    )
    placed = shaped.join(made, c("first_stop") == c("node")).select("key", "lat", "lng", c("grp").alias("spot_id"))
    return stops.join(placed, ["key", "lat", "lng"])


def collapsed_spots(spotted: DataFrame) -> DataFrame:
    """One row per spot: the shortest-named stop, members, distinct works."""
    order = F.struct(F.length("name"), c("stop_id"))
    works = spotted.select("spot_id", "work_id").distinct().groupBy("spot_id").agg(
        F.count("work_id").alias("works")
    )
    return spotted.groupBy("spot_id").agg(
        F.min_by(F.struct("stop_id", "name", "lat", "lng", "verified"), order).alias("_p"),
        F.count(F.lit(1)).alias("merged_count"),
    ).join(works, "spot_id").select("spot_id", "_p.*", "merged_count", "works")


ANSWER_RADIUS_M = 150.0


def answer_groups(points: DataFrame) -> DataFrame:
    """Answer points merged: within 150 m of a group's first point and a name that
    fits the group's current (shortest) name.

    ``points``: point_id, name, lat, lng. A group's name is always a member's
    name, so members are linked by name matches within 300 m; those links make
    the components, not bare distance, and they are made between cells of names.
    """
    from ..session import cut_lineage

    points = cut_lineage(points)
    shaped = cut_lineage(
        points.withColumn("name_key", normalize_name(c("name")))
        .groupBy("name", "name_key", "lat", "lng")
        .agg(F.min("point_id").alias("id"))
    )
    made = blocks.first_fit(
        shaped.select(c("id").alias("node"), "name", c("name_key").alias("key"), "lat", "lng"),
        ANSWER_RADIUS_M, _answer_names_alike, _answer_name_fits, lambda one, two: len(one) < len(two),
    )
    placed = shaped.join(made, c("id") == c("node")).select("name", "lat", "lng", c("grp").alias("group_id"))
    return points.join(placed, ["name", "lat", "lng"])


def affix_match(one: str, two: str) -> bool:
    """Equal keys, or one is the other's beginning or end and has a word less at most."""
    if not one or not two:
        return False
    x, y = one.split(" "), two.split(" ")
    short, long = (one, two) if len(x) <= len(y) else (two, one)
    return one == two or abs(len(x) - len(y)) <= 1 and (long.endswith(short) or long.startswith(short))


def _answer_names_alike(short: Column, long: Column) -> Column:
    """``_answer_name_fits`` of keys of which the first begins or ends the second."""
    from ..functions.fold import names_match

    goes_on = (F.size(F.split(short, " ")) >= 2) & long.startswith(F.concat(short, F.lit(" ")))
    return names_match(short, long) | goes_on


def _answer_name_fits(one: str, two: str) -> bool:
    """As ``affix_match``, or one goes on after the other, which has two words or more."""
    if affix_match(one, two):
        return True
    short, long = sorted((one, two), key=len)
    return len(short.split(" ")) >= 2 and long.startswith(short + " ")


def merged_answers(grouped: DataFrame) -> DataFrame:
    """One row per group: shortest name (earliest on a tie), members, distinct works."""
    films = grouped.select("group_id", "work_id").distinct().groupBy("group_id").agg(
        F.count("work_id").alias("film_count")
    )
    order = F.struct(F.length("name"), c("point_id"))
    return grouped.groupBy("group_id").agg(
        F.min_by("name", order).alias("name"), F.count(F.lit(1)).alias("points")
    ).join(films, "group_id")
