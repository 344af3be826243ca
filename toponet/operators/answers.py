"""Search answers and located claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fold, geo
from . import matching, spatial
from .grouped import grouped_map
from ..session import cut_lineage
from .mapview import visible_queue

c = F.col


def search_answer(links: DataFrame, places: DataFrame, submissions: DataFrame) -> DataFrame:
    """Places of every work: stated ones (or the fallback relation), then queue rows
    that are not already among them by name within 150 m."""
    spots = places.filter(c("lat").isNotNull()).select("place_id", "name", "lat", "lng")
    stated = matching.best_relation(
        links.join(spots, "place_id"), ["filming_location", "narrative_location"]
    )
    queued = visible_queue(submissions).select("work_id", "id", "place_name", "lat", "lng")
    shown = queued.select(
        "work_id", fold.normalize_name(c("place_name")).alias("a_name"),
        c("lat").alias("a_lat"), c("lng").alias("a_lng"),
    ).distinct().withColumn("a_id", F.xxhash64("work_id", "a_name", "a_lat", "a_lng"))
    held = stated.select(
        c("work_id").alias("h_work"), fold.normalize_name(c("name")).alias("name"), "lat", "lng",
        c("place_id").alias("id"),
    ).distinct()
    # Cells far wider than the reach: most points are in one or two of them, not in nine.
    reach, size = 151.0, 755.0
    near = (
        shown.withColumn("_cell", F.explode(spatial.cover(c("a_lat"), c("a_lng"), F.lit(reach), size)))
        .join(
            held.withColumn("_cell", spatial.cell_of(c("lat"), c("lng"), size)).withColumnRenamed("h_work", "work_id"),
            ["work_id", "_cell"],
        )
        .filter(fold.names_match(c("a_name"), c("name")) & (spatial.whole_metres() <= 150))
    )
    known = near.select("work_id", "a_name", "a_lat", "a_lng").distinct()
    same = (
        (queued["work_id"] == known["work_id"])
        & (fold.normalize_name(queued["place_name"]) == known["a_name"])
        & (queued["lat"] == known["a_lat"])
        & (queued["lng"] == known["a_lng"])
    )
    fresh = queued.join(known, same, "left_anti")
    return stated.select(
        "work_id", F.lit("stated").alias("tier"), c("place_id").alias("ref"), "lat", "lng"
    ).unionByName(
        fresh.select("work_id", F.lit("queued").alias("tier"), c("id").alias("ref"), "lat", "lng")
    )


SAME_PLACE_M = 50.0


def accept_located(claims: DataFrame, known: DataFrame, anchors: DataFrame) -> DataFrame:
    """Located claims of each city: not known there, inside its radius, each place once.

    A claim repeats a place by id, by name or within 50 m. Against the known places
    that is a lookup on three keys. Among the claims, in id order, one is refused if it
    repeats an accepted earlier one; what repeats a refused claim only isn't refused.
    Equal claims are one shape.
    """
    rows = claims.withColumn("key", fold.normalize_name(c("name")))
    shapes = rows.groupBy("anchor_id", "key", "lat", "lng", "wikidata_id").agg(
        F.min("id").alias("sid")
    )
    held = known.withColumn("key", fold.normalize_name(c("name")))
    by_id = held.filter(c("wikidata_id").isNotNull()).select("anchor_id", "wikidata_id").distinct()
    by_name = held.filter(c("key") != "").select("anchor_id", "key").distinct()
    reach = SAME_PLACE_M + 1
    around = held.select("anchor_id", c("lat").alias("a_lat"), c("lng").alias("a_lng")).distinct().withColumn(
        "_cell", F.explode(spatial.cover(c("a_lat"), c("a_lng"), F.lit(reach), reach))
    )
    placed = shapes.withColumn("_cell", spatial.cell_of(c("lat"), c("lng"), reach))
    near = around.join(placed, ["anchor_id", "_cell"]).filter(
        spatial.whole_metres() <= SAME_PLACE_M
    ).select("sid").distinct()
    centre = anchors.select("anchor_id", c("lat").alias("c_lat"), c("lng").alias("c_lng"), "radius_km")
    km = geo.haversine_m(c("c_lat"), c("c_lng"), c("lat"), c("lng")) / 1000
    judged = (
        shapes.join(by_id.withColumn("_i", F.lit(True)), ["anchor_id", "wikidata_id"], "left")
        .join(by_name.withColumn("_n", F.lit(True)), ["anchor_id", "key"], "left")
        .join(near.withColumn("_m", F.lit(True)), "sid", "left")
        .join(centre, "anchor_id")
    )
    why = F.when(F.coalesce("_i", "_n", "_m", F.lit(False)), "already_on_map").when(
        km > c("radius_km"), "outside_city"
    )
    judged = cut_lineage(
        judged.withColumn("why", why).drop("_i", "_n", "_m", "c_lat", "c_lng", "radius_km")
    )
    refused = _repeats(judged.filter(c("why").isNull())).select(
        "sid", F.lit("repeats_an_accepted_claim").alias("again")
    )
    final = judged.join(refused, "sid", "left").select(
        "anchor_id", "key", "lat", "lng", "sid",
        F.coalesce("wikidata_id", F.lit("")).alias("_w"),
        F.coalesce("why", "again").alias("shape_reason"),
    )
    keyed = rows.withColumn("_w", F.coalesce("wikidata_id", F.lit("")))
    reason = F.coalesce(
        "shape_reason", F.when(c("id") != c("sid"), "repeats_an_accepted_claim")
    )
    return keyed.join(final, ["anchor_id", "key", "lat", "lng", "_w"]).select(
        "id", "anchor_id", reason.alias("reason")
    )


def _repeats(shapes: DataFrame) -> DataFrame:
    """Shapes (sid) that repeat an accepted earlier one of their city.

    In blocks of a city's claims in id order: what an earlier block accepted refuses by joins
    on the name, the id and pairs of neighbours; the claims of one block are decided in one
    pass. No key's shapes are paired with each other, and a city of any size takes its number
    of claims over the block size in rounds.
    """
    from ..plans import blocks

    reach = SAME_PLACE_M + 1
    b = shapes.withColumn("_cell", spatial.cell_of(c("lat"), c("lng"), reach))
    a = shapes.select(
        "anchor_id", c("sid").alias("a"), c("lat").alias("a_lat"), c("lng").alias("a_lng")
    ).withColumn("_cell", F.explode(spatial.cover(c("a_lat"), c("a_lng"), F.lit(reach), reach)))
    close = a.join(b, ["anchor_id", "_cell"]).filter(
        (c("a") < c("sid")) & (spatial.whole_metres() <= SAME_PLACE_M)
    ).select("a", "sid").distinct()
    nodes = blocks.number_blocks(
        shapes.select(c("sid").alias("node"), c("anchor_id").alias("component"), "key", "wikidata_id"),
        F.floor(c("node") / 4096),
    )
    links = cut_lineage(
        close.join(nodes.select(c("node").alias("sid"), "component", c("block").alias("v_block")), "sid")
        .join(nodes.select(c("node").alias("a"), c("block").alias("u_block")), "a")
    )

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list] = {}
        rows = []
        for kind, node, other, key, id_, gone in zip(*(pdf[x] for x in ("kind", "node", "other", "key", "wikidata_id", "gone"))):
            if kind == 0:
                rows.append((node, key, id_, gone))
            else:
                near.setdefault(node, []).append(other)
        taken, names, ids, out = set(), set(), set(), []
        for node, key, id_, gone in sorted(rows, key=lambda x: x[0]):
            fine = not (gone or key in names or id_ in ids or any(x in taken for x in near.get(node, ())))
            if fine:
                taken.add(node)
                if key:
                    names.add(key)
                if id_:
                    ids.add(id_)
            out.append((pdf["component"].iloc[0], node, key, id_, fine))
        return pd.DataFrame(out, columns=["component", "node", "key", "wikidata_id", "ok"])

    def step(part: DataFrame, k: int, done: DataFrame | None) -> DataFrame:
        mine = links.filter(c("v_block") == k)
        rows = part.select("component", "node", "key", "wikidata_id")
        if done is None:
            rows = rows.withColumn("gone", F.lit(False))
        else:
            there = done.filter("ok")
            beaten = mine.join(there.select(c("node").alias("a")), "a", "left_semi").select(c("sid").alias("node"))
            for key in ("key", "wikidata_id"):
                held = there.filter(F.coalesce(c(key), F.lit("")) != "").select("component", key).distinct()
                beaten = beaten.unionByName(rows.join(held, ["component", key], "left_semi").select("node"))
            rows = rows.join(beaten.distinct().withColumn("gone", F.lit(True)), "node", "left").withColumn(
                "gone", F.coalesce("gone", F.lit(False))
            )
        rows = rows.select(
            "component", F.lit(0).alias("kind"), "node", c("node").alias("other"), "key", "wikidata_id", "gone"
        ).unionByName(mine.filter(c("u_block") == k).select(
            "component", F.lit(1).alias("kind"), c("sid").alias("node"), c("a").alias("other"),
            F.lit("").alias("key"), F.lit(None).cast("string").alias("wikidata_id"), F.lit(False).alias("gone"),
        ))
        return grouped_map(
            rows, "component", assign, "component long, node long, key string, wikidata_id string, ok boolean"
        )

    return blocks.by_blocks(nodes, step).filter(~c("ok")).select(c("node").alias("sid"))
