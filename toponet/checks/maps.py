"""Map views, visibility predicates and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import mapview, spatial
from . import sqltext as q
from .registry import check

c = F.col

BOX = (-120.0, -60.0, 150.0, 45.0)
WRAP = (100.0, 50.0, -60.0, -60.0)


@check("s01_table_scan", "select place_id, name, status from fx_places where status = 'verified'")
def s01(v):
    return v.places.filter(c("status") == "verified").select("place_id", "name", "status")


@check("p01_mappable_places", f"select place_id from ({q.MAPPABLE})")
def p01(v):
    return mapview.mappable(v.places, v.evidence).select("place_id")


@check(
    "p02_viewport",
    """select place_id, lat between -60 and 45 and lng between -120 and 150 in_box,
      lat between -60 and 50 and (lng >= 100 or lng <= -60) in_wrapped
    from fx_places where lat is not null""",
)
def p02(v):
    rows = v.places.filter(c("lat").isNotNull())
    return rows.select(
        "place_id",
        geo.in_viewport(c("lat"), c("lng"), *BOX).alias("in_box"),
        geo.in_viewport(c("lat"), c("lng"), *WRAP).alias("in_wrapped"),
    )


@check(
    "p03_places_of_kinds",
    """select place_id from fx_places p where exists (select 1 from fx_links l
      join fx_works w on w.work_id = l.work_id
      where l.place_id = p.place_id and w.kind in ('book', 'album'))
      and exists (select 1 from fx_links l where l.place_id = p.place_id and l.work_id between 3 and 3)
    union all select place_id from fx_places p where exists (select 1 from fx_links l
      join fx_works w on w.work_id = l.work_id where l.place_id = p.place_id and w.kind = 'series')""",
)
def p03(v):
    both = mapview.at_works(v.places, v.links, v.works, work_id=3, kinds=["book", "album"])
    series = mapview.at_works(v.places, v.links, v.works, kinds=["series"])
    return both.select("place_id").unionByName(series.select("place_id"))


@check("p04_visible_queue", f"select id from ({q.VISIBLE_QUEUE})")
def p04(v):
    return mapview.visible_queue(v.submissions).select("id")


@check(
    "p09_matchable_for_frames",
    """select p.place_id from fx_places p where p.lat is not null and p.wikidata_id is not null
      and p.geocode_precision in ('point', 'building', 'street')
      and exists (select 1 from fx_links l where l.place_id = p.place_id
        and l.relation_kind not in ('narrative_location', 'inspiration_for', 'replica', 'author_place', 'artist_place'))""",
)
def p09(v):
    from ..operators import cards

    return cards.matchable_for_frames(v.places, v.links).select("place_id")


@check(
    "p15_fictional_places",
    """select place_id, wikidata_id, name, (select count(*) from fx_links l
        where l.place_id = p.place_id) work_count
    from fx_places p where place_class = 'fictional' order by name, place_id limit 200""",
)
def p15(v):
    return mapview.fictional_places(v.places, v.links)


@check(
    "a01_grid_clusters",
    f"""select cast(floor(lng / greatest(0.0005, 360.0 / 2048)) as bigint) gx,
      cast(floor(lat / greatest(0.0005, 360.0 / 2048)) as bigint) gy,
      round(avg(lat), 6) lat, round(avg(lng), 6) lng, count(*) cluster_count,
      arg_min(name, (-confidence, name)) sample_name, bool_or(place_class = 'studio_interior') has_studio
    from ({q.MAPPABLE}) where lat between -60 and 45 and lng between -120 and 150
    group by 1, 2 order by cluster_count desc, gy, gx limit 2000""",
)
def a01(v):
    shown = mapview.in_view(mapview.mappable(v.places, v.evidence), BOX)
    rows = mapview.grid_clusters(shown, zoom=6)
    return rows.withColumn("lat", F.round("lat", 6)).withColumn("lng", F.round("lng", 6))


@check(
    "a02_queue_clusters",
    f"""select cast(floor(lng / greatest(0.0005, 360.0 / 8192)) as bigint) gx,
      cast(floor(lat / greatest(0.0005, 360.0 / 8192)) as bigint) gy,
      round(avg(lat), 6) lat, round(avg(lng), 6) lng, count(*) cluster_count,
      count(distinct work_id) work_count, min(place_name) sample_name
    from ({q.VISIBLE_QUEUE}) group by 1, 2 order by cluster_count desc, gy, gx limit 2000""",
)
def a02(v):
    rows = mapview.queue_clusters(mapview.visible_queue(v.submissions), zoom=8)
    return rows.withColumn("lat", F.round("lat", 6)).withColumn("lng", F.round("lng", 6))


@check(
    "a03_one_row_per_coordinate",
    f"""with seen as (select round(s.lat, 5) glat, round(s.lng, 5) glng, s.*, w.title, w.year, w.kind,
        coalesce(r.score, t.score) score, case when r.score is not null then r.votes else t.votes end votes,
        case when r.score is not null then 'imdb' when t.score is not null then 'tmdb' end rating_source
      from ({q.VISIBLE_QUEUE}) s join fx_works w on w.work_id = s.work_id
      left join fx_ratings r on r.work_id = w.work_id and r.source = 'imdb'
      left join fx_ratings t on t.work_id = w.work_id and t.source = 'tmdb'),
    films as (select distinct glat, glng, work_id, title, year, kind, place_name, source_kind, source_url,
        status, rating_source, score, votes, source_sentence from seen),
    ranked as (select *, row_number() over (partition by glat, glng order by title, work_id, year, kind,
        place_name, source_kind, source_url, status, rating_source nulls first, score nulls first,
        votes nulls first, source_sentence nulls first) n from films)
    select p.*, f.films_shown, f.first_title, f.last_title, f.votes_shown from
      (select glat, glng, arg_min(place_name, (length(place_name), place_name)) place_name,
        count(*) row_count, count(distinct work_id) work_count,
        case when bool_or(status = 'verified') then 'verified' else 'pending' end status
        from seen group by 1, 2) p
      join (select glat, glng, count(*) films_shown, min(title) first_title, max(title) last_title,
        sum(coalesce(votes, 0)) votes_shown from ranked where n <= 40 group by 1, 2) f using (glat, glng)""",
)
def a03(v):
    rows = mapview.queue_points(mapview.visible_queue(v.submissions), v.works, v.ratings)
    votes = F.aggregate(
        "films", F.lit(0).cast("long"),
        lambda acc, x: acc + F.coalesce(x["rating_votes"], F.lit(0).cast("long")),
    )
    return rows.select(
        "glat", "glng", "place_name", "row_count", "work_count", "status",
        F.size("films").cast("long").alias("films_shown"),
        F.get("films", F.lit(0))["title"].alias("first_title"),
        F.element_at("films", -1)["title"].alias("last_title"),
        votes.alias("votes_shown"),
    )


@check(
    "a11_subject_counts",
    """select place_id, (select count(*) from fx_evidence e where e.subject_type = 'place'
        and e.subject_id = p.place_id) evidence_count,
      (select count(*) from fx_links l where l.place_id = p.place_id) work_count from fx_places p""",
)
def a11(v):
    return mapview.with_counts(v.places, v.evidence, v.links).select(
        "place_id", "evidence_count", "work_count"
    )


@check(
    "t13_points_in_view",
    f"""select place_id, name, confidence, (select count(*) from fx_evidence e
        where e.subject_type = 'place' and e.subject_id = p.place_id) evidence_count,
      (select count(*) from fx_links l where l.place_id = p.place_id) work_count
    from ({q.MAPPABLE}) p where lat between -60 and 45 and lng between -120 and 150
    order by confidence desc, name, place_id limit 100""",
)
def t13(v):
    rows = mapview.points_in_view(v.places, v.evidence, v.links, BOX, limit=100)
    return rows.select("place_id", "name", "confidence", "evidence_count", "work_count")


@check(
    "s16_map_features",
    f"""select place_id, case when place_class = 'studio_interior' then 'studio'
        when place_class = 'narrative_real' then 'narrative'
        when geocode_precision in ('country', 'city') then 'approximate' else 'exact' end badge,
      case when wikidata_id is not null then concat('https://www.wikidata.org/wiki/', wikidata_id) end source_url,
      (select count(*) from ({q.MAPPABLE})) >= 1000 truncated, name
    from ({q.MAPPABLE})""",
)
def s16(v):
    rows = mapview.point_features(mapview.mappable(v.places, v.evidence))
    name = F.get_json_object("feature", "$.properties.name")
    return rows.select("place_id", "badge", "source_url", "truncated", name.alias("name"))


@check(
    "a13_films_in_view",
    f"""with shown as (select * from ({q.VISIBLE_QUEUE}) where lat between -60 and 45 and lng between -120 and 150),
    lots as (select distinct lot_id from fx_lot_vertices),
    rings as (select a.lot_id, a.lat alat, a.lng alng, b.lat blat, b.lng blng from fx_lot_vertices a
      join fx_lot_vertices b on a.lot_id = b.lot_id and b.vertex_no = (a.vertex_no + 3) % 4),
    inside as (select s.id from shown s join (select lot_id, min(lat) s, max(lat) n, min(lng) w, max(lng) e
        from fx_lot_vertices group by 1) x on s.lat between x.s and x.n and s.lng between x.w and x.e
      join rings r on r.lot_id = x.lot_id
      group by s.id, x.lot_id having sum(case when (r.alat > s.lat) <> (r.blat > s.lat)
        and s.lng < (r.blng - r.alng) * (s.lat - r.alat) / (r.blat - r.alat) + r.alng then 1 else 0 end) % 2 = 1)
    select work_id, count(*) place_count, count(distinct (lat, lng)) distinct_places,
      bool_and(id in (select id from inside)) on_a_lot_only from shown group by 1""",
)
def a13(v):
    shown = mapview.in_view(mapview.visible_queue(v.submissions), BOX)
    lots = spatial.polygons(v.lot_vertices, "lot_id", "vertex_no")
    inside = spatial.points_in_polygons(
        shown.select("id", "lat", "lng"), "id", lots, "lot_id"
    ).select("id", F.lit(True).alias("lot"))
    rows = shown.join(inside, "id", "left")
    return mapview.films_in_view(rows, F.coalesce("lot", F.lit(False)))
