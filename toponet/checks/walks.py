"""Snapping, streets, trails, trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import mapview, snapping, spatial, trails
from ..plans import trips
from . import sqltext as q
from .registry import check

c = F.col


def buildings(v):
    """Lots as buildings; every second one bears a name."""
    rings = spatial.polygons(v.lot_vertices, "lot_id", "vertex_no").withColumnRenamed("lot_id", "building_id")
    none = F.lit(None).cast("string")
    return rings.withColumn(
        "b_name", F.when(c("building_id") % 2 == 0, "Union Station").otherwise("City Hall Museum")
    ).withColumn("house_number", none).withColumn("b_street", none)


_EDGES = """edges as (select a.lot_id, a.lat alat, a.lng alng, b.lat blat, b.lng blng from fx_lot_vertices a
    join fx_lot_vertices b on a.lot_id = b.lot_id and b.vertex_no = (a.vertex_no + 1) % 4)"""


def _near_lots(alias: str = "p") -> str:
    scale = f"cos(radians({alias}.lat))"
    ax, ay = f"((e.alng - {alias}.lng) * {scale} * 111320.0)", f"((e.alat - {alias}.lat) * 111320.0)"
    bx, by = f"((e.blng - {alias}.lng) * {scale} * 111320.0)", f"((e.blat - {alias}.lat) * 111320.0)"
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    t = f"greatest(0, least(1, (-{ax} * {dx} - {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    d = f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"
    return f"""select {alias}.place_id id, e.lot_id, {q.half_up(f'min({d})')} m,
      sum(case when (e.alat > {alias}.lat) <> (e.blat > {alias}.lat)
        and {alias}.lng < (e.blng - e.alng) * ({alias}.lat - e.alat) / (e.blat - e.alat) + e.alng then 1 else 0 end) % 2 = 1 inside
    from fx_places {alias} join edges e on abs({alias}.lat - e.alat) < 0.02 group by {alias}.place_id, e.lot_id, {alias}.lat, {alias}.lng"""


@check(
    "j09_snap_to_building",
    f"""with {_EDGES}, near as ({_near_lots()}),
    named as (select n.*, (lot_id % 2 = 0 and p.name = 'Union Station') or (lot_id % 2 = 1 and p.name = 'City Hall') ok from near n join fx_places p on p.place_id = n.id),
    stats as (select id, count(case when inside then 1 end) n_in, min(case when inside then lot_id end) b_in, count(case when m <= 60 then 1 end) n_near, min(case when m <= 60 then lot_id end) b_near,
      count(case when ok and (inside or m <= 60) then 1 end) n_named, min(case when ok and (inside or m <= 60) then lot_id end) b_named from named group by 1),
    judged as (select p.place_id id, p.lat, p.lng, p.geocode_precision = 'city' vague, coalesce(n_in, 0) n_in, b_in, coalesce(n_near, 0) n_near, b_near, coalesce(n_named, 0) n_named, b_named
      from fx_places p left join stats s on s.id = p.place_id),
    reasons as (select *, case when lat is null then 'no_coordinate' when vague and n_named = 1 then 'confirmed_by_name' when vague and n_named > 1 then 'ambiguous_named' when vague then 'area_not_a_building'
      when n_in = 1 then 'inside_footprint' when n_in > 1 then 'ambiguous_overlap' when n_near = 1 then 'only_building_nearby' when n_near = 0 then 'no_buildings' else 'ambiguous_neighbours' end r from judged),
    picked as (select *, case r when 'confirmed_by_name' then b_named when 'inside_footprint' then b_in when 'only_building_nearby' then b_near end b from reasons),
    rings as (select lot_id, list(struct_pack(lat := lat, lng := lng) order by vertex_no) ring from fx_lot_vertices group by 1),
    e2 as (select e.*, o.lat olat, o.lng olng, (e.alng - o.lng) * (e.blat - o.lat) - (e.blng - o.lng) * (e.alat - o.lat) cr from edges e
      join (select lot_id, lat, lng from fx_lot_vertices where vertex_no = 0) o using (lot_id)),
    cent as (select lot_id, any_value(olat) + sum((alat - olat + blat - olat) * cr) / (3 * sum(cr)) clat, any_value(olng) + sum((alng - olng + blng - olng) * cr) / (3 * sum(cr)) clng from e2 group by 1),
    moved as (select p.*, n.inside, clat, clng, {q.half_up(q.metres('p.lat', 'p.lng', 'clat', 'clng'))} mv from picked p left join cent on lot_id = b left join near n on n.id = p.id and n.lot_id = p.b)
    select id, case when b is null or (mv > 100 and not inside) then false else true end snapped,
      case when b is null then r when mv > 100 and inside then 'kept_point_inside_large_footprint' when mv > 100 then 'snap_too_far' else r end reason,
      case when b is not null and (mv <= 100 or inside) then b end building_id, case when b is not null and mv <= 100 then mv else 0.0 end moved_m from moved""",
)
def j09(v):
    points = v.places.select(
        c("place_id").alias("id"), "name", c("geocode_precision").alias("precision"), "lat", "lng"
    )
    rows = snapping.snap_to_buildings(points, buildings(v))
    return rows.select("id", "snapped", "reason", "building_id", "moved_m")


@check("j09_snap_to_entrance")
def j09_entrance(v):
    points = v.places.select(
        c("place_id").alias("id"), "name", c("geocode_precision").alias("precision"), "lat", "lng"
    )
    doors = v.lot_vertices.filter(c("vertex_no") < 2).select(
        c("lot_id").alias("building_id"), (c("lot_id") * 10 + c("vertex_no")).alias("entrance_id"),
        (c("vertex_no") == 1).alias("main"), c("lat").alias("e_lat"), c("lng").alias("e_lng"),
    )
    return snapping.snap_to_buildings(points, buildings(v), doors)


@check(
    "j10_confirm_street",
    f"""with edges as (select a.lot_id, a.lat alat, a.lng alng, b.lat blat, b.lng blng from fx_lot_vertices a
      join fx_lot_vertices b on a.lot_id = b.lot_id and b.vertex_no = a.vertex_no + 1), near as ({_near_lots()})
    select p.place_id id, case when p.lat is null then 'no_coordinate' when p.name <> 'Market Square' then 'not_a_street_name' when s.lot is null then 'no_such_street_here'
      else 'on_named_street' end reason, s.lot street_id, s.m metres from fx_places p
    left join (select id, arg_min(lot_id, (m, lot_id)) lot, min(m) m from near n join fx_places x on x.place_id = n.id where x.name = 'Market Square' and m <= 30 and lot_id % 3 <> 0 group by 1) s on s.id = p.place_id""",
)
def j10(v):
    lines = spatial.polygons(v.lot_vertices, "lot_id", "vertex_no").select(
        c("lot_id").alias("street_id"), "ring", "south", "north", "west", "east",
        F.when(c("lot_id") % 3 == 0, "High Street").otherwise("Market Square").alias("s_name"),
    )
    points = v.places.select(c("place_id").alias("id"), "name", "lat", "lng")
    return snapping.confirm_streets(points, lines)


@check(
    "p10_walkable_stops",
    "select place_id from fx_places where lat is not null and (geocode_precision in ('point', 'building', 'street') or place_id % 11 = 0)",
)
def p10(v):
    from ..operators import cards

    building = F.when(c("place_id") % 11 == 0, "way/1")
    return cards.walkable(v.places.withColumn("osm_building_id", building)).select("place_id")


def stops(v):
    """Located scenes of every work."""
    return v.scenes.join(v.places.select("place_id", "lat", "lng"), "place_id").filter(
        c("lat").isNotNull()
    ).select("work_id", "sequence_index", "place_id", "lat", "lng")


_STOPS = """stops as (select s.work_id, s.sequence_index, s.place_id, p.lat, p.lng from fx_scenes s join fx_places p using (place_id) where p.lat is not null)"""
_LEGS = f"""{_STOPS}, legs as (select *, row_number() over w as rnk, lag(lat) over w plat, lag(lng) over w plng from stops window w as (partition by work_id order by sequence_index)),
  metered as (select *, {q.metres('plat', 'plng', 'lat', 'lng')} leg_m from legs)"""


@check(
    "w06_trail_renumber",
    """with s as (select work_id, cast(floor(sequence_index / 2) as int) i, min(place_id) place_id from fx_scenes group by 1, 2)
    select work_id, i sequence_index, place_id, cast(row_number() over (partition by work_id order by i) as int) "position" from s""",
)
def w06(v):
    rows = v.scenes.select(
        "work_id", F.floor(c("sequence_index") / 2).cast("int").alias("sequence_index"), "place_id"
    )
    return trails.renumber(rows)


@check(
    "w07_leg_distances",
    f"""with {_LEGS} select work_id, count(*) stops, round(sum(leg_m), 2) path_m, count(case when leg_m > 3000 then 1 end) long_legs from metered group by 1""",
)
def w07(v):
    rows = trails.path_length(trails.legs(stops(v)))
    return rows.withColumn("path_m", F.round("path_m", 2))


@check(
    "w08_walk_runs",
    f"""with {_LEGS}, runs as (select *, sum(case when leg_m > 3000 then 1 else 0 end) over (partition by work_id order by rnk) run from metered),
    p as (select *, row_number() over (partition by work_id, run order by rnk) - 1 p, count(*) over (partition by work_id, run) n from runs),
    pieces as (select *, p // 4 piece from p union all select *, p // 4 - 1 from p where p % 4 = 0 and p > 0)
    select work_id, cast(run as bigint) run, cast(piece as int) piece, sequence_index from pieces where n >= 2 and piece * 4 < n - 1""",
)
def w08(v):
    return trails.walk_runs(trails.legs(stops(v)))


@check("w10_distinct_stops")
def w10(v):
    placed = stops(v).select(
        "work_id", c("sequence_index").alias("at"), c("place_id").alias("stop_id"),
        (c("place_id") % 4).alias("precision_rank"), "lat", "lng",
    )
    return trails.distinct_stops(placed)


_WALKERS = """walkers as (select user_id, user_id * 7 % (select count(*) from fx_works) trail, arg_max(lat, (ts, fix_id)) lat, arg_max(lng, (ts, fix_id)) lng from fx_fixes group by 1)"""


@check(
    "w11_next_stop",
    f"""with {_STOPS}, {_WALKERS}, m as (select w.user_id, s.sequence_index, {q.half_up(q.metres('w.lat', 'w.lng', 's.lat', 's.lng'))} m
      from walkers w join stops s on s.work_id = w.trail where s.sequence_index > 1)
    select 'nearest' mode, user_id, arg_min(sequence_index, (m, sequence_index)) sequence_index, min(m) metres, min(m) <= 35 arrived from m group by 2
    union all select 'sequence', user_id, min(sequence_index), arg_min(m, sequence_index), arg_min(m, sequence_index) <= 35 from m group by 2""",
)
def w11(v):
    n = v.works.agg(F.count(F.lit(1)).alias("n")).scalar()
    last = F.max_by(F.struct("lat", "lng"), F.struct("ts", "fix_id"))
    walkers = v.fixes.groupBy("user_id").agg(last.alias("p")).select(
        "user_id", (c("user_id") * 7 % n).alias("trail_id"), "p.lat", "p.lng", F.lit(1).alias("visited")
    )
    trail = stops(v)
    both = trails.next_stops(walkers, trail, "nearest").withColumn("mode", F.lit("nearest")).unionByName(
        trails.next_stops(walkers, trail, "sequence").withColumn("mode", F.lit("sequence"))
    )
    return both.select("mode", "user_id", "sequence_index", "metres", "arrived")


@check("g04_trail_chapters")
def g04(v):
    named = stops(v).join(v.places.select("place_id", "name"), "place_id")
    return trails.chapters(named, v.anchors)


@check("g09_walking_order")
def g09(v):
    rows = trails.walking_order(stops(v))
    return rows.withColumn("path_km", F.round("path_km", 6))


def _x(col, z):
    return f"cast(floor(({col} + 180) / 360 * {2 ** z}) as bigint)"


def _y(col, z):
    return f"cast(floor((1 - ln(tan(radians({col})) + 1 / cos(radians({col}))) / pi()) / 2 * {2 ** z}) as bigint)"


_RECTS = " union all ".join(
    f"""select work_id, rnk, {z} z, {_x('w', z)} x0, {_x('e', z)} x1, {_y('n', z)} y0, {_y('s', z)} y1 from boxes""" for z in (13, 14)
)


@check(
    "g10_corridor_tiles",
    f"""with {_LEGS}, boxes as (select work_id, rnk, least(plat, lat) - 120 / 111320.0 s, greatest(plat, lat) + 120 / 111320.0 n,
      least(plng, lng) - 120 / (111320.0 * greatest(0.2, cos(radians((plat + lat) / 2)))) w, greatest(plng, lng) + 120 / (111320.0 * greatest(0.2, cos(radians((plat + lat) / 2)))) e
      from metered where plat is not null),
    rects as ({_RECTS}),
    tiles as (select work_id, rnk, z, x0 + k // (y1 - y0 + 1) x, y0 + k % (y1 - y0 + 1) y
      from (select *, unnest(range(least((x1 - x0 + 1) * (y1 - y0 + 1), 800))) k from rects)),
    seen as (select work_id, z, x, y, min(rnk) leg from tiles group by 1, 2, 3, 4),
    ranked as (select *, row_number() over (partition by work_id order by leg, z, x, y) r from seen),
    columns_ as (select distinct work_id, z, unnest(range(x0, x1 + 1)) x, y0, y1 from rects),
    reach as (select *, max(y1) over (partition by work_id, z, x order by y0, y1 rows between unbounded preceding and 1 preceding) e from columns_),
    area as (select work_id, cast(sum(greatest(y1 - greatest(y0, coalesce(e + 1, y0)) + 1, 0)) as bigint) wanted from reach group by 1)
    select work_id, z, x, y, wanted, wanted > 400 truncated from ranked join area using (work_id) where r <= 400""",
)
def g10(v):
    return trails.corridor_tiles(trails.legs(stops(v))).select("work_id", "z", "x", "y", "wanted", "truncated")


@check(
    "g13_trail_stops",
    """with asked as (select *, row_number() over (partition by work_id, place_id order by sequence_index) t from fx_scenes),
    free as (select *, row_number() over (partition by work_id, place_id order by relation_kind <> 'filming_location', created_at, link_id) t from fx_links)
    select a.work_id, a.sequence_index, a.place_id, f.link_id, p.name from asked a join free f using (work_id, place_id, t)
    join fx_places p using (place_id) where p.lat is not null and p.place_class <> 'fictional'""",
)
def g13(v):
    placed = trails.place_scenes(v.scenes, v.links)
    return trails.trail_stops(placed, v.places).select(
        "work_id", "sequence_index", "place_id", "link_id", "name"
    )


@check(
    "t12_trail_candidates",
    """with walkable as (select work_id, count(distinct place_id) walkable from fx_links where place_id in (select place_id from fx_places
      where lat between -60 and 45 and lng between -120 and 150 and geocode_precision in ('point', 'building', 'street')) group by 1)
    select w.work_id, w.title, k.walkable, round(r.score / 10 * log10(cast(r.votes as double)), 6) fame from fx_works w join walkable k using (work_id)
    join fx_ratings r on r.work_id = w.work_id and r.source = 'imdb' and r.votes >= 1000 where w.kind = 'film' and k.walkable >= 3 order by r.score / 10 * log10(cast(r.votes as double)) desc, w.work_id limit 50""",
)
def t12(v):
    rows = trails.trail_candidates(
        v.links, v.places, v.works, v.ratings, (-120.0, -60.0, 150.0, 45.0), 3, 50
    )
    return rows.select("work_id", "title", "walkable", F.round("fame", 6).alias("fame"))


def trip_rows(v):
    """Graph places and queue rows with what decides their eligibility."""
    lots = spatial.polygons(v.lot_vertices, "lot_id", "vertex_no")
    access = v.lot_vertices.groupBy("lot_id").agg(F.min("access").alias("lot_access"))
    graph = v.places.filter(c("status") == "verified").select(
        F.concat(F.lit("place:"), F.lpad(c("place_id").cast("string"), 12, "0")).alias("stop_id"),
        "name", "lat", "lng", "geocode_precision",
        F.when(c("place_id") % 9 == 0, 2).otherwise(0).alias("distance"),
        F.when(c("place_id") % 14 == 0, "closed").otherwise("unknown").alias("access"),
    )
    queue = v.submissions.filter((c("status") != "rejected") & c("place_id").isNull()).select(
        F.concat(F.lit("submission:"), F.lpad(c("id").cast("string"), 12, "0")).alias("stop_id"),
        c("place_name").alias("name"), "lat", "lng", F.lit(None).cast("string").alias("geocode_precision"),
        F.lit(0).alias("distance"), F.lit("unknown").alias("access"),
    )
    rows = graph.unionByName(queue)
    inside = spatial.points_in_polygons(rows.select("stop_id", "lat", "lng"), "stop_id", lots, "lot_id")
    return rows.join(inside.join(access, "lot_id").drop("lot_id"), "stop_id", "left")


_TRIP = f"""with {_EDGES}, rows_ as (select concat('place:', lpad(cast(place_id as varchar), 12, '0')) stop_id, lat, lng, geocode_precision p, case when place_id % 9 = 0 then 2 else 0 end distance,
      place_id % 14 = 0 closed from fx_places where status = 'verified'
    union all select concat('submission:', lpad(cast(id as varchar), 12, '0')), lat, lng, null, 0, false from fx_submissions where status <> 'rejected' and place_id is null),
  hits as (select r.stop_id, e.lot_id from rows_ r join (select lot_id, min(lat) s, max(lat) n, min(lng) w, max(lng) x from fx_lot_vertices group by 1) b
      on r.lat between b.s and b.n and r.lng between b.w and b.x join edges e on e.lot_id = b.lot_id
    group by r.stop_id, e.lot_id, r.lat, r.lng having sum(case when (alat > r.lat) <> (blat > r.lat) and r.lng < (blng - alng) * (r.lat - alat) / (blat - alat) + alng then 1 else 0 end) % 2 = 1),
  lot as (select stop_id, min(lot_id) lot_id from hits group by 1),
  judged as (select r.*, case when r.lat is null or (r.lat = 0 and r.lng = 0) then 'no_position' when distance = 2 then 'not_a_route_stop' when closed then 'closed'
      when p is not null and p not in ('point', 'building', 'street') then 'not_a_spot' when l.lot_id % 3 = 0 then 'studio_lot_no_entry' when l.lot_id % 3 = 1 then 'studio_lot_needs_booking' end reason
    from rows_ r left join lot l using (stop_id))"""


@check("p12_trip_eligibility", f"{_TRIP} select stop_id, reason from judged")
def p12(v):
    return trip_rows(v).select("stop_id", trips.refusal().alias("reason"))


def pooled(v):
    areas = v.anchors.select(
        c("anchor_id").alias("area_id"), c("lat").alias("a_lat"), c("lng").alias("a_lng"),
        (c("radius_km") * 1000).alias("radius_m"),
    )
    rows = trip_rows(v).filter(trips.refusal().isNull())
    return trips.pools(areas, rows)


@check(
    "t09_nearest_pool",
    f"""{_TRIP} select area_id, stop_id from (select a.anchor_id area_id, j.stop_id, row_number() over (partition by a.anchor_id order by {q.metres('a.lat', 'a.lng', 'j.lat', 'j.lng')}, j.stop_id) r
      from fx_anchors a join judged j on j.reason is null and abs(j.lat - a.lat) < 0.1 and {q.metres('a.lat', 'a.lng', 'j.lat', 'j.lng')} <= a.radius_km * 1000) where r <= 60""",
)
def t09(v):
    return pooled(v).select("area_id", "stop_id")


@check("g08_timed_tours")
def g08(v):
    rows = pooled(v).withColumn("routable", c("access").isin("open", "ticketed", "view_only"))
    return trips.pick_tours(trips.timed_tours(rows))
