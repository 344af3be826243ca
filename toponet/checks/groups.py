"""Groups of places, clusters of names, same-spot merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapview
from ..plans import grouping
from . import sqltext as q
from .registry import check

c = F.col


#: Groups made row by row, as one step of recursion for the k-th row of every part at once; parts can't share a
#: group: places of two cities are degrees apart in these views, and names only meet within their work.
def _walk(rows: str, part: str, columns: str, pick: str) -> str:
    said = "".join(f", o.{x.strip()}" for x in columns.split(","))
    return f"""ranked as (select *, row_number() over (partition by {part} order by id) k, {part} part from {rows}),
    walk(id, grp, k, part, {columns}) using key (id) as (
      select id, id, k, part, {columns} from ranked where k = 1
      union
      select o.id, coalesce(({pick}), o.id), o.k, o.part{said}
      from walk w join ranked o on o.part = w.part and o.k = w.k + 1)"""


_CITY = "round(lat) || ':' || round(lng)"
_SPOT = "lat, lng"
_CAN_MERGE = f"""w.place_class = o.place_class and w.geocode_precision = o.geocode_precision
  and o.geocode_precision in ('point', 'building', 'street') and coalesce(w.wikidata_id = o.wikidata_id, true)
  and {q.names_match('w.name', 'o.name')} and {q.half_up(q.metres('w.lat', 'w.lng', 'o.lat', 'o.lng'))} <= 40"""


def _every(test: str) -> str:
    """First group all of whose members pass ``test``."""
    return f"""select min(x.grp) from (select w.grp, bool_and(coalesce({test}, false)) fine
      from recurring.walk w where w.part = o.part group by w.grp) x where x.fine"""


_GROUPS = f"""with recursive shapes as (
  select min(place_id) id, {q.name_key('name')} as name, lat, lng, place_class, geocode_precision, wikidata_id
  from fx_places where lat is not null group by all),
{_walk('shapes', _CITY, 'name, lat, lng, place_class, geocode_precision, wikidata_id', _every(_CAN_MERGE))},
member as (
  select p.place_id, p.wikidata_id, p.confidence,
    case when p.geocode_precision in ('point', 'building', 'street') then w.grp else p.place_id end group_id
  from fx_places p join walk w on w.name = {q.name_key('p.name')} and w.lat = p.lat and w.lng = p.lng
    and w.place_class = p.place_class and w.geocode_precision = p.geocode_precision and w.wikidata_id is not distinct from p.wikidata_id)
"""

_CLUSTERS = f"""with recursive named as (
  select id, work_id, {q.name_key('place_name')} as name, place_name, source_kind, lat, lng from fx_submissions),
heads as (select min(id) id, work_id, name from named where name <> '' group by work_id, name),
{_walk('heads', 'work_id', 'name', f"select min(w.grp) from recurring.walk w where w.part = o.part and {q.names_match('w.name', 'o.name')}")},
clustered as (select n.*, w.grp cluster_id from named n join walk w on w.part = n.work_id and w.name = n.name),
ranked_donors as (select cluster_id, arg_min({{'id': id, 'lat': lat, 'lng': lng, 'kind': source_kind}},
    (case source_kind when 'moviemaps' then 1 when 'permit_record' then 2 else 3 end, id)) donor
  from clustered where lat is not null and lng is not null and source_kind in ('moviemaps', 'permit_record', 'wikipedia') group by 1),
kinds as (select cluster_id, list_sort(list(distinct source_kind)) kinds, count(*) n from clustered group by 1 having count(distinct source_kind) > 1),
own as (select cluster_id, source_kind, count(*) own from clustered group by 1, 2)
"""


@check("g02_place_groups", _GROUPS + """, kept as (
    select group_id, arg_min(place_id, (wikidata_id is null, -coalesce(confidence, 0), place_id)) place_id, count(*) merged_count from member group by 1),
  works as (select group_id, count(distinct work_id) works from member join fx_links using (place_id) group by 1)
  select group_id, kept.place_id, merged_count, coalesce(works, 0) works from kept left join works using (group_id)""")
def g02(v):
    groups = grouping.place_groups(v.places)
    return grouping.surviving_places(groups, v.links)


@check("g03_place_clusters", _CLUSTERS + """select id, cluster_id, case when b then donor.id end donor_id,
    case when b then donor.lat else lat end lat, case when b then donor.lng else lng end lng,
    case when b then donor.kind || '_via_corroboration' end geocode_source
  from (select c.*, d.donor, coalesce((c.lat is null or c.lng is null) and d.donor is not null and d.donor.id <> c.id, false) b
    from clustered c join kinds using (cluster_id) left join ranked_donors d using (cluster_id))""")
def g03(v):
    rows = grouping.corroborations(grouping.name_clusters(v.submissions))
    return rows.select("id", "cluster_id", "donor_id", "lat", "lng", "geocode_source")


@check("a18_corroboration_lists", _CLUSTERS + """select id, n - own others,
    array_to_string(list_filter(kinds, lambda x: x <> source_kind), ',') other_kinds
  from clustered join kinds using (cluster_id) join own using (cluster_id, source_kind)""")
def a18(v):
    rows = grouping.corroborations(grouping.name_clusters(v.submissions))
    return rows.select("id", "others", F.array_join("other_kinds", ",").alias("other_kinds"))


@check("a18_cluster_lists", _CLUSTERS + """select cluster_id, source_kind, count(*) n,
    string_agg(id || ':' || place_name, '|' order by id) listed
  from clustered join kinds using (cluster_id) group by cluster_id, source_kind""")
def a18_lists(v):
    """The shared lists: a row is confirmed by those of its cluster's other sources."""
    made = grouping.corroboration_lists(grouping.name_clusters(v.submissions))
    said = F.transform("rows", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["place_name"]))
    return made.select(
        "cluster_id", "source_kind", F.size("rows").cast("long").alias("n"), F.array_join(said, "|").alias("listed")
    )


def trip_stops(v):
    """Graph places and visible queue rows as stops of one list."""
    graph = mapview.mappable(v.places, v.evidence).join(
        v.links.groupBy("place_id").agg(F.min("work_id").alias("work_id")), "place_id", "left"
    ).select(
        F.concat(F.lit("place:"), F.lpad(c("place_id").cast("string"), 12, "0")).alias("stop_id"),
        "name", "lat", "lng", "work_id", F.lit(True).alias("verified"),
        "geocode_precision",
    )
    queue = mapview.visible_queue(v.submissions).select(
        F.concat(F.lit("submission:"), F.lpad(c("id").cast("string"), 12, "0")).alias("stop_id"),
        c("place_name").alias("name"), "lat", "lng", "work_id", F.lit(False).alias("verified"),
        F.lit(None).cast("string").alias("geocode_precision"),
    )
    return graph.unionByName(queue)


_ALIKE = f"""({q.half_up(q.metres('w.lat', 'w.lng', 'o.lat', 'o.lng'))} <= 5
  or {q.half_up(q.metres('w.lat', 'w.lng', 'o.lat', 'o.lng'))} <= 40 and w.name <> '' and o.name <> ''
    and (w.name = o.name or starts_with(w.name, o.name || ' ') or starts_with(o.name, w.name || ' ')))"""
_STOPS = f"""with recursive stops as (
  select 'place:' || lpad(place_id::varchar, 12, '0') stop_id, p.name, p.lat, p.lng, l.work_id, true verified
  from ({q.MAPPABLE}) m join fx_places p using (place_id) left join (select place_id, min(work_id) work_id from fx_links group by 1) l using (place_id)
  union all select 'submission:' || lpad(id::varchar, 12, '0'), place_name, lat, lng, work_id, false from ({q.VISIBLE_QUEUE})),
keyed as (select *, {q.name_key('name')} as key from stops),
shapes as (select min(stop_id) id, key as name, lat, lng from keyed group by key, lat, lng),
{_walk('shapes', _CITY, 'name, lat, lng', _every(_ALIKE))},
spotted as (select k.*, w.grp spot_id from keyed k join walk w on w.name = k.key and w.lat = k.lat and w.lng = k.lng)
"""


@check("u03_same_spot", _STOPS + """select spot_id, top.stop_id, top.name, top.lat, top.lng, top.verified, merged_count, works
  from (select spot_id, arg_min({'stop_id': stop_id, 'name': name, 'lat': lat, 'lng': lng, 'verified': verified}, (length(name), stop_id)) top,
    count(*) merged_count, count(distinct work_id) works from spotted group by 1)""")
def u03(v):
    return grouping.collapsed_spots(grouping.spot_groups(trip_stops(v)))


_ANSWERS = f"""with recursive points as (
  select id point_id, place_name as name, lat, lng, work_id from ({q.VISIBLE_QUEUE})),
shapes as (select min(point_id) id, name, {q.name_key('name')} as key, lat, lng from points group by name, lat, lng),
{_walk('shapes', _CITY, 'name, key, lat, lng', f"""select min(h.grp) from (
      select w.grp, w.part, arg_min(w.key, (length(w.name), w.id)) as key from recurring.walk w group by w.grp, w.part) h
    join ranked f on f.id = h.grp
    where h.part = o.part and {q.half_up(q.metres('f.lat', 'f.lng', 'o.lat', 'o.lng'))} <= 150
      and ({q.names_match('h.key', 'o.key')} or h.key <> '' and o.key <> '' and (
        len(string_split(h.key, ' ')) >= 2 and starts_with(o.key, h.key || ' ') or len(string_split(o.key, ' ')) >= 2 and starts_with(h.key, o.key || ' ')))""")}
"""


@check("g16_answer_merge", _ANSWERS + """select grp group_id, arg_min(p.name, (length(p.name), point_id)) as name, count(*) points,
    count(distinct work_id) film_count
  from points p join walk w on w.name = p.name and w.lat = p.lat and w.lng = p.lng group by 1""")
def g16(v):
    points = mapview.visible_queue(v.submissions).select(
        c("id").alias("point_id"), c("place_name").alias("name"), "lat", "lng", "work_id"
    )
    return grouping.merged_answers(grouping.answer_groups(points))


@check(
    "g02_mergeable_counts",
    f"""with shapes as (select min(place_id) id, {q.name_key('name')} name, lat, lng, place_class, geocode_precision, wikidata_id
      from fx_places where lat is not null group by all),
    pairs as (select a.id a_id, b.id b_id from shapes a join shapes b on a.id < b.id and a.place_class = b.place_class
      and a.geocode_precision = b.geocode_precision and a.geocode_precision in ('point', 'building', 'street')
      and (a.wikidata_id is null or b.wikidata_id is null or a.wikidata_id = b.wikidata_id) and abs(a.lat - b.lat) < 0.001
      and {q.names_match('a.name', 'b.name')} and {q.half_up(q.metres('a.lat', 'a.lng', 'b.lat', 'b.lng'))} <= 40)
    select id, count(*) degree from (select a_id id from pairs union all select b_id from pairs) group by 1""",
)
def g02_counts(v):
    pairs = grouping.mergeable_pairs(grouping.shapes(v.places))
    ends = pairs.select(c("a_id").alias("id")).unionByName(pairs.select(c("b_id").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
