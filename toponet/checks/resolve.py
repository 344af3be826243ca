"""Resolution, geocoding, promotion, search answers, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fold, phrases
from ..operators import answers, matching, ontology, spatial
from ..plans import promotion, resolution
from ..session import cut_lineage, snapshot
from . import matches as m
from . import queue as qq
from . import sqltext as q
from .registry import check

c = F.col


def _resolved(v):
    up = ontology.ancestry(v.type_edges, depth=4)
    kinds = ontology.kinds(up, m.ROOTS).drop("ancestors")
    n = v.table("part").agg(F.count(F.lit(1)).alias("n")).scalar()
    entities = v.places.withColumn("type_id", 1 + c("place_id") % (n - 1)).join(kinds, "type_id").select(
        c("place_id").alias("loc"),
        F.when(c("place_id") % 17 != 3, c("name")).alias("name"), "lat", "lng",
        ((c("place_id") % 5) * (c("place_id") % 5) / 50.0).alias("precision_deg"),
        "studio", "fictional", "country", "settlement",
    )
    ids = v.works.filter(c("work_id") % 13 != 5).select(
        "work_id", (c("work_id") * 10).alias("entity"), (c("work_id") % 19 == 2).alias("conflict")
    )
    claims = v.links.select("work_id", c("place_id").alias("loc"))
    return resolution.resolve_claims(v.works.select("work_id", "kind"), ids, claims, entities)


_RESOLVE = f"""{m._TYPES},
  ents as (select p.place_id loc, case when p.place_id % 17 <> 3 then name end nm, lat, lng, (place_id % 5) * (place_id % 5) / 50.0 deg, k.studio, k.fictional, k.country, k.settlement
    from fx_places p join kinds k on k.type_id = 1 + p.place_id % ((select count(*) from part) - 1)),
  ws as (select work_id, case kind when 'film' then 'filming_location' when 'series' then 'filming_location' when 'book' then 'narrative_location' end rel,
      work_id % 13 <> 5 has_id, work_id % 19 = 2 conflict, (select count(*) from fx_links l where l.work_id = w.work_id) n from fx_works w),
  judged as (select *, case when rel is null then 'unsupported_kind' when has_id and conflict then 'qid_conflict' when not has_id then 'no_wikidata_id' when n = 0 then 'no_locations' end reason from ws),
  stated as (select distinct j.work_id, j.rel, l.place_id loc from judged j join fx_links l using (work_id) where reason is null),
  found as (select s.*, e.* exclude (loc) from stated s left join ents e on e.loc = s.loc),
  classed as (select *, case when fictional then 'fictional' when studio then 'studio_interior' when lat is null then 'unknown' when rel = 'narrative_location' then 'narrative_real' else 'real_exterior' end cls,
    case when deg >= 1 then 'country' when deg >= 0.1 then 'city' when deg >= 0.01 then 'street' else 'point' end src from found where nm is not null)"""


@check(
    "g01_resolved_places",
    f"""{_RESOLVE} select loc, arg_min(cls, list_position(['fictional', 'studio_interior', 'real_interior', 'real_exterior', 'narrative_real', 'unknown'], cls)) place_class,
      any_value(case when fictional or lat is null then 'none' when studio then case when src in ('country', 'city', 'street', 'building') then src else 'building' end when country then 'country'
        when settlement then case when src = 'country' then 'country' else 'city' end else src end) geocode_precision,
      any_value(case when studio and not fictional then 0.85 else 0.9 end) confidence from classed group by 1""".replace("0.85 else 0.9 end", "cast(0.85 as double) else cast(0.9 as double) end"),
)
def g01(v):
    return _resolved(v)["places"].select("loc", "place_class", "geocode_precision", "confidence")


@check(
    "g01_skipped_works",
    f"""{_RESOLVE} select work_id, reason from judged where reason is not null
    union all select work_id, 'locations_unavailable' from found group by 1 having count(nm) = 0""",
)
def g01_skips(v):
    return _resolved(v)["skips"]


@check(
    "g01_flags",
    f"""{_RESOLVE} select concat('locations_unavailable:', work_id, ':', count(*) - count(nm)) flag from found group by work_id having count(nm) < count(*)
    union all select concat('place_class_disagreement:', loc, ':', arg_min(cls, list_position(['fictional', 'studio_interior', 'real_interior', 'real_exterior', 'narrative_real', 'unknown'], cls)))
      from classed group by loc having count(distinct cls) > 1""",
)
def g01_flags(v):
    return _resolved(v)["flags"]


def gazetteer(v):
    """Places as a gazetteer, and one entity per base name that is unique."""
    rows = m.gazetteer(v)
    base = v.places.filter(c("lat").isNotNull()).groupBy(
        fold.normalize_name(c("name")).alias("name_norm")
    ).agg(F.min_by(F.struct(c("place_id").alias("entity"), "lat", "lng"), "place_id").alias("e"))
    none = F.lit(None).cast("long")
    extra = base.select(
        "e.entity", "name_norm", "e.lat", "e.lng", none.alias("population"), F.lit(True).alias("exact_label")
    )
    return rows.unionByName(extra)


@check(
    "g07_geocode_pass",
    f"""with {m._AREAS}, base as (select {q.name_key('name')} nm, min(place_id) entity, arg_min(lat, place_id) lat, arg_min(lng, place_id) lng from fx_places where lat is not null group by 1),
    rows_ as (select id, work_id, place_name from fx_submissions where lat is null),
    own as (select distinct work_id, lat, lng from fx_submissions where lat is not null and not (lat = 0 and lng = 0)),
    split as (select id, work_id, {q.head('place_name')} h, {q.areas('place_name')} areas, {q.head_refusal(q.head('place_name'))} refusal from rows_),
    s2 as (select s.*, exists (select 1 from own o where o.work_id = s.work_id) has_own from split s),
    s3 as (select s.*, coalesce(refusal, case when len(areas) = 0 and not has_own then 'no_area_to_check_against' end) why, b.entity, b.lat, b.lng,
        [i for a, i in areas if {q.name_key('a')} in ('old town', 'london')] turns
      from s2 s left join base b on b.nm = {q.name_key('h')}),
    s4 as (select *, turns[1] - 1 turn, {q.name_key("areas[turns[1]]")} area from s3),
    s5 as (select s.*, exists (select 1 from areas a where a.area_norm = s.area and {q.flat_km('s.lat', 's.lng', 'a.a_lat', 'a.a_lng')} <= case when s.turn = 0 then 5 else 100 end) in_area,
      exists (select 1 from own o where o.work_id = s.work_id and {q.flat_km('s.lat', 's.lng', 'o.lat', 'o.lng')} <= 100) near_own from s4 s)
    select id, case when why is not null then why when entity is null then 'head_unknown' when turn is null and not has_own then 'area_unknown'
      when turn is null and not near_own then 'outside_the_works_own_places' when turn is not null and not in_area then 'outside_area' else 'accepted' end reason from s5""",
)
def g07(v):
    rows = v.submissions.filter(c("lat").isNull()).select("id", "work_id", "place_name")
    placed = v.submissions.filter(c("lat").isNotNull() & ~((c("lat") == 0) & (c("lng") == 0)))
    got = resolution.geocode_queue(rows, gazetteer(v), m.areas(v), placed.select("work_id", "lat", "lng"))
    return got.select("id", "reason")


@check(
    "g07_geocode_cache",
    f"""with base as (select {q.name_key('name')} nm, min(place_id) entity, arg_min(lat, place_id) lat, arg_min(lng, place_id) lng from fx_places where lat is not null group by 1),
    heads as (select {q.head('place_name')} h, {q.head_refusal(q.head('place_name'))} refusal, case when lat is null then 2 else 1 end run from fx_submissions),
    asked as (select {q.name_key('h')} query_norm, min(run) asked_in from heads where refusal is null group by 1)
    select query_norm, b.entity, b.lat, b.lng, asked_in from asked left join base b on b.nm = query_norm where query_norm is not null""",
)
def g07_cache(v):
    """The cache after two runs: heads of located rows, then those of the others that it lacks."""
    split = v.submissions.select("lat", phrases.split_phrase(c("place_name")).alias("s")).filter(
        c("s.refusal").isNull()
    ).select("lat", fold.normalize_name(c("s.head")).alias("query_norm"))
    names = gazetteer(v)
    empty = v.spark.createDataFrame([], "query_norm string, entity long, lat double, lng double")
    first = cut_lineage(resolution.ask_through(split.filter(c("lat").isNotNull()), names, empty))
    second = resolution.ask_through(split.filter(c("lat").isNull()), names, first)
    return first.withColumn("asked_in", F.lit(1)).unionByName(second.withColumn("asked_in", F.lit(2)))


def promotable(v):
    """Verified, located, unpromoted queue rows with score and quote."""
    rows = qq.corroborated(v).filter(
        c("place_id").isNull() & c("lat").isNotNull() & ~((c("lat") == 0) & (c("lng") == 0))
    )
    # Rows are told apart first: only these are worth a verdict.
    rows = qq.review.review(rows, c("corroborated"), c("agrees")).filter(c("verdict") == "verified")
    return rows.withColumn("quote", phrases.quotable(c("source_kind"), c("source_sentence")))


#: Promotable rows with score and quote, their groups in id order within a city, and the graph's side of it.
#: Places of two cities are degrees apart in these views, so the k-th shapes of all cities are decided together.
_PROMOTED = f"""with recursive rows_ as (
  select s.*, v.score, v.reason from {qq._REVIEWED} v join fx_submissions s using (id)
  where v.verdict = 'verified' and s.place_id is null and s.lat is not null and not (s.lat = 0 and s.lng = 0)),
quoted as (select *, case when source_kind in ({q.quoted(phrases.QUOTABLE_SOURCES)}) then source_sentence end said from rows_),
shapes as (select min(id) node, place_name, {q.name_key('place_name')} as key, lat, lng, round(lat) || ':' || round(lng) city
  from rows_ where wikidata_id is null group by place_name, lat, lng),
ranked as (select *, row_number() over (partition by city order by node) k from shapes),
walk(node, grp, k, city, place_name, key) using key (node) as (
  select node, node, k, city, place_name, key from ranked where k = 1
  union
  select o.node, coalesce((
      select min(h.grp) from (
        select w.grp, w.city, arg_min(w.key, (length(w.place_name), w.place_name)) as key from recurring.walk w group by w.grp, w.city) h
      join ranked f on f.node = h.grp
      where h.city = o.city and {q.names_match('o.key', 'h.key')}
        and {q.half_up(q.metres('f.lat', 'f.lng', 'o.lat', 'o.lng'))} <= 40), o.node),
    o.k, o.city, o.place_name, o.key
  from walk w join ranked o on o.city = w.city and o.k = w.k + 1),
member as (
  select r.id, w.grp group_id from rows_ r join ranked s on r.wikidata_id is null and r.place_name = s.place_name
    and r.lat = s.lat and r.lng = s.lng join walk w on w.node = s.node
  union all select id, min(id) over (partition by wikidata_id) from rows_ where wikidata_id is not null),
formed as (
  select group_id, arg_min(place_name, (length(place_name), place_name)) as name, arg_min(lat, id) lat, arg_min(lng, id) lng,
    min(wikidata_id) wikidata_id, arg_min(reason, id) status_reason, least(1.0, max(score)) confidence, count(*) members
  from quoted join member using (id) group by 1),
near as (
  select g.group_id, min(p.place_id) by_name from formed g join fx_places p on p.lat is not null and abs(p.lat - g.lat) < 0.001
    and {q.names_match(q.name_key('g.name'), q.name_key('p.name'))}
    and {q.half_up(q.metres('g.lat', 'g.lng', 'p.lat', 'p.lng'))} <= 40 group by 1),
held as (
  select g.*, coalesce(i.place_id, n.by_name) held_id from formed g
  left join (select wikidata_id, min(place_id) place_id from fx_places where wikidata_id is not null group by 1) i using (wikidata_id)
  left join near n using (group_id)),
grps as (
  select *, held_id is null is_new, coalesce(held_id, (select max(place_id) from fx_places)
    + row_number() over (partition by held_id is null order by group_id)) place_id from held),
placed as (select r.*, g.place_id to_place from quoted r join member m using (id) join grps g on g.group_id = m.group_id),
wanted as (
  select work_id, to_place place_id, least(1.0, max(score)) confidence, arg_min(said, id) filter (said is not null) statement
  from placed group by 1, 2),
matched as (
  select w.*, l.link_id from wanted w left join (select work_id, place_id, min(link_id) link_id from fx_links
    where relation_kind = 'filming_location' group by 1, 2) l using (work_id, place_id)),
linked as (
  select *, link_id is null is_new, coalesce(link_id, (select max(link_id) from fx_links)
    + row_number() over (partition by link_id is null order by work_id, place_id)) id from matched)
"""


def promoted(v) -> promotion.Promotion:
    lots = spatial.polygons(v.lot_vertices, "lot_id", "vertex_no")
    return promotion.promote(promotable(v), v.places, v.links, v.evidence, lots)


@check(
    "g06_promoted_groups",
    _PROMOTED + "select group_id, name, lat, lng, wikidata_id, confidence, members, place_id, is_new from grps",
)
def g06(v):
    return promoted(v)["groups"].drop("matched_by")


@check(
    "g06_promoted_places",
    _PROMOTED + """, sides as (select a.lot_id, a.lat alat, a.lng alng, b.lat blat, b.lng blng from fx_lot_vertices a
      join fx_lot_vertices b on a.lot_id = b.lot_id and b.vertex_no = (a.vertex_no + 1) % 4),
    inside as (select distinct place_id from (select g.place_id, s.lot_id from grps g join sides s on abs(s.alat - g.lat) < 0.1 and abs(s.alng - g.lng) < 0.1
      and (s.alat > g.lat) <> (s.blat > g.lat) and g.lng < (s.blng - s.alng) * (g.lat - s.alat) / (s.blat - s.alat) + s.alng
      where g.is_new group by 1, 2 having count(*) % 2 = 1))
    select place_id, wikidata_id, name, lat, lng, 'unknown' place_class, case when wikidata_id is not null then 'point' else 'none' end geocode_precision,
      place_id in (select place_id from inside) shot_on_set, confidence, 'verified' confidence_band, 'verified' status, status_reason
    from grps where is_new""",
)
def g06_places(v):
    return promoted(v)["places"]


@check(
    "g06_promoted_links",
    _PROMOTED + """select id::bigint link_id, work_id, place_id, 'filming_location' relation_kind, confidence, statement
      from linked where is_new""",
)
def g06_links(v):
    return promoted(v)["links"]


@check("g06_statements", _PROMOTED + "select link_id, statement from linked where not is_new and statement is not null")
def g06_statements(v):
    return promoted(v)["statements"]


@check("g06_marked_rows", _PROMOTED + "select id, to_place place_id from placed")
def g06_marked(v):
    return promoted(v)["marked"]


@check(
    "g06_evidence",
    _PROMOTED + """select 'place' subject_type, to_place subject_id, 'text_mention' as method, source_url, source_kind source_ref,
      left(source_sentence, 500) snippet, true agrees, id submission_id from placed
    union all select 'link', l.id, 'text_mention', source_url, source_kind, left(source_sentence, 500), true, p.id
      from placed p join linked l on l.work_id = p.work_id and l.place_id = p.to_place""",
)
def g06_evidence(v):
    return promoted(v)["evidence"]


@check("g06_second_run", "select '' written, 0::bigint n from fx_links where false")
def g06_again(v):
    """What a second promotion of the same queue would write over the first one's tables: nothing."""
    first = promoted(v)
    tables = promotion.after_promotion(first, v.submissions, v.places, v.links, v.evidence)
    done = {k: snapshot(tables[k]) for k in ("places", "links", "evidence")}
    marked = tables["submissions"].select("id", "place_id").filter(c("place_id").isNull())
    left = first.rows.drop("place_id").join(marked, "id")
    plan = promotion.promote(left, done["places"], done["links"], done["evidence"])
    out = None
    for name in ("places", "links", "statements", "evidence", "marked"):
        n = plan[name].groupBy(F.lit(name).alias("written")).agg(F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@check("g06_links_stay_unique", "select link_id, 1::bigint n from fx_links where false")
def g06_unique(v):
    """Ids that two facts share, or facts with two ids, once the new links are in: none."""
    made = promotion.promote(promotable(v), v.places, v.links, v.evidence)["links"]
    both = v.links.select("link_id", "work_id", "place_id", "relation_kind").unionByName(
        made.select("link_id", "work_id", "place_id", "relation_kind")
    )
    ids = both.groupBy("link_id").agg(F.count(F.lit(1)).alias("n"))
    facts = made.groupBy("work_id", "place_id", "relation_kind").agg(
        F.min("link_id").alias("link_id"), F.count(F.lit(1)).alias("n")
    ).select("link_id", "n")
    return ids.unionByName(facts).filter(c("n") > 1)


@check(
    "g06_promotion_by_id",
    f"""with r as (select s.* from {qq._REVIEWED} v join fx_submissions s using (id) where v.verdict = 'verified' and s.place_id is null and s.lat is not null
      and not (s.lat = 0 and s.lng = 0) and s.wikidata_id is not null),
    held as (select wikidata_id, min(place_id) place_id from fx_places where wikidata_id is not null group by 1)
    select r.wikidata_id, min(r.id) group_id, count(*) members, any_value(h.place_id) place_id, arg_min(place_name, (length(place_name), place_name)) as name from r left join held h using (wikidata_id) group by 1""",
)
def g06_by_id(v):
    rows = promotable(v).filter(c("wikidata_id").isNotNull())
    groups = promotion.promote(rows, v.places, v.links, v.evidence)["groups"]
    return groups.select("wikidata_id", "group_id", "members", "place_id", "name")


@check(
    "g14_search_answer",
    f"""with stated as (select l.work_id, l.place_id, p.name, p.lat, p.lng, row_number() over (partition by l.work_id order by
        case relation_kind when 'filming_location' then 1 else 2 end, l.link_id) r, case relation_kind when 'filming_location' then 1 when 'narrative_location' then 2 end k
      from fx_links l join fx_places p using (place_id) where relation_kind in ('filming_location', 'narrative_location') and p.lat is not null),
    best as (select s.* from stated s join (select work_id, min(k) k from stated group by 1) b using (work_id, k)),
    queued as (select s.work_id, s.id, s.place_name, s.lat, s.lng from fx_submissions s where status <> 'rejected' and place_id is null and lat is not null and not (lat = 0 and lng = 0)
      and not exists (select 1 from best b where b.work_id = s.work_id and abs(b.lat - s.lat) < 0.01 and {q.names_match(q.name_key('s.place_name'), q.name_key('b.name'))}
        and {q.half_up(q.metres('s.lat', 's.lng', 'b.lat', 'b.lng'))} <= 150))
    select work_id, 'stated' tier, place_id ref from best union all select work_id, 'queued', id from queued""",
)
def g14(v):
    return answers.search_answer(v.links, v.places, v.submissions).select("work_id", "tier", "ref")


_CLAIMS = f"""with recursive claims as (
  select s.id, p.city_id anchor_id, {q.name_key('s.place_name')} as key, s.lat, s.lng, s.wikidata_id
  from fx_submissions s join fx_places p using (place_id) where s.lat is not null),
known as (select city_id anchor_id, {q.name_key('name')} as key, lat, lng, wikidata_id from fx_places where status = 'verified' and lat is not null),
shapes as (select min(id) sid, anchor_id, key, lat, lng, wikidata_id from claims group by all),
judged as (
  select s.*, case when exists (select 1 from known k where k.anchor_id = s.anchor_id and k.wikidata_id = s.wikidata_id)
      or exists (select 1 from known k where k.anchor_id = s.anchor_id and k.key = s.key and s.key <> '')
      or exists (select 1 from known k where k.anchor_id = s.anchor_id and {q.half_up(q.metres('k.lat', 'k.lng', 's.lat', 's.lng'))} <= 50) then 'already_on_map'
    when {q.metres('a.lat', 'a.lng', 's.lat', 's.lng')} / 1000 > a.radius_km then 'outside_city' end why
  from shapes s join fx_anchors a using (anchor_id)),
ranked as (select *, row_number() over (partition by anchor_id order by sid) k from judged where why is null),
walk(sid, ok, k, anchor_id, key, lat, lng, wikidata_id) using key (sid) as (
  select sid, true, k, anchor_id, key, lat, lng, wikidata_id from ranked where k = 1
  union
  select o.sid, not coalesce((
      select bool_or(w.ok and (coalesce(w.wikidata_id = o.wikidata_id, false) or w.key = o.key and o.key <> ''
        or {q.half_up(q.metres('w.lat', 'w.lng', 'o.lat', 'o.lng'))} <= 50)) from recurring.walk w where w.anchor_id = o.anchor_id), false),
    o.k, o.anchor_id, o.key, o.lat, o.lng, o.wikidata_id
  from walk w join ranked o on o.anchor_id = w.anchor_id and o.k = w.k + 1)
"""


@check("g15_place_claims", _CLAIMS + """select c.id, c.anchor_id, coalesce(j.why, case when not w.ok or c.id <> j.sid then 'repeats_an_accepted_claim' end) reason
  from claims c join judged j on j.anchor_id = c.anchor_id and j.key = c.key and j.lat = c.lat and j.lng = c.lng
    and j.wikidata_id is not distinct from c.wikidata_id left join walk w on w.sid = j.sid""")
def g15(v):
    claims = v.submissions.filter(c("lat").isNotNull()).join(
        v.places.select("place_id", c("city_id").alias("anchor_id")), "place_id"
    ).select("id", "anchor_id", c("place_name").alias("name"), "lat", "lng", "wikidata_id")
    known = v.places.filter((c("status") == "verified") & c("lat").isNotNull()).select(
        c("city_id").alias("anchor_id"), "name", "lat", "lng", "wikidata_id"
    )
    return answers.accept_located(claims, known, v.anchors)
