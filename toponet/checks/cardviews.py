"""Cards, profiles, tallies, spoilers, visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts as fa
from ..operators import cards, mapview, visits
from ..operators.numbering import top_per_key
from . import sqltext as q
from .registry import check

c = F.col

_ROLE = """case when p.place_class = 'fictional' then 'fictional' when l.relation_kind = 'narrative_location' or p.place_class = 'narrative_real' then 'narrative'
  when l.relation_kind = 'inspiration_for' then 'inspiration' when l.relation_kind = 'replica' then 'replica' when l.relation_kind = 'author_place' then 'author'
  when p.place_class = 'studio_interior' then 'studio' when p.place_class in ('real_exterior', 'real_interior') then 'on_location' else 'unknown' end"""
_DISTANCE = "case when l.relation_kind = 'inspiration_for' then 2 when l.relation_kind in ('author_place', 'artist_place') then 1 else 0 end"


def profile_rows(v):
    """Links with the role of their place and the distance of the fact."""
    places = v.places.select("place_id", "place_class", c("confidence").alias("place_confidence"))
    rows = v.links.join(places, "place_id")
    return rows.select(
        "work_id", c("link_id").alias("fact_id"), "place_confidence",
        fa.place_role(c("place_class"), c("relation_kind"), F.lit(False)).alias("role"),
        fa.fact_distance(c("relation_kind"), F.lit("work")).alias("distance"),
    )


@check(
    "t06_profile_places",
    f"""select work_id, fact_id, role, distance from (select l.work_id, l.link_id fact_id, {_ROLE} role, {_DISTANCE} distance,
      row_number() over (partition by l.work_id order by {_DISTANCE}, coalesce(list_position(['on_location', 'unknown', 'studio', 'narrative', 'fictional'], {_ROLE}), 0), p.confidence desc, l.link_id) n
      from fx_links l join fx_places p using (place_id)) where n <= 60""",
)
def t06(v):
    return cards.profile_places(profile_rows(v)).select("work_id", "fact_id", "role", "distance")


@check(
    "a15_role_tally",
    f"""select work_id, place_count, on_location, studio, narrative, fictional, unknown, concat(concat_ws(' · ', concat(place_count, case when place_count = 1 then ' place' else ' places' end),
      case when on_location > 0 then concat(on_location, ' filmed on location') end, case when nearby > 0 then concat(nearby, ' nearby rather than in the film') end), '.') line
    from (select work_id, count(*) place_count, count(case when distance > 1 then 1 end) nearby, count(case when role = 'on_location' then 1 end) on_location,
      count(case when role = 'studio' then 1 end) studio, count(case when role = 'narrative' then 1 end) narrative, count(case when role = 'fictional' then 1 end) fictional,
      count(case when role = 'unknown' then 1 end) as unknown from (select l.work_id, {_ROLE} role, {_DISTANCE} distance from fx_links l join fx_places p using (place_id)) group by 1)""",
)
def a15(v):
    rows = cards.role_tally(profile_rows(v))
    return rows.select(
        "work_id", "place_count", "on_location", "studio", "narrative", "fictional", "unknown",
        cards.coverage_line().alias("line"),
    )


@check(
    "a14_place_coverage",
    """with f as (select l.place_id, 'w' t, l.work_id s, case when w.kind in ('film', 'series', 'book') then w.kind else 'work' end k from fx_links l join fx_works w using (work_id)
      union all select place_id, 'c', creator_id, 'person' from fx_creator_links join fx_creators using (creator_id))
    select place_id, count(*) fact_count, count(distinct case when k = 'film' then s end) film_count, count(distinct case when k = 'series' then s end) series_count,
      count(distinct case when k = 'book' then s end) book_count, count(distinct case when k = 'person' then s end) person_count, count(distinct case when k = 'work' then s end) work_count from f group by 1""",
)
def a14(v):
    facts = cards.all_facts(v.links, v.works, v.creator_links, v.creators)
    return cards.place_coverage(facts)


@check(
    "t07_card_candidates",
    """select work_id, id from (select *, row_number() over (partition by work_id order by case status when 'verified' then 0 when 'pending' then 2 else 4 end
      + case when lat is not null and lng is not null then 0 else 1 end, trim(place_name), id) n from fx_submissions where status <> 'rejected' and trim(place_name) <> '') where n <= 60""",
)
def t07(v):
    return cards.work_candidates(v.submissions).select("work_id", "id")


@check(
    "p06_spoiler_gate",
    """select s.work_id, s.sequence_index, s.spoiler_tier, spoiler_tier <= 2 revealed, case when spoiler_tier <= 2 then s.place_id end place_id,
      case when spoiler_tier <= 2 then p.name end name, case when spoiler_tier <= 2 then p.lat end lat, case when spoiler_tier <= 2 then p.lng end lng
    from fx_scenes s left join fx_places p using (place_id)""",
)
def p06(v):
    return cards.spoiler_gate(v.scenes, v.places, 2)


@check(
    "a21_trail_progress",
    """select work_id, count(*) total, count(case when spoiler_tier <= 2 then 1 end) revealed_count, count(case when spoiler_tier > 2 then 1 end) hidden_count,
      max(spoiler_tier) highest_tier from fx_scenes group by 1""",
)
def a21(v):
    return cards.trail_progress(v.scenes, 2)


@check(
    "a26_location_bindings",
    """select work_id, place_id, min(created_at) first_date, arg_min(relation_kind, link_id) sample, count(distinct relation_kind) types from fx_links group by 1, 2""",
)
def a26(v):
    return cards.fold_bindings(v.links)


@check("a23_venue_spellings")
def a23(v):
    return cards.venue_spellings(v.submissions)


_VISITS = f"""(select f.user_id, p.place_id, min(f.ts) ts from fx_fixes f join fx_places p on abs(p.lat - f.lat) < 0.01
  and f.accuracy_m <= 120 and {q.half_up(q.metres('f.lat', 'f.lng', 'p.lat', 'p.lng'))} <= 150 group by 1, 2)"""


@check("x05_check_ins", f"select * from {_VISITS}")
def x05(v):
    return visits.check_ins(v.fixes, v.places)


@check(
    "a24_visit_score",
    f"""select user_id, visits, score, level, works from (select user_id, count(*) visits, count(*) * 50 score, cast(1 + floor(count(*) * 50 / 150) as int) level from {_VISITS} group by 1)
    left join (select user_id, count(distinct work_id) works from {_VISITS} join fx_links using (place_id) group by 1) using (user_id)""",
)
def a24(v):
    return visits.scores(visits.check_ins(v.fixes, v.places), v.links)


@check(
    "p11_usable_fix",
    "select fix_id from fx_fixes where lat between -90 and 90 and lng between -180 and 180 and (accuracy_m is null or accuracy_m <= 120)",
)
def p11(v):
    return visits.usable(v.fixes).select("fix_id")


@check(
    "x01_geofence_first_fix",
    f"""select user_id, place_id, arg_min(fix_id, (ts, fix_id)) fix_id from (select f.user_id, p.place_id, f.fix_id, f.ts from fx_fixes f
      join ({q.MAPPABLE}) p on abs(p.lat - f.lat) < 0.01 and f.accuracy_m <= 120 and {q.half_up(q.metres('f.lat', 'f.lng', 'p.lat', 'p.lng'))} <= 45) group by 1, 2""",
)
def x01(v):
    stops = mapview.mappable(v.places, v.evidence)
    return visits.first_in_fence(v.fixes, stops, 45.0)


@check("x01_geofence_state")
def x01_state(v):
    stops = mapview.mappable(v.places, v.evidence)
    return visits.fire_once(visits.firing_hits(v.fixes, stops, 45.0))


@check("x02_movement_gate")
def x02(v):
    return visits.movement_gate(v.fixes)


@check("x03_ambient_pick")
def x03(v):
    counts = v.links.groupBy("place_id").agg(F.count(F.lit(1)).alias("work_count"))
    stops = v.places.filter(c("lat").isNotNull()).join(counts, "place_id", "left").withColumn(
        "checked", c("status") == "verified"
    )
    return visits.ambient_picks(
        visits.fence_hits(v.fixes, visits.one_per_spot(stops), 45.0, ["checked", "work_count"])
    )


@check(
    "x06_windowed_visits",
    """select event_type, date_trunc('hour', ts) window_start, count(*) visits, count(distinct user_id) users from events group by 1, 2""",
)
def x06(v):
    rows = v.table("events").select("ts", "user_id", c("event_type").alias("place_key"))
    got = visits.windowed(rows, "1 hour")
    return got.select(c("place_key").alias("event_type"), "window_start", "visits", "users")


@check(
    "x06_walk_sessions",
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hour then 0 else 1 end b from events),
    s as (select *, sum(b) over (partition by user_id order by ts, event_id) n from g)
    select user_id, min(ts) session_start, count(*) fixes from s group by user_id, n""",
)
def x06_sessions(v):
    rows = v.table("events").select("ts", "user_id")
    return visits.sessions(rows, "2 hours").select("user_id", "session_start", "fixes")
