"""Queue review, data quality, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev, fold, phrases
from ..operators import cards, quality, review
from ..session import computed
from . import sqltext as q
from .registry import check

c = F.col

_AGREEING = f"""with spots as (select distinct work_id, {q.name_key('place_name')} name, source_kind, lat, lng from fx_submissions
      where lat is not null and not (lat = 0 and lng = 0))
    select distinct a.work_id, a.name, a.source_kind, a.lat, a.lng from spots a join spots b on a.work_id = b.work_id
      and a.name = b.name and a.source_kind <> b.source_kind and {q.flat_m('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 150"""
_CORROBORATED = f"""(select s.*, exists_other corroborated, g.name is not null agrees
  from (select *, {q.name_key('place_name')} name_norm from fx_submissions) s
  left join ({_AGREEING}) g on g.work_id = s.work_id and g.name = s.name_norm and g.source_kind = s.source_kind and g.lat = s.lat and g.lng = s.lng
  join (select work_id, {q.name_key('place_name')} name_norm, count(distinct source_kind) > 1 exists_other
    from fx_submissions group by 1, 2) k on k.work_id = s.work_id and k.name_norm = s.name_norm)"""


def corroborated(v):
    """Queue rows with two flags: the same work and name come from another source too,
    and such a source puts it within 150 m."""
    return review.corroborated(v.submissions, v.submission_rows())


_DISQUALIFIED = f"""case when trim(coalesce(place_name, '')) = '' then 'no_place_name'
  when not regexp_matches(trim(place_name), '\\p{{L}}') then 'name_has_no_letters'
  when lower(trim(place_name)) in ({q.quoted(phrases.NOT_A_PLACE)}) then 'not_a_place'
  when regexp_matches(trim(place_name), {q.text(phrases.CREDIT_ONLY)}) then 'photo_credit_not_a_place'
  when lat is not null and lng is not null and (abs(lat) > 90 or abs(lng) > 180) then 'impossible_coordinate'
  when lat = 0 and lng = 0 then 'null_island' end"""
_BLOCKED = f"""case when regexp_matches(trim(place_name), {q.text(phrases.CREDIT_TAIL)}) then 'unusable_name:photo_credit_appended'
  when regexp_matches(trim(place_name), {q.text(phrases.CAPTION_MARKER)}) then 'unusable_name:caption_prefix_not_cut'
  when ({q.words('place_name')}) > 12 then 'unusable_name:sentence_not_a_name'
  when lat is null or lng is null then 'no_coordinate' end"""
_SIGNALS = """list_filter([case when wikidata_id is not null then 'wikidata_entity' end,
  case when corroborated then 'independent_corroboration' end,
  case when source_sentence is not null then 'cited_source' end,
  case when agrees then 'coordinate_agreement' end], lambda x: x is not null)"""
_SCORE = """round(1 - (case when wikidata_id is not null then 0.4 else 1 end)
  * (case when corroborated then 0.5 else 1 end) * (case when source_sentence is not null then 0.55 else 1 end)
  * (case when agrees then 0.75 else 1 end), 4)"""
_REVIEWED = f"""(select id, work_id, place_id, source_kind, case when d is not null then 'rejected' when b is not null then 'pending'
    when source_kind in ('open_plaques', 'permit_record') or (claim and s >= 0.6) then 'verified' else 'pending' end verdict,
  cast(case when d is not null or b is not null then 0 when source_kind in ('open_plaques', 'permit_record') then 1 else s end as double) score,
  coalesce(d, b, case source_kind when 'open_plaques' then 'the inscription is on a wall at this coordinate and anyone can read it'
      when 'permit_record' then 'a filming permit issued by the city for this address' end,
    case when claim and s >= 0.6 then array_to_string(g, '+') when len(g) = 0 then 'no_signal_yet'
      else concat('insufficient:', array_to_string(g, '+')) end) reason
  from (select *, {_DISQUALIFIED} d, {_BLOCKED} b, {_SIGNALS} g, {_SCORE} s,
    corroborated or source_sentence is not null claim from {_CORROBORATED}))"""


def reviewed(v):
    return review.review(corroborated(v), c("corroborated"), c("agrees"))


@check(
    "p07_disqualification",
    f"select id, {_DISQUALIFIED} refused, {_BLOCKED} blocked from fx_submissions",
)
def p07(v):
    return v.submissions.select(
        "id", review.disqualification().alias("refused"), review.blocker().alias("blocked")
    )


@check(
    "p08_source_rules",
    """select id from fx_submissions where not case source_kind
      when 'wikipedia' then source_sentence is not null and id % 3 <> 0
      when 'permit_record' then id % 5 <> 0 when 'moviemaps' then id % 5 <> 0
      when 'reelstreets' then id % 5 <> 0 and source_sentence is not null
      when 'movielocations' then id % 5 <> 0 and source_sentence is not null
      when 'open_plaques' then id % 5 <> 0 and source_sentence is not null
      when 'fandom' then source_sentence is not null and id % 3 <> 0 else false end""",
)
def p08(v):
    record = F.when(c("id") % 5 != 0, c("id").cast("string"))
    revision = F.when(c("id") % 3 != 0, c("id"))
    return review.source_rule_violations(v.submissions, record, revision).select("id")


@check(
    "a10_review_score",
    f"select id, cast({_SCORE} as double) score, array_to_string({_SIGNALS}, '+') signals from {_CORROBORATED}",
)
def a10(v):
    rows = computed(corroborated(v), _signals=review.signals(c("corroborated"), c("agrees")))
    return rows.select(
        "id", ev.review_score(c("_signals")).alias("score"), F.array_join("_signals", "+").alias("signals")
    )


@check("g05_submission_review", f"select id, verdict, score, reason from {_REVIEWED}")
def g05(v):
    return reviewed(v).select("id", "verdict", "score", "reason")


@check(
    "a12_verdict_tally",
    f"select verdict, reason, count(*) row_count from {_REVIEWED} group by rollup (verdict, reason)",
)
def a12(v):
    return review.tally(reviewed(v))


@check(
    "a16_links_from_group",
    f"""select place_id, work_id, least(1.0, max(score)) confidence from {_REVIEWED}
    where place_id is not null group by 1, 2""",
)
def a16(v):
    return review.best_link_score(reviewed(v).filter(c("place_id").isNotNull()))


@check(
    "a22_source_profile",
    f"""select source_kind, count(*) row_count, count(case when lat is not null and lng is not null and not (lat = 0 and lng = 0) then 1 end) located,
      round(avg(length(trim(place_name))), 4) mean_name_length,
      count(case when ({q.words('place_name')}) > 12 then 1 end) sentence_names from fx_submissions group by 1""",
)
def a22(v):
    return review.source_profile(v.submissions)


@check(
    "a25_single_point_names",
    f"""select work_id, count(*) names, count(case when points = 1 then 1 end) agreeing from (
      select work_id, {q.name_key('place_name')} n, count(distinct (lat, lng)) points from fx_submissions
      where lat is not null and not (lat = 0 and lng = 0) group by 1, 2) group by 1""",
)
def a25(v):
    return review.single_point_names(v.submissions)


@check(
    "j29_coordinate_agreement",
    _AGREEING,
)
def j29(v):
    return review.coordinate_agreement(v.submission_rows())


@check(
    "w04_first_per_place_key",
    """select work_id, place_key, id, photo from (select *, row_number() over (partition by work_id, place_key
        order by photo desc, id) n from (select *, lower(trim(place_name)) place_key, id % 3 = 0 photo from fx_submissions)) where n = 1""",
)
def w04(v):
    rows = v.submissions.select(
        "work_id", F.lower(F.trim("place_name")).alias("place_key"), "id",
        (c("id") % 3 == 0).alias("photo"),
    )
    order = F.struct(~c("photo"), c("id"))
    return review.first_per_key(rows, ["work_id", "place_key"], order)


@check(
    "w05_one_row_per_fact",
    """select work_id, place_id, relation_kind, min(link_id) link_id from fx_links group by 1, 2, 3""",
)
def w05(v):
    rows = v.links.select("work_id", "place_id", "relation_kind", "link_id")
    return review.first_per_key(rows, ["work_id", "place_id", "relation_kind"], c("link_id"))


@check(
    "s13_upsert",
    """with rows_ as (select work_id, lower(trim(place_name)) place_key, id, status, case when source_kind = 'moviemaps' then 1 else 0 end new_ from fx_submissions),
    best as (select *, row_number() over (partition by work_id, place_key order by case when new_ = 1 then id + 10 else id end desc, new_ desc, id) n from rows_)
    select work_id, place_key, max(case when new_ = 1 then id + 10 else id end) version from rows_ group by 1, 2""",
)
def s13(v):
    rows = v.submissions.select(
        "work_id", F.lower(F.trim("place_name")).alias("place_key"), "source_kind",
        c("id").alias("version"),
    )
    current = rows.filter(c("source_kind") != "moviemaps").drop("source_kind")
    incoming = rows.filter(c("source_kind") == "moviemaps").drop("source_kind").withColumn(
        "version", c("version") + 10
    )
    return review.upsert(current, incoming, ["work_id", "place_key"], "version")


@check(
    "s14_harvest_changes",
    """select id, case when id % 7 = 1 then 'new' when id % 11 = 2 then 'gone'
      when id % 5 = 3 and status <> 'verified' then 'changed' else 'same' end state
    from fx_submissions where not (id % 7 = 1 and id % 11 = 2)""",
)
def s14(v):
    rows = v.submissions.select("id", "work_id", "place_name", "status", "lat", "lng")
    before = rows.filter(c("id") % 7 != 1)
    after = rows.filter(c("id") % 11 != 2).withColumn(
        "status", F.when(c("id") % 5 == 3, "verified").otherwise(c("status"))
    )
    return review.harvest_changes(before, after, "id")


@check(
    "s20_fill_missing_ids",
    """with found as (select work_id, cast(work_id % 500 * 17 + 1 as varchar) t from fx_works where tmdb_id is null),
    offered as (select t, count(*) n from found group by 1)
    select w.work_id, coalesce(w.tmdb_id, case when k.t is null and o.n = 1 then f.t end) tmdb_id,
      coalesce(k.t is not null or o.n > 1, false) collision from fx_works w left join found f using (work_id)
      left join (select distinct tmdb_id t from fx_works where tmdb_id is not null) k on k.t = f.t left join offered o on o.t = f.t""",
)
def s20(v):
    found = v.works.filter(c("tmdb_id").isNull()).select(
        "work_id", (c("work_id") % 500 * 17 + 1).cast("string").alias("tmdb_id")
    )
    rows = review.fill_missing(v.works, found, "work_id", "tmdb_id")
    return rows.select("work_id", "tmdb_id", "collision")


@check(
    "d01_evidence_has_source",
    "select count(*) violations from fx_evidence where source_ref is null or length(trim(source_ref)) = 0",
)
def d01(v):
    bad = quality.evidence_without_source(v.evidence, ["source_ref"])
    return bad.agg(F.count(F.lit(1)).alias("violations"))


_UNPROVEN = """(select 'work' subject_type, link_id fact_id, place_id, relation_kind from fx_links l where not exists
    (select 1 from fx_evidence e where e.subject_type = 'link' and e.subject_id = l.link_id)
  union all select 'creator', fact_id, place_id, relation_kind from fx_creator_links l where not exists
    (select 1 from fx_evidence e where e.subject_type = 'creator_link' and e.subject_id = l.fact_id))"""


@check("j03_facts_without_evidence", f"select * from {_UNPROVEN}")
def j03(v):
    return quality.facts_without_evidence(v.links, v.creator_links, v.evidence)


@check(
    "d02_unproven_facts",
    f"select subject_type, relation_kind, count(*) violations from {_UNPROVEN} group by 1, 2",
)
def d02(v):
    bad = quality.facts_without_evidence(v.links, v.creator_links, v.evidence)
    return bad.groupBy("subject_type", "relation_kind").agg(F.count(F.lit(1)).alias("violations"))


@check(
    "d03_unique_keys",
    """select imdb_key, title_key, row_count from (select case when work_id % 2 = 0 then imdb_id end imdb_key,
      title title_key, count(*) row_count from fx_works group by 1, 2) where row_count > 1""",
)
def d03(v):
    rows = v.works.select(
        F.when(c("work_id") % 2 == 0, c("imdb_id")).alias("imdb_key"), c("title").alias("title_key")
    )
    return quality.duplicate_keys(rows, ["imdb_key", "title_key"])


@check(
    "d04_coordinates",
    """select place_id, case when (lat is null) <> (g is null) then 'half_a_coordinate' else 'out_of_range' end violation
    from (select place_id, lat, case when place_id % 9 = 0 then null when place_id % 9 = 1 then lng * 3 else lng end g from fx_places)
    where (lat is null) <> (g is null) or abs(lat) > 90 or abs(g) > 180""",
)
def d04(v):
    lng = F.when(c("place_id") % 9 == 0, None).when(c("place_id") % 9 == 1, c("lng") * 3).otherwise(c("lng"))
    return quality.bad_coordinates(v.places.withColumn("lng", lng)).select("place_id", "violation")


@check(
    "d05_geocode_provenance",
    """select id, case when lat is not null and id % 4 = 0 then 'no_geocode_source' else 'id_echoes_geocode' end violation
    from fx_submissions where (lat is not null and id % 4 = 0) or (id % 4 = 1 and wikidata_id is not null)""",
)
def d05(v):
    rows = v.submissions.withColumn(
        "geocode_source", F.when(c("id") % 4 == 1, "wikidata").when(c("id") % 4 != 0, "moviemaps")
    ).withColumn("geocode_source_id", c("wikidata_id"))
    return quality.bad_geocodes(rows).select("id", "violation")


@check(
    "d06_closed_values",
    """select fact_id, relation_kind from (select fact_id, case when fact_id % 10 = 3 then 'studio_of' else relation_kind end relation_kind from fx_creator_links)
    where relation_kind = 'studio_of'""",
)
def d06(v):
    kind = F.when(c("fact_id") % 10 == 3, "studio_of").otherwise(c("relation_kind"))
    rows = v.creator_links.withColumn("relation_kind", kind)
    known = quality.outside_values(rows, "relation_kind", quality.RELATIONS)
    return quality.bad_person_relations(rows).unionByName(known).select("fact_id", "relation_kind")


@check(
    "d07_guarded_repairs",
    """select work_id, source, score, s <= 10 repaired, false again from (select work_id, source, score, case when source = 'imdb' and work_id % 3 = 0 then score / 10 else score end s from fx_ratings)""",
)
def d07(v):
    wrong = F.when((c("source") == "imdb") & (c("work_id") % 3 == 0), c("score") / 10).otherwise(c("score"))
    once = quality.repair_scale(v.ratings.withColumn("score", wrong))
    twice = quality.repair_scale(once.withColumnRenamed("repaired", "first"))
    return twice.select(
        "work_id", "source", F.round("score", 6).alias("score"), c("first").alias("repaired"),
        c("repaired").alias("again"),
    )


@check(
    "u01_all_facts",
    """select l.link_id fact_id, 'work' subject_type, l.work_id subject_id, w.title subject_name, w.kind subject_kind, l.place_id, l.relation_kind
    from fx_links l join fx_works w using (work_id) union all
    select l.fact_id, 'creator', l.creator_id, k.name, k.kind, l.place_id, l.relation_kind from fx_creator_links l join fx_creators k using (creator_id)""",
)
def u01(v):
    facts = cards.all_facts(v.links, v.works, v.creator_links, v.creators)
    return facts.select(
        "fact_id", "subject_type", "subject_id", "subject_name", "subject_kind", "place_id", "relation_kind"
    )


@check(
    "u02_missing_evidence",
    """with planned as (select subject_type, subject_id, method, case when subject_id % 3 = 0 then null else source_ref end source_ref from fx_evidence)
    select distinct subject_type, subject_id, method, source_ref from planned p where not exists (select 1 from fx_evidence e
      where e.method <> 'text_mention' and e.subject_type = p.subject_type and e.subject_id = p.subject_id and e.method = p.method
      and coalesce(e.source_ref, '') = coalesce(p.source_ref, ''))""",
)
def u02(v):
    from ..plans import promotion

    ref = F.when(c("subject_id") % 3 == 0, None).otherwise(c("source_ref"))
    planned = v.evidence.withColumn("source_ref", ref)
    held = v.evidence.filter(c("method") != "text_mention")
    return promotion.missing_evidence(planned, held).select(
        "subject_type", "subject_id", "method", "source_ref"
    )


@check(
    "a09_confidence_fusion",
    """with w as (select subject_type, subject_id, agrees, least(1.0, greatest(0.0, coalesce(weight, case method
        when 'wikidata_statement' then 0.9 when 'wikidata_studio_entity' then 0.85 when 'manual_fix' then 0.95 when 'vision_verify' then 0.8
        when 'mapillary_match' then 0.7 when 'commons_geosearch' then 0.6 when 'web_search_cited' then 0.55 when 'text_mention' then 0.5 else 0.2 end))) w from fx_evidence)
    select subject_type, subject_id, supporting, floor(c * 1000 + 0.5) / 1000 confidence from (select subject_type, subject_id, count(case when agrees is not false then 1 end) supporting,
      case when count(case when agrees is not false then 1 end) = 0 then 0 else (1 - coalesce(product(case when agrees is not false then 1 - w end), 1))
        * coalesce(product(case when agrees = false then 1 - w end), 1) end c from w group by 1, 2)""",
)
def a09(v):
    got = ev.fused_confidence(c("method"), c("weight"), c("agrees"))
    return v.evidence.groupBy("subject_type", "subject_id").agg(
        got["supporting"].alias("supporting"), got["confidence"].alias("confidence")
    )
