"""Catalogue, directory, rankings, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fold
from ..operators import catalogue, mapview
from . import sqltext as q
from .registry import check

c = F.col

_INDEX = f"""(select w.*, {q.title_key('w.title')} title_norm, s.place_count from fx_works w join
  (select work_id, count(*) place_count from fx_submissions where status <> 'rejected' and lat is not null
   group by 1) s using (work_id))"""
_SORT_KEY = "regexp_replace(title_norm, '^(the|an|a) ', '')"
_LETTER = f"case when substring({_SORT_KEY}, 1, 1) between 'a' and 'z' then substring({_SORT_KEY}, 1, 1) else '#' end"
_RATED = """(select w.work_id, coalesce(r.score, t.score) score,
  case when r.score is not null then r.votes else t.votes end votes,
  case when r.score is not null then 'imdb' when t.score is not null then 'tmdb' end source
  from fx_works w left join fx_ratings r on r.work_id = w.work_id and r.source = 'imdb'
  left join fx_ratings t on t.work_id = w.work_id and t.source = 'tmdb')"""


@check(
    "j01_works_links_places",
    f"""select l.link_id, w.title, p.name from fx_links l join fx_works w using (work_id)
    join ({q.MAPPABLE}) p using (place_id) where l.relation_kind = 'filming_location'""",
)
def j01(v):
    links = v.links.filter(c("relation_kind") == "filming_location")
    shown = mapview.mappable(v.places, v.evidence).select("place_id", "name")
    return links.join(shown, "place_id").join(v.works.select("work_id", "title"), "work_id").select(
        "link_id", "title", "name"
    )


@check("j04_first_rating", f"select work_id, source rating_source, score rating_score, votes rating_votes from {_RATED} where source is not null")
def j04(v):
    return mapview.rating_columns(v.ratings, ["imdb", "tmdb"])


@check(
    "a04_mapped_works",
    f"""select w.work_id, w.title, m.place_count, r.ratings from fx_works w join
      (select work_id, count(distinct place_id) place_count from fx_links
       where place_id in (select place_id from ({q.MAPPABLE})) group by 1) m using (work_id)
      left join (select work_id, string_agg(concat(source, ':', cast(cast(score as bigint) as varchar)), ','
        order by source) ratings from fx_ratings group by 1) r using (work_id)""",
)
def a04(v):
    rows = catalogue.mapped_works(
        v.links, v.works, mapview.mappable(v.places, v.evidence), v.ratings
    )
    shown = F.array_join(
        F.transform(
            "ratings",
            lambda r: F.concat(r["source"], F.lit(":"), r["score"].cast("long").cast("string")),
        ),
        ",",
    )
    return rows.select("work_id", "title", "place_count", shown.alias("ratings"))


@check(
    "a05_catalogue_index",
    f"select work_id, title_norm, year, kind, imdb_id, tmdb_id, place_count, title from {_INDEX}",
)
def a05(v):
    return catalogue.catalogue_index(v.works, v.submissions).select(
        "work_id", "title_norm", "year", "kind", "imdb_id", "tmdb_id", "place_count", "title"
    )


@check(
    "a06_letter_totals",
    f"select {_LETTER} letter, count(*) works, cast(sum(place_count) as bigint) points from {_INDEX} group by 1",
)
def a06(v):
    return catalogue.letter_totals(catalogue.catalogue_index(v.works, v.submissions))


@check(
    "a19_pages_per_site",
    "select regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) host, count(*) page_count from pages group by 1",
)
def a19(v):
    return catalogue.works_per_host(v.table("pages"))


@check(
    "a20_cities_by_country",
    f"""with totals as (select a.anchor_id, a.name, a.country_id, count(distinct s.work_id) works from fx_anchors a
    left join (select * from fx_submissions where status <> 'rejected' and lat is not null and not (lat = 0 and lng = 0)) s
      on abs(s.lat - a.lat) < 0.1 and {q.metres('a.lat', 'a.lng', 's.lat', 's.lng')} <= greatest(1, least(a.radius_km, 200)) * 1000
    group by 1, 2, 3)
    select country_id, cast(sum(works) as bigint) works, string_agg(name, '|' order by works desc, name) cities
    from totals group by 1""",
)
def a20(v):
    near = catalogue.near_anchors(v.anchors, v.submissions)
    totals = catalogue.anchor_totals(near, v.anchors).join(
        v.anchors.select("anchor_id", "name", "country_id"), "anchor_id"
    )
    return catalogue.cities_by_country(totals).withColumn("cities", F.array_join("cities", "|"))


_TRIGRAMS = "list_distinct(flatten([[substring('  ' || w || ' ', i, 3) for i in range(1, len(w) + 2)] for w in string_split({x}, ' ') if w <> '']))"


@check(
    "t01_search_works",
    f"""with scored as (select work_id, title, t, {_TRIGRAMS.format(x='t')} a, {_TRIGRAMS.format(x="'small widget'")} b
      from (select *, {q.title_key('title')} t from fx_works)),
    liked as (select *, len(list_intersect(a, b)) / cast(len(a) + len(b) - len(list_intersect(a, b)) as double) s from scored)
    select work_id, title, round(case when t = 'small widget' then 4.0 when starts_with(t, 'small widget') then 3.0
      when instr(t, ' small widget') > 0 then 2.0 else 1.0 + s end, 6) as rank,
      (select count(*) from fx_links l where l.work_id = x.work_id) link_count
    from liked x where starts_with(t, 'small widget') or instr(t, ' small widget') > 0 or s > 0.2
    order by 3 desc, 4 desc, length(title), title, work_id limit 25""",
)
def t01(v):
    rows = catalogue.search_works(v.works, v.links, "small widget", limit=25)
    return rows.select("work_id", "title", F.round("rank", 6).alias("rank"), "link_count")


_NOTABLE = f"""(select w.work_id, w.title, r.score * log10(cast(r.votes * case r.source when 'tmdb' then 53 else 1 end as double)) v
  from fx_works w join {_RATED} r using (work_id)
  where r.votes >= case r.source when 'tmdb' then 19 else 1000 end)"""


@check(
    "t02_notable_here",
    f"select work_id, title, round(v, 6) notability from {_NOTABLE} order by v desc, title, work_id limit 5",
)
def t02(v):
    rows = catalogue.notable(v.works, mapview.rating_columns(v.ratings, ["imdb", "tmdb"]))
    return rows.select("work_id", "title", F.round("notability", 6).alias("notability"))


@check(
    "t03_interests_deck",
    """with placed as (select l.work_id, count(distinct l.place_id) places, count(distinct case when
        p.lat between 14 - 25 / 111.0 and 14 + 25 / 111.0
        and p.lng between -108 - 25 / (111.0 * cos(radians(14))) and -108 + 25 / (111.0 * cos(radians(14)))
        then l.place_id end) nearby from fx_links l join fx_places p using (place_id) group by 1),
    ranked as (select w.work_id, w.title, w.kind, p.places, p.nearby,
        round(r.score / 10 * log10(cast(r.votes as double)), 3) fame from fx_works w join placed p using (work_id)
        left join fx_ratings r on r.work_id = w.work_id and r.source = 'imdb' and r.votes >= 1000)
    (select * from ranked where kind <> 'book' and fame is not null order by nearby > 0 desc, fame desc, work_id limit 60)
    union all (select * from ranked where kind = 'book' order by nearby > 0 desc, places desc, work_id limit 20)""",
)
def t03(v):
    return catalogue.interests_deck(v.links, v.places, v.works, v.ratings, 14.0, -108.0)


@check(
    "t04_letter_page",
    f"""select work_id, title, place_count, total_works, cast(page as int) page, page < ceil(total_works / 20.0) has_next from (
      select *, least(2, greatest(1, ceil(total_works / 20.0))) page from (
        select *, count(*) over () total_works, row_number() over (order by {_SORT_KEY}, year nulls last, work_id) n
        from {_INDEX} where {_LETTER} = 's')) where n between (page - 1) * 20 + 1 and page * 20""",
)
def t04(v):
    index = catalogue.catalogue_index(v.works, v.submissions)
    return catalogue.letter_page(index, "S", page=2, per_page=20)


@check(
    "t08_city_suggestions",
    """select city_id, name from (select anchor_id city_id, name, case when anchor_id % 3 = 0 then anchor_id * 1000 end population,
      case when anchor_id % 4 = 0 then 12.0 end area_km2, anchor_id % 7 sitelinks from fx_anchors)
    order by population is not null or area_km2 is not null desc, sitelinks desc, coalesce(population, 0) desc,
      length(name), city_id limit 10""",
)
def t08(v):
    rows = v.anchors.select(
        c("anchor_id").alias("city_id"), "name",
        F.when(c("anchor_id") % 3 == 0, c("anchor_id") * 1000).alias("population"),
        F.when(c("anchor_id") % 4 == 0, 12.0).alias("area_km2"),
        (c("anchor_id") % 7).alias("sitelinks"),
    )
    return catalogue.city_suggestions(rows, limit=10).select("city_id", "name")


@check(
    "w01_nearby_works",
    """with n as (select work_id, count(*) n from fx_links group by 1 order by 2 desc, 1 limit 5)
    select work_id, link_id, work_rank from (select l.work_id, l.link_id, w.work_rank,
      row_number() over (partition by l.work_id order by narrative_order, link_id) r from fx_links l
      join (select *, cast(row_number() over (order by n desc, work_id) as int) work_rank from n) w using (work_id))
    where r <= 6""",
)
def w01(v):
    return catalogue.nearby_works(v.links).select("work_id", "link_id", "work_rank")


@check(
    "w02_balanced_kinds",
    """with n as (select l.work_id, w.kind, count(*) n from fx_links l join fx_works w using (work_id) group by 1, 2)
    select work_id, kind, n, cast(turn as int) turn from (select *, row_number() over (partition by kind order by n desc, work_id) turn
      from n where kind in ('film', 'series', 'book'))
    order by turn, case kind when 'film' then 1 when 'series' then 2 else 3 end limit 10""",
)
def w02(v):
    counts = v.links.join(v.works.select("work_id", "kind"), "work_id").groupBy("work_id", "kind").agg(
        F.count(F.lit(1)).alias("n")
    )
    return catalogue.balanced_kinds(counts, ["film", "series", "book"], 10)


@check(
    "w03_totals_beside_rows",
    f"""select work_id, place_count, count(*) over () total_works, cast(sum(place_count) over () as bigint) total_points from {_INDEX}""",
)
def w03(v):
    index = catalogue.catalogue_index(v.works, v.submissions).select("work_id", "place_count")
    return catalogue.with_totals(index, "place_count")


@check(
    "w12_label_ceiling",
    f"""with ranked as (select *, row_number() over (order by v desc, title, work_id) r from {_NOTABLE}),
    spots as (select round(s.lat, 5) lat, round(s.lng, 5) lng, min(r) r from ranked n
      join ({q.VISIBLE_QUEUE}) s on s.work_id = n.work_id group by 1, 2)
    select s.lat, s.lng, n.title from spots s join ranked n on n.r = s.r order by s.r, s.lat, s.lng limit 8""",
)
def w12(v):
    rated = mapview.rating_columns(v.ratings, ["imdb", "tmdb"])
    return catalogue.label_ceiling(mapview.visible_queue(v.submissions), v.works, rated, 8)


@check("s15_catalogue_snapshot", f"select work_id, title_norm, place_count from {_INDEX}")
def s15(v):
    from ..sources import writers

    index = catalogue.catalogue_index(v.works, v.submissions)
    return writers.snapshot_columns(index)


@check(
    "u04_library_and_catalogue",
    f"""select work_id, exists (select 1 from fx_library l where l.truth_work_id = w.work_id) in_library,
      exists (select 1 from {_INDEX} i where i.work_id = w.work_id) has_places from fx_works w""",
)
def u04(v):
    index = catalogue.catalogue_index(v.works, v.submissions).select("work_id")
    owned = v.library.select(c("truth_work_id").alias("work_id"))
    return catalogue.membership(v.works.select("work_id"), owned, index)
