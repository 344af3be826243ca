"""Scalar functions, one projection each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import facts as fa
from ..functions import fold, geo, phrases, ratings
from . import sqltext as q
from .registry import check

c = F.col


@check(
    "f01_normalize_title",
    f"select work_id, {q.title_key('title')} title_norm from fx_works",
)
def f01(v):
    return v.works.select("work_id", fold.normalize_title(c("title")).alias("title_norm"))


@check(
    "f02_normalize_name",
    f"select place_id, {q.name_key('name')} name_norm from fx_places",
)
def f02(v):
    return v.places.select("place_id", fold.normalize_name(c("name")).alias("name_norm"))


@check(
    "f03_directory_sort_key",
    f"""select work_id, sort_key,
      case when sort_key between 'a' and '{{' and substring(sort_key, 1, 1) between 'a' and 'z'
        then substring(sort_key, 1, 1) else '#' end letter
    from (select work_id, regexp_replace(lower(trim({q.title_key('title')})),
      '^(the|an|a) ', '') sort_key from fx_works)""",
)
def f03(v):
    key = fold.normalize_title(c("title"))
    return v.works.select("work_id", key.alias("key")).select(
        "work_id",
        fold.directory_sort_key(c("key")).alias("sort_key"),
        fold.letter_bucket(c("key")).alias("letter"),
    )


def _with_anchor(v):
    a = v.anchors.select(
        c("anchor_id"), c("lat").alias("a_lat"), c("lng").alias("a_lng"), "radius_km"
    )
    return v.places.join(a, c("city_id") == c("anchor_id"))


@check(
    "f04_great_circle",
    f"""select p.place_id,
      round({q.metres('p.lat', 'p.lng', 'a.lat', 'a.lng')}, 3) metres
    from fx_places p join fx_anchors a on a.anchor_id = p.city_id""",
)
def f04(v):
    m = geo.haversine_m(c("lat"), c("lng"), c("a_lat"), c("a_lng"))
    return _with_anchor(v).select("place_id", F.round(m, 3).alias("metres"))


@check(
    "f05_flat_distance",
    f"""select p.place_id,
      round({q.flat_km('p.lat', 'p.lng', 'a.lat', 'a.lng')}, 6) km
    from fx_places p join fx_anchors a on a.anchor_id = p.city_id""",
)
def f05(v):
    km = geo.flat_km(c("lat"), c("lng"), c("a_lat"), c("a_lng"))
    return _with_anchor(v).select("place_id", F.round(km, 6).alias("km"))


@check(
    "f06_grid_cells",
    """select place_id,
      cast(floor(lat / greatest(0.0005, 360.0 / 8192)) as bigint) gy_8,
      cast(floor(lng / greatest(0.0005, 360.0 / 8192)) as bigint) gx_8,
      cast(floor(lat / greatest(0.0005, 360.0 / 524288)) as bigint) gy_14,
      cast(floor(lng / greatest(0.0005, 360.0 / 524288)) as bigint) gx_14
    from fx_places""",
)
def f06(v):
    return v.places.select(
        "place_id",
        *[
            geo.grid_id(c(col), geo.cluster_cell(z)).alias(f"{name}_{z}")
            for z in (8, 14)
            for name, col in (("gy", "lat"), ("gx", "lng"))
        ],
    )


@check(
    "f07_coordinate_validity",
    """select id,
      coalesce(lat between -90 and 90 and lng between -180 and 180, false) valid,
      lat is not null and lng is not null and not (lat = 0 and lng = 0) has_point,
      try_cast(split_part(source_url, '/', 4) as double) finite
    from fx_submissions""",
)
def f07(v):
    lat, lng = c("lat"), c("lng")
    return v.submissions.select(
        "id",
        geo.valid_coordinate(lat, lng).alias("valid"),
        F.coalesce(geo.has_point(lat, lng), F.lit(False)).alias("has_point"),
        geo.finite_or_null(F.split_part("source_url", F.lit("/"), F.lit(4))).alias("finite"),
    )


_METHOD_CASE = " ".join(f"when '{k}' then {w}" for k, w in ev.METHOD_WEIGHTS.items())


@check(
    "f08_evidence_weight",
    f"""select method, w, case when w >= 0.75 then 'verified' when w >= 0.4 then 'candidate'
        else 'weak' end band, count(*) row_count
    from (select method, round(least(1, greatest(0, coalesce(weight,
      case method {_METHOD_CASE} end))), 4) w from fx_evidence)
    group by all""",
)
def f08(v):
    w = F.round(ev.evidence_weight(c("method"), c("weight")), 4)
    return (
        v.evidence.select("method", w.alias("w"))
        .withColumn("band", ev.confidence_band(c("w")))
        .groupBy("method", "w", "band")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def _type_case(column: str) -> str:
    items = [
        (w, p, i)
        for i, (p, known) in enumerate(ev.PRECISION_WORDS.items())
        for w in known
    ]
    items.sort(key=lambda x: (-len(x[0]), x[2]))
    arms = " ".join(f"when contains({column}, '{w}') then '{p}'" for w, p, _ in items)
    return f"case {arms} else 'unknown' end"


@check(
    "f09_precision_from_type",
    f"""select place_id, by_type,
      case when stated in ('point', 'building', 'street', 'settlement', 'region', 'country')
        then stated when numbered then 'building' else by_type end resolved
    from (select place_id, {_type_case("strip_accents(lower(name))")} by_type,
        geocode_precision stated, place_id % 7 = 0 numbered from fx_places)""",
)
def f09(v):
    name = F.when(c("place_id") % 7 == 0, F.concat(c("place_id").cast("string"), F.lit(" "), "name"))
    return v.places.select(
        "place_id",
        ev.precision_from_type(c("name")).alias("by_type"),
        ev.resolved_precision(
            c("geocode_precision"), F.coalesce(name, c("name")), c("name")
        ).alias("resolved"),
    )


@check(
    "f10_display_grade",
    """select place_id, display, confirmed,
      case when display = 'area' then 'The source names this area, not a spot inside it.' end caveat
    from (select place_id, status = 'verified' or confidence >= 0.6 confirmed,
      case when p in ('point', 'building', 'street') then 'pin' when p = 'unknown' then 'hidden'
        else 'area' end display
      from (select *, case geocode_precision when 'city' then 'settlement'
        else geocode_precision end p from fx_places))""",
)
def f10(v):
    p = F.when(c("geocode_precision") == "city", "settlement").otherwise(c("geocode_precision"))
    display = ev.display_grade(p)
    return v.places.select(
        "place_id",
        display.alias("display"),
        ((c("status") == "verified") | (c("confidence") >= 0.6)).alias("confirmed"),
        F.when(
            display == "area", "The source names this area, not a spot inside it."
        ).alias("caveat"),
    )


@check(
    "f11_phrase_split",
    f"""select id, head, array_to_string(areas, '|') areas,
      coalesce(refusal, case when len(areas) = 0 then 'no_area_to_check_against' end) refusal
    from (select id, case when refusal is null then h end head,
        case when refusal is null then areas else cast([] as varchar[]) end areas, refusal
      from (select id, h, areas, {q.head_refusal('h')} refusal
        from (select id, {q.head('place_name')} h, {q.areas('place_name')} areas
          from fx_submissions)))""",
)
def f11(v):
    return v.submissions.select("id", phrases.split_phrase(c("place_name")).alias("s")).select(
        "id",
        "s.head",
        F.array_join("s.areas", "|").alias("areas"),
        "s.refusal",
    )


@check(
    "f12_score_scales",
    f"""select work_id, source,
      case when votes % 3 = 0 then {q.half_up('floor(score)', 2)}
        when votes % 3 = 1 and votes % 11 <= 10 then {q.half_up('(votes % 11) / 10.0 * 100', 2)}
        end parsed,
      {q.half_up('score * 10 / 100', 1)} shown,
      {q.half_up('score / 20 * 10 / 5', 1)} own
    from fx_ratings""",
)
def f12(v):
    display = (
        F.when(c("votes") % 3 == 0, F.concat(F.floor("score").cast("string"), F.lit("%")))
        .when(c("votes") % 3 == 1, F.concat((c("votes") % 11).cast("string"), F.lit(" / 10")))
        .otherwise("n/a")
    )
    return v.ratings.select(
        "work_id",
        "source",
        ratings.normalize_score(display).alias("parsed"),
        ratings.in_source_scale(c("source"), c("score")).alias("shown"),
        ratings.to_ten_point(c("score") / 20, F.lit("letterboxd")).alias("own"),
    )


def _with_place(v):
    p = v.places.select(c("place_id"), c("name").alias("p_name"))
    return v.submissions.join(p, "place_id")


@check(
    "f13_names_match",
    f"""select id, {q.names_match('a', 'b')} same_name
    from (select s.id, {q.name_key('s.place_name')} a, {q.name_key('p.name')} b
      from fx_submissions s join fx_places p on p.place_id = s.place_id)""",
)
def f13(v):
    rows = _with_place(v).select(
        "id",
        fold.normalize_name(c("place_name")).alias("a"),
        fold.normalize_name(c("p_name")).alias("b"),
    )
    return rows.select("id", fold.names_match(c("a"), c("b")).alias("same_name"))


@check(
    "f14_same_place_written",
    f"""select id, ha <> '' and ha = hb and (len(ka) = 0 or len(kb) = 0
        or list_has_any(ka, kb)) same_place
    from (select s.id, {q.name_key(q.head('s.place_name'))} ha, {q.name_key(q.head('p.name'))} hb,
        {q.area_keys('s.place_name')} ka, {q.area_keys("concat(p.name, ', Old Town')")} kb
      from fx_submissions s join fx_places p on p.place_id = s.place_id)""",
)
def f14(v):
    other = F.concat("p_name", F.lit(", Old Town"))
    return _with_place(v).select(
        "id", phrases.same_place_written(c("place_name"), other).alias("same_place")
    )


@check(
    "f15_coordinate_precision",
    """select place_id, label, case when
        list_position(['none', 'country', 'city', 'street', 'building', 'point'], label) <=
        list_position(['none', 'country', 'city', 'street', 'building', 'point'], geocode_precision)
        then label else geocode_precision end coarsest
    from (select place_id, geocode_precision, case when d >= 1 then 'country' when d >= 0.1
        then 'city' when d >= 0.01 then 'street' else 'point' end label
      from (select *, (place_id % 13) * (place_id % 13) / 100.0 d from fx_places))""",
)
def f15(v):
    d = (c("place_id") % 13) * (c("place_id") % 13) / 100.0
    label = ev.source_precision(d)
    return v.places.select(
        "place_id", label.alias("label"), ev.coarser(label, c("geocode_precision")).alias("coarsest")
    )


@check(
    "f16_tiles",
    """select place_id, cast(floor((lng + 180) / 360 * 8192) as bigint) x,
      cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8192) as bigint) y
    from fx_places""",
)
def f16(v):
    return v.places.select(
        "place_id", geo.tile_x(c("lng"), 13).alias("x"), geo.tile_y(c("lat"), 13).alias("y")
    )


@check(
    "f17_walking",
    f"""select fix_id,
      case when m <= 0 then 0.0 else greatest(1.0, {q.half_up('m / 1000 / 4.2 * 60')}) end walk_minutes,
      case when m < 1000 then concat(cast(cast({q.half_up('m / 10')} * 10 as bigint) as varchar), ' m')
        else concat(printf('%.1f', m / 1000), ' km') end walk_label,
      case when accuracy_m <= 0 then 45.0 else least({q.half_up('accuracy_m')}, 250.0) end radius,
      least(500.0, greatest(0.5, ceil(m / 100) / 10)) search_km
    from (select *, floor(accuracy_m * 50) + 0.25 m from fx_fixes)
    where m < 10000""",
)
def f17(v):
    m = c("m")
    rows = v.fixes.withColumn("m", F.floor(c("accuracy_m") * 50) + F.lit(0.25)).filter(m < 10000)
    return rows.select(
        "fix_id",
        geo.walking_minutes(m).alias("walk_minutes"),
        geo.walk_distance_label(m).alias("walk_label"),
        geo.trigger_radius(c("accuracy_m")).alias("radius"),
        geo.search_radius_km(m).alias("search_km"),
    )


@check(
    "f18_scene_note",
    """select id, case when source_sentence is null then null
        when lower(place_name) like '%, old town' then 'They walked past it in scene '
          || split_part(split_part(source_sentence, ' scene ', 2), ' ', 1) || ' of the film'
        else 'They walked past it in scene '
          || split_part(split_part(source_sentence, ' scene ', 2), ' ', 1) || ' of the film' end note
    from fx_submissions""",
)
def f18(v):
    caption = F.concat(
        F.lit("Some Film film location:  "), "source_sentence", F.lit(": "), "place_name",
        F.lit(". Source: Wiki."),
    )
    return v.submissions.select("id", phrases.scene_note(caption, c("place_name")).alias("note"))


@check(
    "f19_title_matches",
    f"""select work_id, a = b or starts_with(a, concat(b, ' ')) matches
    from (select work_id, {q.title_key("case work_id % 3 when 0 then concat(title, ' II') when 1 then title else concat('X', title) end")} a,
      {q.title_key('title')} b from fx_works)""",
)
def f19(v):
    record = (
        F.when(c("work_id") % 3 == 0, F.concat("title", F.lit(" II")))
        .when(c("work_id") % 3 == 1, c("title"))
        .otherwise(F.concat(F.lit("X"), "title"))
    )
    return v.works.select("work_id", phrases.title_matches(record, c("title")).alias("matches"))


_PLAIN = "translate(text, '‘’ʼ′“”″–—−', '''''''''\"\"\"---')"
_QUOTE_FORM = f"lower({q.squash('replace(' + _PLAIN + ', ' + q.text('…') + ', ' + q.text('...') + ')')})"


@check(
    "f20_quote_form",
    f"""select doc_id, md5({_QUOTE_FORM}) form,
      length({q.squash(f"regexp_replace(text, {q.text(phrases.ATTRIBUTION)}, ' ', 'g')")}) >= 20 says_something
    from documents""",
)
def f20(v):
    return v.table("documents").select(
        "doc_id",
        F.md5(phrases.quote_form(c("text"))).alias("form"),
        phrases.states_something(c("text")).alias("says_something"),
    )


_KIND = "case doc_id % 3 when 0 then 'wikipedia' when 1 then 'open_plaques' else 'fandom' end"


@check(
    "f21_quote_limits",
    f"""select doc_id, case when t = '' then 'quote_empty'
        when len(regexp_extract_all(t, '[.!?](?:\\s|$)')) > 1 then 'quote_multiple_sentences'
        when ({q.words('t')}) > 45 then 'quote_too_long' end refusal,
      kind in ('wikipedia', 'open_plaques') and not regexp_matches(s, '^[*#:;]')
        and length(s) <= 500 and length(s) >= 20 quotable
    from (select doc_id, trim(text) t, {q.squash('text')} s, {_KIND} kind from documents)""",
)
def f21(v):
    kind = (
        F.when(c("doc_id") % 3 == 0, "wikipedia")
        .when(c("doc_id") % 3 == 1, "open_plaques")
        .otherwise("fandom")
    )
    return v.table("documents").select(
        "doc_id",
        phrases.quote_rejection(c("text")).alias("refusal"),
        phrases.quotable(kind, c("text")).isNotNull().alias("quotable"),
    )


@check(
    "f22_role_evidence",
    f"""select item_id,
      regexp_matches(s, {q.text(phrases.FILMING_EVIDENCE)}) and not plan filming,
      regexp_matches(s, {q.text(phrases.AUTHOR_EVIDENCE)}) and not plan author, plan, person
    from (select item_id, s, regexp_matches(s, {q.text(phrases.PLAN_NOT_FACT)}) plan,
        regexp_matches(regexp_replace(substring(s, 12), '^[\\s,]+', ''),
          {q.text(phrases.PERSON_ACTION)}) person
      from (select item_id, concat('Market Hall ', case item_id % 4 when 0 then 'was filmed for '
        when 1 then 'may be shot in ' when 2 then 'wrote and drafted ' else 'appears in ' end, text) s
        from benchmark))""",
)
def f22(v):
    verb = (
        F.when(c("item_id") % 4 == 0, "was filmed for ")
        .when(c("item_id") % 4 == 1, "may be shot in ")
        .when(c("item_id") % 4 == 2, "wrote and drafted ")
        .otherwise("appears in ")
    )
    s = F.concat(F.lit("Market Hall "), verb, "text")
    return v.table("benchmark").select(
        "item_id",
        phrases.supports_role(s, F.lit("filming_location")).alias("filming"),
        phrases.supports_role(s, F.lit("author_place")).alias("author"),
        s.rlike(phrases.js(phrases.PLAN_NOT_FACT)).alias("plan"),
        phrases.names_a_person(F.lit("Market Hall"), s).alias("person"),
    )


@check("f23_clean_wikitext")
def f23(v):
    text = phrases.clean_wikitext(c("html"))
    return v.table("pages").select("page_id", F.md5(text).alias("form"), F.length(text).alias("n"))


@check(
    "f24_wkt_point",
    """select place_id, cast(place_id % 90 as double) + 0.5 lat, cast(-(place_id % 180) as double) lng,
      cast(1900 + place_id % 120 as int) release_year, concat('Q', cast(place_id + 1 as varchar)) entity
    from fx_places""",
)
def f24(v):
    wkt = F.concat(
        F.lit("Point("), (-(c("place_id") % 180)).cast("string"), F.lit(" "),
        (c("place_id") % 90).cast("string"), F.lit(".5)"),
    )
    point = geo.wkt_point(wkt)
    date = F.concat(F.lit("+"), (1900 + c("place_id") % 120).cast("string"), F.lit("-01-01T00:00:00Z"))
    uri = F.concat(F.lit("http://example.org/entity/Q"), (c("place_id") + 1).cast("string"))
    return v.places.select(
        "place_id",
        point["lat"].alias("lat"),
        point["lng"].alias("lng"),
        F.regexp_extract(date, r"^([+-]?\d{1,6})-", 1).try_cast("int").alias("release_year"),
        F.regexp_extract(uri, r"Q\d+$", 0).alias("entity"),
    )


_DOC_KIND = "case doc_id % 3 when 0 then 'film' when 1 then 'book' else 'series' end"


@check(
    "f25_inscription_relation",
    f"""select doc_id, case when regexp_matches(t, {q.text(phrases.FILMED_VERBS)}) then 'filming_location'
        when regexp_matches(t, {q.text(phrases.AUTHOR_VERBS)}) then 'author_place'
        when kind = 'book' then 'narrative_location' else 'filming_location' end relation,
      regexp_matches(t, {q.text(phrases.VICTIM_MEMORIAL)}) victim,
      case kind when 'book' then regexp_matches(t, {q.text(phrases.CLAIM_WORDS['book'])})
        when 'series' then regexp_matches(t, {q.text(phrases.CLAIM_WORDS['series'])})
        else regexp_matches(t, {q.text(phrases.CLAIM_WORDS['film'])}) end claims
    from (select doc_id, {_DOC_KIND} kind, concat(case doc_id % 5 when 0 then 'He lived here. '
      when 1 then 'Premiered here. ' when 2 then 'Stolperstein. ' else '' end, text) t from documents)""",
)
def f25(v):
    kind = (
        F.when(c("doc_id") % 3 == 0, "film").when(c("doc_id") % 3 == 1, "book").otherwise("series")
    )
    lead = (
        F.when(c("doc_id") % 5 == 0, "He lived here. ")
        .when(c("doc_id") % 5 == 1, "Premiered here. ")
        .when(c("doc_id") % 5 == 2, "Stolperstein. ")
        .otherwise("")
    )
    text = F.concat(lead, "text")
    return v.table("documents").select(
        "doc_id",
        phrases.relation_from_inscription(text, kind).alias("relation"),
        phrases.victim_memorial(text).alias("victim"),
        phrases.has_claim_word(text, kind).alias("claims"),
    )


@check(
    "f26_access_verdict",
    """select place_id, case place_id % 6 when 0 then 'view_only' when 1 then 'closed'
        when 2 then 'ticketed' when 3 then 'open' else 'unknown' end access,
      case place_id % 6 when 0 then 'osm:access' when 1 then 'osm:opening_hours' when 2 then 'osm:fee'
        when 3 then 'osm:opening_hours' when 4 then 'osm:barrier' end access_source
    from fx_places""",
)
def f26(v):
    k = c("place_id") % 6
    tag = F.create_map(
        F.when(k == 0, "access").when(k == 1, "disused").when(k == 2, "fee")
        .when(k == 3, "opening_hours").when(k == 4, "barrier").otherwise("name"),
        F.when(k == 0, "Private").when(k == 3, "Mo-Fr 09:00-17:00").when(k == 4, "gate")
        .otherwise("yes"),
    )
    verdict = ev.access_from_tags(tag)
    return v.places.select("place_id", *[col.alias(name) for name, col in verdict.items()])


_SENTENCES = " ".join(
    "when '%s' then concat(%s)"
    % (
        k,
        ", ".join(
            {"s": "subject", "p": "place"}.get(x, q.text(x))
            for x in t.replace("{s}", "\0s\0").replace("{p}", "\0p\0").split("\0")
            if x
        ),
    )
    for k, t in fa.FACT_SENTENCES.items()
)


@check(
    "f27_facts",
    f"""select fact_id, kind, distance, distance <= 1 routable,
      concat(case relation_kind {_SENTENCES} end, case when year > 0
        then concat(' (', cast(year as varchar), ')') else '' end, '.') sentence
    from (
      select l.link_id fact_id, 'work' kind, l.relation_kind, w.title subject, p.name place,
        cast(null as int) as year, case when l.relation_kind = 'inspiration_for' then 2
          when l.relation_kind in ('author_place', 'artist_place') then 1 else 0 end distance
      from fx_links l join fx_works w on w.work_id = l.work_id join fx_places p on p.place_id = l.place_id
      union all
      select l.fact_id, 'creator', l.relation_kind, k.name, p.name, l.stated_year, 1
      from fx_creator_links l join fx_creators k on k.creator_id = l.creator_id
      join fx_places p on p.place_id = l.place_id)""",
)
def f27(v):
    places = v.places.select("place_id", c("name").alias("place"))
    works = v.works.select("work_id", c("title").alias("subject"))
    creators = v.creators.select("creator_id", c("name").alias("subject"))
    from_works = v.links.join(works, "work_id").join(places, "place_id").select(
        c("link_id").alias("fact_id"), F.lit("work").alias("kind"), "relation_kind",
        "subject", "place", F.lit(None).cast("int").alias("year"),
    )
    from_people = v.creator_links.join(creators, "creator_id").join(places, "place_id").select(
        "fact_id", F.lit("creator").alias("kind"), "relation_kind", "subject", "place",
        c("stated_year").alias("year"),
    )
    none = F.lit(None).cast("string")
    facts = from_works.unionByName(from_people)
    distance = fa.fact_distance(c("relation_kind"), c("kind"))
    return facts.select(
        "fact_id",
        "kind",
        distance.alias("distance"),
        (distance <= 1).alias("routable"),
        fa.fact_sentence(
            c("relation_kind"), c("subject"), c("place"), none, c("year"), none
        ).alias("sentence"),
    )


@check(
    "f28_roles_and_badges",
    """select link_id, role, case geocode_precision when 'building' then 'Building'
        when 'street' then 'Street' when 'point' then 'Exact point' when 'city' then 'City only'
        else 'Unknown precision' end precision_label,
      case when studio then 'studio' when place_class = 'narrative_real' then 'narrative'
        when geocode_precision in ('country', 'city') then 'approximate' else 'exact' end badge
    from (select l.link_id, p.geocode_precision, p.place_class,
        p.place_class = 'studio_interior' studio,
        case when p.place_class = 'fictional' then 'fictional'
          when l.relation_kind = 'narrative_location' or p.place_class = 'narrative_real' then 'narrative'
          when l.relation_kind = 'inspiration_for' then 'inspiration'
          when l.relation_kind = 'replica' then 'replica'
          when l.relation_kind = 'author_place' then 'author'
          when p.place_class = 'studio_interior' then 'studio'
          when p.place_class in ('real_exterior', 'real_interior') then 'on_location'
          else 'unknown' end role
      from fx_links l join fx_places p on p.place_id = l.place_id)""",
)
def f28(v):
    rows = v.links.select("link_id", "place_id", "relation_kind").join(
        v.places.select("place_id", "place_class", "geocode_precision"), "place_id"
    )
    studio = c("place_class") == "studio_interior"
    return rows.select(
        "link_id",
        fa.place_role(c("place_class"), c("relation_kind"), F.lit(False)).alias("role"),
        fa.precision_badge(c("geocode_precision")).alias("precision_label"),
        fa.point_badge(studio, c("place_class"), c("geocode_precision")).alias("badge"),
    )


@check(
    "f29_not_a_place",
    f"""select work_id, noun, coalesce(noun in ({q.quoted(phrases.NOT_A_PLACE_KIND)}), false) something_else,
      kind <> 'series' or work_id % 2 = 0 place_type, kind = 'album' area_type
    from (select work_id, kind, case when kind in ('film', 'album') then kind else 'bridge' end noun
      from fx_works)""",
)
def f29(v):
    noun = F.when(c("kind").isin("film", "album"), c("kind")).otherwise("bridge")
    text = F.concat(F.lit("Old "), noun, F.lit(" in "), "title", F.lit(", a band"))
    type_label = F.when((c("kind") == "series") & (c("work_id") % 2 == 1), " Ship ").otherwise("house")
    area = F.when(c("kind") == "album", "Province of X").otherwise("state capital")
    return v.works.select(
        "work_id",
        phrases.description_head_noun(text).alias("noun"),
        phrases.describes_something_else(text).alias("something_else"),
        ev.is_place_type(type_label).alias("place_type"),
        ev.is_area_type(area).alias("area_type"),
    )


@check(
    "f30_notability",
    """select work_id, source, round(case when votes >= case source when 'tmdb' then 19 else 1000 end
        then score * log10(cast(votes * case source when 'tmdb' then 53 else 1 end as double)) end, 6) notability
    from fx_ratings""",
)
def f30(v):
    return v.ratings.select(
        "work_id",
        "source",
        F.round(ratings.notability(c("source"), c("score"), c("votes")), 6).alias("notability"),
    )


@check(
    "f31_years_in_text",
    """select doc_id, array_to_string(ys, ',') years_found, len(ys) > 0 and (
        len([y for y in ys if abs(y - w) <= 3]) > 0
        or (len(ys) >= 2 and w between list_min(ys) and list_max(ys))) fits
    from (select doc_id, cast(1800 + doc_id % 200 as int) w,
        [cast(y as int) for y in regexp_extract_all(t, '\\b(18\\d{2}|19\\d{2}|20[0-2]\\d)\\b', 1)] ys
      from (select doc_id, case when doc_id % 2 = 0 then concat('Built ',
          cast(1700 + doc_id % 330 as varchar), ', again ', cast(1850 + doc_id % 150 as varchar), '. ', text)
        else text end t from documents))""",
)
def f31(v):
    lead = F.concat(
        F.lit("Built "), (1700 + c("doc_id") % 330).cast("string"), F.lit(", again "),
        (1850 + c("doc_id") % 150).cast("string"), F.lit(". "), "text",
    )
    text = F.when(c("doc_id") % 2 == 0, lead).otherwise(c("text"))
    year = (1800 + c("doc_id") % 200).cast("int")
    rows = v.table("documents").select("doc_id", phrases.years_in(text).alias("ys"), year.alias("w"))
    return rows.select(
        "doc_id",
        F.array_join(F.transform("ys", lambda y: y.cast("string")), ",").alias("years_found"),
        phrases.year_fits(c("w"), c("ys")).alias("fits"),
    )


@check(
    "f33_photo_score",
    """select fix_id, cast(least(d, 360 - d) as double) delta,
      round(accuracy_m + least(least(d, 360 - d), 90), 4) score
    from (select fix_id, accuracy_m, abs(fix_id * 37 % 720 - 90) % 360 d from fx_fixes)""",
)
def f33(v):
    delta = geo.bearing_difference((c("fix_id") * 37 % 720).cast("double"), F.lit(90.0))
    return v.fixes.select(
        "fix_id",
        delta.alias("delta"),
        F.round(c("accuracy_m") + F.least(delta, F.lit(90.0)), 4).alias("score"),
    )


@check(
    "f34_credit_line",
    """select place_id, case k when 4 then null else concat_ws(' · ',
        case k when 0 then 'TMDB' when 1 then 'Wikimedia Commons' when 2 then 'Mapillary' else 'Unsplash' end,
        author, licence) end credit,
      case when k in (0, 3) then true when k = 4 then false
        else author is not null and licence is not null end displayable
    from (select place_id, place_id % 5 k, case when place_id % 3 = 0 then 'A. Author' end author,
      case when place_id % 2 = 0 then 'CC BY 4.0' end licence from fx_places)""",
)
def f34(v):
    k = c("place_id") % 5
    source = (
        F.when(k == 0, "tmdb").when(k == 1, "wikimedia").when(k == 2, "mapillary")
        .when(k == 3, "unsplash").otherwise("elsewhere")
    )
    who = F.when(c("place_id") % 3 == 0, " A. Author ")
    terms = F.when(c("place_id") % 2 == 0, "CC BY 4.0")
    got = ev.credit(source, who, terms)
    return v.places.select("place_id", *[col.alias(n) for n, col in got.items()])


_WHO = " ".join(f"when '{k}' then '{t}'" for k, t in fa.SOURCE_WHO.items())


@check(
    "f36_review_sentence",
    f"""select s.id, concat(case when s.source_sentence is not null
        then concat(s.source_sentence, ' — recorded for ', w.title, ' by ')
        else concat(s.place_name, ' is listed as a location for ', w.title, ' by ') end,
      case s.source_kind {_WHO} else 'an external source' end, '.',
      case when s.status = 'verified'
        then ' We have checked the source. It is still a candidate, not part of our graph.'
        else ' Not yet verified by us.' end,
      case when w.imdb_id is null then concat(' Matched to ', w.title,
        ' by title, not by identifier — check it is the same work.') else '' end) sentence
    from fx_submissions s join fx_works w on w.work_id = s.work_id""",
)
def f36(v):
    rows = v.submissions.join(v.works.select("work_id", "title", "imdb_id"), "work_id")
    return rows.select(
        "id",
        fa.submission_sentence(
            c("source_sentence"), c("place_name"), c("title"), c("source_kind"), c("status"),
            c("imdb_id").isNull(),
        ).alias("sentence"),
    )


@check("f37_claim_sentence")
def f37(v):
    at = F.floor(F.length("text") / 2).cast("int")
    return v.table("documents").select(
        "doc_id", phrases.claim_sentence(c("text"), at).alias("sentence")
    )


@check(
    "f38_canonical_url",
    """select page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/$', '') url,
      regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) host from pages""",
)
def f38(v):
    return v.table("pages").select(
        "page_id",
        phrases.canonical_url(c("url")).alias("url"),
        F.parse_url("url", F.lit("HOST")).alias("host"),
    )


@check(
    "f39_slug",
    f"""select work_id, slug, regexp_extract(slug, '^(?:.*--)?(.*)$', 1) back
    from (select work_id, concat(regexp_replace(substring(replace({q.title_key('title')}, ' ', '-'), 1, 60),
      '-+$', ''), '-', cast(year as varchar), '--', cast(work_id as varchar)) slug from fx_works)""",
)
def f39(v):
    made = fa.work_slug(c("title"), c("year"), c("work_id"))
    return v.works.select(
        "work_id", made.alias("slug"), fa.id_from_slug(made).alias("back")
    )


@check(
    "f40_article_languages",
    """select doc_id, array_to_string(list_distinct_ordered[1:3], ',') languages
    from (select doc_id, [x for x, i in list_concat(e, h, a)
        if list_position(list_concat(e, h, a), x) = i] list_distinct_ordered
      from (select doc_id, a, [x for x in a if x = 'en'] e,
          [x for x in [lang] if x <> 'en' and list_contains(a, x)] h
        from (select doc_id, lang, [x for x in case doc_id % 3 when 0 then ['fr', 'de', 'en', 'es']
          when 1 then ['de', 'it', 'es', 'pl'] else ['ja', 'en'] end] a from documents)))""",
)
def f40(v):
    k = c("doc_id") % 3
    available = (
        F.when(k == 0, F.lit(["fr", "de", "en", "es"]))
        .when(k == 1, F.lit(["de", "it", "es", "pl"]))
        .otherwise(F.lit(["ja", "en"]))
    )
    chosen = fa.article_languages(available, F.array("lang"))
    return v.table("documents").select("doc_id", F.array_join(chosen, ",").alias("languages"))
