"""Sources, parsers and text containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases
from ..operators import extraction, mapview, textmatch
from ..schemas import HARVEST_LOCATION, RATINGS_DUMP
from ..sources import readers, records, wiki
from . import sqltext as q
from .registry import check

c = F.col


@check(
    "s02_bulk_ratings",
    """select w.work_id, w.imdb_id, round(floor(r.score) / 10 * 10, 2) score, r.votes from fx_ratings r join fx_works w using (work_id)
    where w.imdb_id is not null and r.source = 'imdb' and r.votes >= 100 and r.work_id % 9 <> 0""",
)
def s02(v):
    rows = v.ratings.filter(c("source") == "imdb").join(v.works.select("work_id", "imdb_id"), "work_id")
    tenth = F.floor("score").cast("int")
    text = F.concat((tenth / 10).cast("int").cast("string"), F.lit("."), (tenth % 10).cast("string"))
    line = F.concat_ws(
        "\t",
        F.coalesce("imdb_id", F.lit("\\N")),
        F.when(c("work_id") % 9 == 0, "11.5").otherwise(text),
        c("votes").cast("string"),
    )
    parsed = rows.select(
        F.from_csv(line, RATINGS_DUMP.simpleString()[7:-1].replace(":", " ").replace(",", ", "), {"sep": "\t", "nullValue": "\\N"}).alias("r")
    ).select("r.*")
    dump = records.bulk_ratings(parsed)
    return records.ratings_for_works(dump, v.works).select("work_id", "imdb_id", "score", "votes")


@check(
    "s03_harvest_appearances",
    """select place_id location_id, id movie_id, case when source_sentence is not null then source_sentence end scene,
      id % 3 frames from fx_submissions where place_id is not null""",
)
def s03(v):
    frame = F.struct(F.lit("p").alias("page"), F.lit("t").alias("thumb"), F.lit("f").alias("full"))
    rows = v.submissions.filter(c("place_id").isNotNull())
    appearance = F.array(
        F.struct(
            c("id").cast("string").alias("movie_id"), c("source_sentence").alias("scene"),
            F.array_repeat(frame, (c("id") % 3).cast("int")).alias("frames"),
        )
    )
    line = F.to_json(
        F.struct(
            c("place_id").cast("string").alias("id"), c("place_name").alias("name"), "lat", "lng",
            appearance.alias("appearances"),
        )
    )
    parsed = rows.select(F.from_json(line, HARVEST_LOCATION).alias("r")).select("r.*")
    got = readers.appearances(parsed)
    return got.select(
        c("location_id").cast("long").alias("location_id"), c("movie_id").cast("long").alias("movie_id"),
        "scene", c("frames").cast("long").alias("frames"),
    )


@check(
    "s04_library_import",
    """select user_id, truth_work_id item_id, coalesce(imdb_id, concat('imdb:', regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), ':', coalesce(cast(year as varchar), ''))) id,
      title, year, rating, imdb_id from fx_library""",
)
def s04(v):
    raw = v.library.select(
        "user_id", c("truth_work_id").alias("item_id"), c("imdb_id").alias("﻿Const"),
        c("title").alias("Title"), c("rating").cast("string").alias("Your Rating"),
        c("year").cast("string").alias("Year"),
    )
    return records.library_rows(raw, "imdb").select(
        "user_id", "item_id", "id", "title", "year", "rating", "imdb_id"
    )


@check(
    "s05_archive_import",
    """with r as (select user_id, truth_work_id item, concat(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), ':', coalesce(cast(year as varchar), '')) k, title,
      case when truth_work_id % 2 = 0 then floor(rating / 2 * 10 / 5 * 10 + 0.5) / 10 end r from fx_library)
    select user_id, k as key, arg_max(title, item) title, arg_max(r, item) filter (r is not null) rating from r group by 1, 2""",
)
def s05(v):
    from ..operators import library

    def part(rated):
        rows = v.library if rated is None else v.library.filter(rated)
        raw = rows.select(
            "user_id", c("truth_work_id").alias("item_id"), c("title").alias("Name"),
            c("year").cast("string").alias("Year"),
            *([] if rated is None else [(c("rating") / 2).cast("string").alias("Rating")]),
        )
        return records.library_rows(raw, "letterboxd").select(
            "user_id", "item_id", "title", "year", "imdb_id", "rating", "source"
        )

    merged = library.merge_libraries(part(None), part(c("truth_work_id") % 2 == 0))
    return merged.select("user_id", "key", "title", "rating")


def list_words(v):
    """Anchor texts of each page's list items, in order."""
    words = F.regexp_extract_all("html", F.lit(r"<li><a href=\"[^\"]*\">([^<]*)</a></li>"), F.lit(1))
    return v.table("pages").select("page_id", "url", words.alias("words"))


_ITEMS = """(select page_id, w, i from (select page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) w,
  generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1), 1) - 1 i from pages))"""


@check(
    "s06_feed_items",
    f"""select page_id, trim(w) title, cast(1950 + i % 60 as int) as year, cast(i + 1 as varchar) tmdb_id, cast(i % 5 as double) rating
    from {_ITEMS} where i % 4 <> 3 and trim(w) <> ''""",
)
def s06(v):
    def block(w, i):
        number = F.when(i % 4 != 3, (i + 1).cast("string")).otherwise("")
        return F.concat(
            F.lit("<item><letterboxd:filmTitle><![CDATA["), w, F.lit("]]></letterboxd:filmTitle><tmdb:movieId>"),
            number, F.lit("</tmdb:movieId><letterboxd:filmYear>"), (1950 + i % 60).cast("string"),
            F.lit("</letterboxd:filmYear><letterboxd:memberRating>"), (i % 5).cast("string"),
            F.lit("</letterboxd:memberRating></item>"),
        )

    feeds = list_words(v).select("page_id", F.array_join(F.transform("words", block), "\n").alias("xml"))
    return wiki.feed_items(feeds, "page_id").drop("watched")


@check(
    "s07_plaques",
    """select work_id, trim(split_part(place_name, ',', 1)) place_name, case when contains(place_name, ',') then concat(trim(substring(place_name, strpos(place_name, ',') + 1)), ', Area')
        else 'Area' end area_hint, cast(id as varchar) source_record_id, coalesce(source_sentence, 'They lived here.') source_sentence, round(lat, 6) lat, round(lng, 6) lng
    from fx_submissions where lat is not null and lat <> 0 and lng <> 0 and source_kind = 'open_plaques'""",
)
def s07(v):
    rows = v.submissions.filter(c("source_kind") == "open_plaques").select(
        "work_id", "id", c("place_name").alias("address"), F.lit("Area").alias("area"),
        F.lit("Plaque").alias("title"), c("lat").cast("string").alias("latitude"),
        c("lng").cast("string").alias("longitude"), F.lit('["City"]').alias("organisations"),
        F.lit("1990").alias("erected"), c("source_sentence").alias("claim"),
        F.lit("They  lived here.").alias("inscription"),
    )
    got = records.plaques(rows)
    return got.select(
        "work_id", "place_name", "area_hint", "source_record_id", "source_sentence",
        F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"),
    )


@check(
    "s08_permits",
    """select s.work_id, concat('paris:', cast(s.id as varchar)) source_record_id, s.place_name, 'Paris' area_hint from fx_submissions s
    where s.lat is not null and s.id % 4 <> 0""",
)
def s08(v):
    rows = v.submissions.join(v.works.select("work_id", "title"), "work_id").select(
        "work_id", c("id").alias("record_id"), c("place_name").alias("address"), "lat", "lng",
        F.lit(None).cast("string").alias("area"), c("title").alias("work_title"),
        F.when(c("id") % 4 == 0, "Another film").otherwise(F.concat("title", F.lit(" Saison 2"))).alias("title"),
    )
    return records.permits(rows).select("work_id", "source_record_id", "place_name", "area_hint")


@check(
    "s09_three_sources",
    """select work_id, 'moviemaps' source_kind, place_name, cast(id as varchar) source_record_id, source_sentence, lat from fx_submissions where source_kind = 'moviemaps' and lat is not null
    union all select work_id, 'reelstreets', place_name, concat(cast(work_id as varchar), ':', cast(id as varchar)), source_sentence, lat from fx_submissions
      where source_kind = 'reelstreets' and id % 3 <> 0
    union all select work_id, 'movielocations', place_name, concat(cast(work_id as varchar), ':', cast(id as varchar)), source_sentence, null from fx_submissions
      where source_kind = 'movielocations' and source_sentence is not null""",
)
def s09(v):
    rows = v.submissions
    none = F.lit(None).cast("string")
    maps = records.map_locations(
        rows.filter(c("source_kind") == "moviemaps").select(
            "work_id", c("place_name").alias("name"), c("id").cast("string").alias("record_id"),
            "lat", "lng", none.alias("as_name"), c("source_sentence").alias("scene"),
            c("source_sentence").alias("note"), none.alias("address"), none.alias("city"),
            c("source_url").alias("url"), none.alias("credited"),
        )
    )
    streets = records.street_captures(
        rows.filter(c("source_kind") == "reelstreets").select(
            "work_id", c("place_name").alias("place"), c("source_sentence").alias("caption"),
            c("work_id").alias("film_id"), c("id").alias("index"), "lat", "lng",
            F.array(F.lit("Other"), none).alias("also_seen_in"), F.lit("real").alias("capture_kind"),
            F.when(c("id") % 3 == 0, "city").otherwise("street").alias("precision"),
            none.alias("region"), none.alias("film_title"), c("source_url").alias("url"),
        )
    )
    captions = records.captioned_locations(
        rows.filter(c("source_kind") == "movielocations").select(
            "work_id", c("place_name").alias("place"), c("source_sentence").alias("caption"),
            none.alias("scene"), c("work_id").alias("film_id"), c("id").alias("index"),
            none.alias("region"), none.alias("film_title"), c("source_url").alias("url"),
        )
    )
    return maps.unionByName(streets).unionByName(captions).select(
        "work_id", "source_kind", "place_name", "source_record_id", "source_sentence", "lat"
    )


@check("s10_wiki_tables")
def s10(v):
    def row(w, i):
        span = F.when(i % 5 == 0, 'rowspan="2" | ').otherwise("")
        return F.concat(F.lit("|-\n| "), span, w, F.when(i % 5 == 1, "").otherwise(F.concat(F.lit(" || Scene "), w)))

    head = "== Filming locations ==\n{| class=\"wikitable\"\n! Real location !! Scene\n"
    text = F.concat(
        F.lit(head), F.array_join(F.transform("words", row), "\n"), F.lit("\n|}\n== Trivia ==\n")
    )
    return wiki.location_tables(list_words(v).select("page_id", text.alias("wikitext")))


_LISTED = "concat('== Filming ==' || chr(10) || '* ', regexp_replace(text, '[.\\n]+\\s*', chr(10) || '* ', 'g'), chr(10) || '== Notes ==' || chr(10) || '* skipped place')"
_NAMEABLE = f"""regexp_matches(x, '(?i)[a-z]') and not regexp_matches(x, {q.text(phrases.NOT_A_NAME)}) and not regexp_matches(x, {q.text(phrases.NAME_PREFIX_REFUSED[0])})
  and not regexp_matches(x, {q.text(phrases.NAME_PREFIX_REFUSED[1])}) and not regexp_matches(x, {q.text(phrases.NAME_PREFIX_REFUSED[2])})
  and not starts_with(x, '(') and ({q.words('x')}) <= 12 and length(x) <= 120 and not regexp_matches(x, '\\b[A-Za-z]{{4,}}[.!?]\\s+[A-Z]')
  and not regexp_matches(x, {q.text(phrases.PROSE_VERB)}) and not regexp_matches(x, {q.text(phrases.PRONOUN_START)}) and not regexp_matches(x, {q.text(phrases.DOUBLE_LOCATIVE)})
  and not regexp_matches(x, '(?i)^(https?://|\\[https?:)') and not regexp_matches(x, '(?i)\\bon (imdb|youtube|facebook|twitter)\\b')"""
_ITEM = """regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\\*\\s*', ''),
  '\\[\\[([^\\]|]+)\\|([^\\]]+)\\]\\]', '\\2', 'g'), '\\[\\[([^\\]]+)\\]\\]', '\\1', 'g'), '<[^>]+>', ' ', 'g'), '''{2,}', '', 'g'), '\\s+', ' ', 'g')), '^[ ;,.*–—-]+|[ ;,.*–—-]+$', '', 'g')"""


@check(
    "s11_wiki_lists",
    f"""with lines as (select doc_id, unnest(string_split(split_part({_LISTED}, chr(10) || '== Notes', 1), chr(10))) line from documents),
    items as (select doc_id, {_ITEM} x from lines where regexp_matches(line, '^\\*[^*]') or line = '*')
    select doc_id, x as real from items where {_NAMEABLE}""",
)
def s11(v):
    listed = F.concat(
        F.lit("== Filming ==\n* "), F.regexp_replace("text", r"[.\n]+\s*", "\n* "),
        F.lit("\n== Notes ==\n* skipped place"),
    )
    texts = v.table("documents").select("doc_id", listed.alias("text"))
    return wiki.list_items(texts, "doc_id")


@check(
    "s12_works_from_records",
    f"""select imdb_id, case kind when 'series' then 'series' else 'film' end kind, title, {q.title_key('title')} title_norm from fx_works
    where imdb_id is not null and work_id % 3 = 0""",
)
def s12(v):
    rows = records.works_from_records(v.works, need_id=True)
    held = v.works.filter(c("work_id") % 3 != 0)
    return records.new_works(rows, held).select("imdb_id", "kind", "title", "title_norm")


@check("s17_page_payloads", f"select page_id, cast(i as varchar) location_id, w as name, i / 2.0 lat from {_ITEMS}")
def s17(v):
    def entry(w, i):
        return F.struct(
            i.cast("string").alias("lid"), w.alias("lname"), (i / 2.0).alias("llat"), (i / 4.0).alias("llng")
        )

    payload = F.to_json(F.transform("words", entry))
    html = F.concat(
        F.lit("<script>var a = (1);</script><script>moviemaps.loadPublic('MovieDetail', \"1\", "),
        payload, F.lit(");</script>"),
    )
    pages = list_words(v).select("page_id", html.alias("html"))
    return wiki.page_payloads(pages).select("page_id", "location_id", "name", "lat")


@check(
    "s18_caption_parts",
    """with t as (select doc_id, unnest(string_split(text, '.')) x, unnest(range(0, len(string_split(text, '.')))) i from documents),
    d as (select doc_id, i // 2 pair, i % 2 side, regexp_replace(regexp_replace(replace(x, ':', ' '), '\\s+', ' ', 'g'), '^[ :–—]+|[ :–—]+$', '', 'g') x from t),
    e as (select doc_id, pair, coalesce(max(x) filter (side = 0), '') a, coalesce(max(x) filter (side = 1), '') b from d group by 1, 2)
    select doc_id, pair, case when a <> '' and b <> '' then a end scene, case when b <> '' then b when a <> '' then a end place from e""",
)
def s18(v):
    """Captions of every two parts of a text."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / 2).cast("int")),
        lambda k: F.struct(F.get("parts", 2 * k).alias("a"), F.coalesce(F.get("parts", 2 * k + 1), F.lit("")).alias("b")),
    )
    rows = v.table("documents").select("doc_id", F.split("text", r"\.", -1).alias("parts")).select(
        "doc_id", F.posexplode(pairs).alias("pair", "x")
    )
    k = c("doc_id") % 3
    mark = F.when(k == 0, " film location: ").when(k == 1, " filming location: ").otherwise(" location: ")
    said = [F.replace(c(f"x.{side}"), F.lit(":"), F.lit(" ")) for side in "ab"]
    caption = F.concat(F.lit("Some Film"), mark, said[0], F.lit(": "), said[1])
    got = wiki.caption_parts(caption)
    return rows.select("doc_id", c("pair").cast("long").alias("pair"), *[col.alias(n) for n, col in got.items()])


@check(
    "s19_provider_ratings",
    """select work_id, source, score, votes from (
      select work_id, 'imdb' source, floor(floor(score) / 10 * 10 * 100 + 0.5) / 100 score, votes from fx_ratings where source = 'imdb' and work_id % 7 <> 0
      union all select work_id, 'metacritic', floor(score), null from fx_ratings where source = 'imdb' and work_id % 7 <> 0)""",
)
def s19(v):
    tenth = F.floor("score").cast("int")
    shown = F.concat((tenth / 10).cast("int").cast("string"), F.lit("."), (tenth % 10).cast("string"), F.lit("/10"))

    def rating(name, value):
        return F.struct(F.lit(name).alias("source"), value.alias("value"))

    payloads = v.ratings.filter(c("source") == "imdb").select(
        "work_id", F.when(c("work_id") % 7 == 0, "False").otherwise("True").alias("response"),
        F.format_number("votes", 0).alias("votes"),
        F.array(
            rating("Internet Movie Database", shown),
            rating("Rotten Tomatoes", F.lit("n/a")),
            rating("Metacritic", F.concat(tenth.cast("string"), F.lit("/100"))),
            rating("Metacritic", F.lit("1/100")),
        ).alias("ratings"),
    )
    return records.provider_ratings(payloads).select("work_id", "source", "score", "votes")


@check(
    "p13_names_in_lists",
    f"""select doc_id, position, {_NAMEABLE} named from (select doc_id, unnest(range(0, len(string_split(text, '.')))) as position,
      trim(regexp_replace(unnest(string_split(text, '.')), '\\s+', ' ', 'g')) x from documents)""",
)
def p13(v):
    """Every sentence as if it were an item of a list."""
    items = v.table("documents").select("doc_id", F.posexplode(F.split("text", r"\.", -1)).alias("position", "x"))
    name = F.trim(F.regexp_replace("x", r"\s+", " "))
    return items.select(
        "doc_id", c("position").cast("long").alias("position"), phrases.names_a_place_in_list(name).alias("named")
    )


@check(
    "p14_licence_gate",
    """select doc_id, doc_id % 4 in (0, 3) allowed from documents""",
)
def p14(v):
    k = c("doc_id") % 4
    text = (
        F.when(k == 0, "CC BY-SA 3.0").when(k == 1, "CC BY-NC 4.0").when(k == 2, F.concat(F.lit("Creative Commons no-derivs (noderivs) "), "lang"))
    )
    url = F.when(k == 3, "https://creativecommons.org/licenses/by/4.0/")
    return v.table("documents").select(
        "doc_id", phrases.licence_allows(text, url).alias("allowed")
    )


def inscriptions(v):
    """Documents with a sentence about a work put in front, some without a claim word."""
    n = v.works.agg(F.count(F.lit(1)).alias("n")).scalar()
    d = v.table("documents").withColumn("work_id", c("doc_id") % n)
    said = F.when(c("doc_id") % 3 == 0, "Nothing. ").otherwise("It was filmed and wrote as ")
    lead = F.concat(said, "title", F.when(c("doc_id") % 5 == 0, "s. ").otherwise(". "))
    return d.join(v.works.select("work_id", "title"), "work_id").select(
        "doc_id", F.concat(lead, "text").alias("text")
    )


_CLAIMS = "case w.kind when 'book' then regexp_matches(ctx, {b}) when 'series' then regexp_matches(ctx, {s}) else regexp_matches(ctx, {f}) end".format(
    b=q.text(phrases.CLAIM_WORDS["book"]), s=q.text(phrases.CLAIM_WORDS["series"]), f=q.text(phrases.CLAIM_WORDS["film"])
)


@check(
    "j14_titles_in_texts",
    f"""with texts as (select d.doc_id, concat(case when doc_id % 3 = 0 then 'Nothing. ' else 'It was filmed and wrote as ' end, w.title,
        case when doc_id % 5 = 0 then 's. ' else '. ' end, d.text) t from documents d join fx_works w on w.work_id = d.doc_id % (select count(*) from fx_works)),
    hit as (select t.doc_id, w.work_id, w.kind, w.title, t.t, length(regexp_extract(t.t, concat('(?s)^(?:.*?[^A-Za-z0-9])??(', regexp_escape(w.title), ')(?:[^A-Za-z0-9]|$)'), 0)) e
      from texts t join fx_works w on contains(t.t, w.title) where len(string_split(w.title, ' ')) >= 2 and length(w.title) >= 8),
    placed as (select *, case when e > 0 then strpos(t, title) end a from hit where e > 0),
    ctx as (select doc_id, work_id, kind, a, substring(t, greatest(a - 60, 1), a + length(title) + 60 - greatest(a - 60, 1)) ctx from placed)
    select doc_id, min(work_id) work_id from ctx w where {_CLAIMS} group by 1""",
)
def j14(v):
    return textmatch.title_claims(inscriptions(v), v.works, "doc_id").select("doc_id", "work_id")


_FORM = "lower(trim(regexp_replace(coalesce(replace(translate(text, '‘’ʼ′“”″–—−', '''''''''\"\"\"---'), '…', '...'), ''), {b}, ' ', 'g')))".format(
    b=q.text(q.BLANKS)
)


@check(
    "j15_quotes_in_sources",
    f"""with b as (select item_id, {_FORM} f from benchmark), d as (select doc_id, {_FORM} f from documents)
    select item_id, doc_id, cast(strpos(d.f, b.f) - 1 as int) as "at" from b join d on contains(d.f, b.f) where length(b.f) >= 10""",
)
def j15(v):
    return textmatch.quotes_in_texts(v.table("benchmark"), v.table("documents"), "item_id", "doc_id")


@check(
    "g11_plot_order",
    f"""with b as (select item_id, {_FORM.replace('(text,', '(t,')} f, len(string_split(trim(t), ' ')) n from (select concat(item_id, ':', generate_subscripts(s, 1) - 1) item_id, unnest(s) t
      from (select item_id, string_split_regex(regexp_replace(text, '\\s+', ' ', 'g'), '[.!?] ') s from benchmark))),
    d as (select doc_id, {_FORM} f from documents)
    select doc_id, item_id location, cast(strpos(d.f, b.f) - 1 as int) as "at", cast(row_number() over (partition by doc_id order by strpos(d.f, b.f), item_id) as int) sequence_index
    from b join d on contains(d.f, b.f) where length(b.f) >= 10 and n between 6 and 20""",
)
def g11(v):
    sentences = F.split(F.regexp_replace("text", r"\s+", " "), "[.!?] ")
    quotes = v.table("benchmark").select("item_id", F.posexplode(sentences).alias("at", "text")).select(
        F.concat_ws(":", "item_id", "at").alias("location"), "text"
    )
    return extraction.plot_scenes(quotes, v.table("documents"), "doc_id")


@check("g12_extraction_gate")
def g12(v):
    """Every clause of every sentence offered as a place's name."""
    d = v.table("documents")
    clauses = F.flatten(F.transform(
        F.split("text", r"(?<=[.!?])\s+"),
        lambda s: F.transform(F.split(s, r",\s+"), lambda x: F.struct(s.alias("s"), x.alias("name"))),
    ))
    rows = d.select(c("doc_id").alias("article_id"), F.posexplode(clauses).alias("position", "x"))
    said = F.regexp_replace(F.trim("x.name"), r"[.!?]+$", "")
    name = F.when(c("position") % 3 == 0, F.concat(said, F.lit(", Old Town"))).otherwise(said)
    role = F.when(c("position") % 7 == 6, "other").when(c("position") % 2 == 0, "filming").otherwise("author")
    return extraction.accept_extractions(
        rows.select(
            "article_id", "position", name.alias("place_name"), c("x.s").alias("source_sentence"),
            role.alias("role"),
        ),
        d.select(c("doc_id").alias("article_id"), c("text").alias("prose")),
    )


@check("t11_section_choice")
def t11(v):
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    levels = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])[^>]*>.*?</h[1-6]>"), F.lit(1))
    rows = v.table("pages").select(
        "page_id", F.posexplode(F.arrays_zip(found.alias("line"), levels.alias("level"))).alias("position", "s")
    )
    rows = rows.select(
        "page_id", "position", F.regexp_replace("s.line", "<[^>]+>", "").alias("line"),
        c("s.level").cast("int").alias("level"),
    )
    return wiki.choose_section(rows, "page_id", wiki.FILM_SECTIONS["en"] + ["the", "de", "er", "e"])


@check(
    "t14_image_choice",
    f"""with i as (select page_id, concat('/', w) path, i as position, i * 37 % 11 votes, i % 3 average, i % 5 width from {_ITEMS}),
    u as (select * from (select *, row_number() over (partition by page_id, path order by position) n from i where regexp_matches(path, '^/[A-Za-z0-9._-]+$')) where n = 1)
    select page_id, path, votes from (select *, row_number() over (partition by page_id order by votes desc, average desc, width desc, position) r from u) where r <= 8""",
)
def t14(v):
    rows = list_words(v).select("page_id", F.posexplode("words").alias("position", "w"))
    images = rows.select(
        "page_id", "position", F.concat(F.lit("/"), "w").alias("path"),
        (c("position") * 37 % 11).cast("long").alias("votes"), (c("position") % 3).alias("average"),
        (c("position") % 5).alias("width"),
    )
    return extraction.best_images(images, "page_id").select("page_id", "path", "votes")


@check(
    "t10_best_photo",
    """with p as (select user_id, fix_id photo_id, case fix_id % 4 when 0 then 'mapillary' when 1 then 'wikimedia' when 2 then 'streetview' else 'flickr' end source,
      case when fix_id % 3 = 0 then 'A' end author, case when fix_id % 5 = 0 then 'CC BY' end licence, accuracy_m m, fix_id * 37 % 360 angle from fx_fixes),
    s as (select *, case source when 'mapillary' then 1 when 'wikimedia' then 2 else 3 end k, m + least(least(abs(angle - 90) % 360, 360 - abs(angle - 90) % 360), 90) score from p
      where source <> 'flickr' and (source = 'streetview' or (author is not null and licence is not null)))
    select user_id, arg_min(photo_id, (k, score, photo_id)) photo_id, arg_min(source, (k, score, photo_id)) source from s group by 1""",
)
def t10(v):
    k = c("fix_id") % 4
    photos = v.fixes.select(
        "user_id", c("fix_id").alias("photo_id"),
        F.when(k == 0, "mapillary").when(k == 1, "wikimedia").when(k == 2, "streetview").otherwise("flickr").alias("source"),
        F.when(c("fix_id") % 3 == 0, "A").alias("author"), F.when(c("fix_id") % 5 == 0, "CC BY").alias("licence"),
        c("accuracy_m").alias("distance_m"), (c("fix_id") * 37 % 360).cast("double").alias("angle"),
    )
    return extraction.best_photo(photos, "user_id", heading=90.0).select("user_id", "photo_id", "source")


@check(
    "w09_best_described",
    f"""select lat, lng, work_id, arg_min(id, (-coalesce(length(note), 0), id)) id, arg_min(coalesce(note, '-'), (-coalesce(length(note), 0), id)) note from (
      select *, regexp_replace(source_sentence, '\\.$', '') note from ({q.VISIBLE_QUEUE})) group by 1, 2, 3""",
)
def w09(v):
    rows = extraction.best_described(mapview.visible_queue(v.submissions))
    return rows.withColumn("note", F.coalesce("note", F.lit("-")))
