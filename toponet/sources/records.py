"""Source records to queue rows, work rows and rating rows.

Each function takes records as a DataFrame and returns queue rows of one common
shape (``SUBMISSION_COLUMNS``). Records that a source's own rules refuse are
filtered out by a predicate, never in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases, ratings as ra
from ..functions.fold import normalize_title, squash

c = F.col

SUBMISSION_COLUMNS = [
    "work_id", "place_name", "area_hint", "source_kind", "source_record_id", "source_title",
    "source_url", "source_sentence", "source_license", "source_attribution", "lat", "lng",
    "geocode_source", "geocode_source_id", "geocode_reason",
]
# What each source says about itself.
SOURCES = {
    "moviemaps": (
        "https://moviemaps.org", "Filming location data from moviemaps.org (no licence stated)"
    ),
    "reelstreets": (
        "https://www.reelstreets.com",
        "Filming location research from reelstreets.com (no licence stated)",
    ),
    "movielocations": (
        "https://movie-locations.com",
        "Filming location research from movie-locations.com (no licence stated)",
    ),
}
PLAQUE_LICENSE = "PDDL 1.0"
PERMIT_LICENSE = "ODbL 1.0"
USABLE_PRECISION = ["building", "street", "area"]
MAX_PLACE = 200


def _text(column: Column) -> Column:
    """Trimmed text, NULL when blank."""
    trimmed = F.trim(column)
    return F.when(trimmed != "", trimmed)


def _submission(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    made = {"source_kind": F.lit(kind), **columns}
    types = {"lat": "double", "lng": "double"}
    return df.select(
        *[
            made.get(name, none).cast(types.get(name, "string")).alias(name)
            if name != "work_id"
            else made["work_id"].alias("work_id")
            for name in SUBMISSION_COLUMNS
        ]
    )


def map_locations(df: DataFrame) -> DataFrame:
    """Mapped locations: need a name, a record id and a valid point."""
    site, credit = SOURCES["moviemaps"]
    name, record = _text(c("name")), _text(c("record_id"))
    fictional = _text(c("as_name"))
    appears = F.when(
        F.lower(fictional) != F.lower(name),
        F.concat(F.lit('Appears as "'), fictional, F.lit('".')),
    )
    scene, note = _text(c("scene")), _text(c("note"))
    sentence = F.concat_ws(" ", appears, scene, F.when(~note.eqNullSafe(scene), note))
    good = (
        name.isNotNull()
        & record.isNotNull()
        & c("lat").between(-90, 90)
        & c("lng").between(-180, 180)
        & c("work_id").isNotNull()
    )
    return _submission(
        df.filter(good),
        "moviemaps",
        work_id=c("work_id"),
        place_name=name,
        area_hint=F.coalesce(_text(c("address")), _text(c("city"))),
        source_record_id=record,
        source_title=name,
        source_url=F.coalesce(_text(c("url")), F.concat(F.lit(f"{site}/locations/"), record)),
        source_sentence=F.when(F.char_length(sentence) >= 10, sentence),
        source_license=F.lit("unstated"),
        source_attribution=F.concat(
            F.lit(credit),
            F.coalesce(F.concat(F.lit("; identified by "), _text(c("credited"))), F.lit("")),
        ),
        lat=c("lat"),
        lng=c("lng"),
        geocode_source=F.lit("moviemaps"),
        geocode_source_id=record,
        geocode_reason=F.lit("contributor"),
    )


def street_captures(df: DataFrame) -> DataFrame:
    """Then-and-now captures: real places of a usable precision."""
    site, credit = SOURCES["reelstreets"]
    place, caption = _text(c("place")), _text(c("caption"))
    record = F.concat_ws(":", c("film_id").cast("string"), c("index").cast("string"))
    point = c("lat").isNotNull() & c("lng").isNotNull()
    also = F.array_compact(c("also_seen_in"))
    good = (
        place.isNotNull()
        & c("work_id").isNotNull()
        & (c("capture_kind") == "real")
        & c("precision").isin(USABLE_PRECISION)
    )
    return _submission(
        df.filter(good),
        "reelstreets",
        work_id=c("work_id"),
        place_name=place,
        area_hint=c("region"),
        source_record_id=record,
        source_title=F.coalesce(_text(c("film_title")), place),
        source_url=F.coalesce(_text(c("url")), F.lit(site)),
        source_sentence=F.when(F.char_length(caption) >= 10, caption),
        source_license=F.lit("unstated"),
        source_attribution=F.when(
            F.size(also) > 0,
            F.concat(F.lit(f"{credit}; also seen in "), F.array_join(also, ", ")),
        ).otherwise(credit),
        lat=F.when(point, c("lat")),
        lng=F.when(point, c("lng")),
        geocode_source=F.when(point, "reelstreets"),
        geocode_source_id=F.when(point, record),
        geocode_reason=F.when(point, "contributor"),
    )


def captioned_locations(df: DataFrame) -> DataFrame:
    """Captioned locations: a caption of ten characters, a place of at most 200."""
    site, credit = SOURCES["movielocations"]
    place, caption, scene = _text(c("place")), _text(c("caption")), _text(c("scene"))
    good = (
        place.isNotNull()
        & (F.char_length(place) <= MAX_PLACE)
        & (F.char_length(caption) >= 10)
        & c("work_id").isNotNull()
    )
    return _submission(
        df.filter(good),
        "movielocations",
        work_id=c("work_id"),
        place_name=place,
        area_hint=c("region"),
        source_record_id=F.concat_ws(":", c("film_id").cast("string"), c("index").cast("string")),
        source_title=F.coalesce(_text(c("film_title")), place),
        source_url=F.coalesce(_text(c("url")), F.lit(site)),
        source_sentence=caption,
        source_license=F.lit("unstated"),
        source_attribution=F.concat(
            F.lit(credit), F.coalesce(F.concat(F.lit("; scene: "), scene), F.lit(""))
        ),
    )


def plaques(df: DataFrame) -> DataFrame:
    """Plaque rows: a point without a zero, an id, a named venue."""
    lat = F.trim("latitude").try_cast("double")
    lng = F.trim("longitude").try_cast("double")
    parts = F.transform(F.split(F.coalesce("address", F.lit("")), ","), lambda x: F.trim(x))
    place = F.coalesce(_text(F.get(parts, F.lit(0))), _text(c("title")))
    rest = F.filter(
        F.concat(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array("area")),
        lambda x: F.coalesce(x != "", F.lit(False)),
    )
    record = _text(c("id").cast("string"))
    names = F.coalesce(
        F.from_json("organisations", "array<string>"), F.array(_text(c("organisations")))
    )
    names = F.filter(names, lambda n: F.coalesce(n != "", F.lit(False)))
    erected = F.when(
        F.size(names) > 0,
        F.concat(
            F.lit("Plaque erected by "),
            F.array_join(names, ", "),
            F.coalesce(F.concat(F.lit(" ("), _text(c("erected")), F.lit(")")), F.lit("")),
        ),
    )
    good = (
        (lat != 0)
        & (lng != 0)
        & record.isNotNull()
        & (place != "?")
        & (F.char_length(place) >= 3)
    )
    return _submission(
        df.filter(good),
        "open_plaques",
        work_id=c("work_id"),
        place_name=place,
        area_hint=F.when(F.size(rest) > 0, F.array_join(rest, ", ")),
        source_record_id=record,
        source_title=F.concat(F.lit("Open Plaques #"), record),
        source_url=F.concat(F.lit("https://openplaques.org/plaques/"), record),
        source_sentence=F.coalesce(
            _text(c("claim")), F.substring(squash(c("inscription")), 1, 400)
        ),
        source_license=F.lit(PLAQUE_LICENSE),
        source_attribution=erected,
        lat=lat,
        lng=lng,
        geocode_source=F.lit("open_plaques"),
        geocode_source_id=record,
        geocode_reason=F.concat(F.lit('Inscription states: "'), _text(c("claim")), F.lit('"')),
    )


def permits(df: DataFrame, city: str = "paris", label: str = "Paris") -> DataFrame:
    """Permit records: id, address, point, and a title that matches the work's."""
    record, address = _text(c("record_id").cast("string")), _text(c("address"))
    good = (
        record.isNotNull()
        & address.isNotNull()
        & c("lat").isNotNull()
        & c("lng").isNotNull()
        & (F.char_length(F.trim("work_title")) >= 5)
        & phrases.title_matches(c("title"), c("work_title"))
    )
    return _submission(
        df.filter(good),
        "permit_record",
        work_id=c("work_id"),
        place_name=address,
        area_hint=F.coalesce(_text(c("area")), F.lit(label)),
        source_record_id=F.concat(F.lit(f"{city}:"), record),
        source_title=F.concat(F.lit(f"{label} — "), F.trim("title")),
        source_license=F.lit(PERMIT_LICENSE),
        lat=c("lat"),
        lng=c("lng"),
        geocode_source=F.lit(f"opendata_{city}"),
        geocode_source_id=record,
        geocode_reason=F.lit("issuing_authority"),
    )


def works_from_records(df: DataFrame, need_id: bool) -> DataFrame:
    """Work rows of a source: a usable title, and an id where the source has ids."""
    title = _text(c("title"))
    norm = normalize_title(title)
    imdb = F.when(F.trim("imdb_id").rlike(r"^tt\d{7,}$"), F.trim("imdb_id"))
    rows = df.filter(title.isNotNull() & (norm != ""))
    if need_id:
        rows = rows.filter(imdb.isNotNull())
    return rows.select(
        imdb.alias("imdb_id"),
        F.when(c("kind") == "series", "series").otherwise("film").alias("kind"),
        title.alias("title"),
        norm.alias("title_norm"),
        c("year"),
    )


def new_works(records: DataFrame, works: DataFrame) -> DataFrame:
    """Work rows whose id the graph does not hold yet."""
    held = works.filter(c("imdb_id").isNotNull()).select("imdb_id").distinct()
    return records.join(held, "imdb_id", "left_anti")


def bulk_ratings(lines: DataFrame) -> DataFrame:
    """Rows of the ratings dump (id, average on ten, votes), scores on 0..100.

    Malformed ids, scores outside (0, 10] and fewer than 100 votes are dropped.
    """
    score, votes = F.trim("averageRating").try_cast("double"), F.trim("numVotes").try_cast("long")
    good = c("tconst").rlike(r"^tt\d{7,10}$") & (score > 0) & (score <= 10) & (votes >= 100)
    return lines.filter(good).select(
        c("tconst").alias("imdb_id"), F.round(score * 10, 2).alias("score"), votes.alias("votes")
    )


def ratings_for_works(dump: DataFrame, works: DataFrame) -> DataFrame:
    """Dump rows of held works; Spark broadcasts the works when they are few."""
    return dump.join(works.filter(c("imdb_id").isNotNull()).select("work_id", "imdb_id"), "imdb_id")


def provider_ratings(payloads: DataFrame) -> DataFrame:
    """One row per known source of a provider answer; unreadable scores dropped.

    ``payloads``: work_id, response, votes (text), ratings array of (source, value).
    """
    from ..functions.evidence import literal_map

    sources = literal_map(ra.PROVIDER_SOURCES)
    rows = payloads.filter(c("response") == "True").select(
        "work_id", "votes", F.posexplode("ratings").alias("position", "r")
    )
    rows = rows.select(
        "work_id", "votes", "position",
        F.try_element_at(sources, F.lower("r.source")).alias("source"),
        F.trim("r.value").alias("display"),
    ).withColumn("score", ra.normalize_score(c("display")))
    rows = rows.filter(c("source").isNotNull() & c("score").isNotNull())
    first = rows.groupBy("work_id", "source").agg(
        F.min(F.struct("position", "score", "display", "votes")).alias("_r")
    )
    votes = F.regexp_replace("_r.votes", r"[,\s]", "").try_cast("long")
    return first.select(
        "work_id", "source", c("_r.score").alias("score"), c("_r.display").alias("display"),
        F.when((c("source") == "imdb") & (votes >= 0), votes).alias("votes"),
    )


# --- personal libraries -----------------------------------------------------------
# Accepted header names of a library export, best first.
LIBRARY_HEADERS = {
    "title": ["name", "title", "original title"],
    "imdb_id": ["const", "imdb id"],
    "rating": ["rating", "your rating"],
    "year": ["year", "release year"],
    "watched": ["watched date", "date rated", "date"],
    "url": ["letterboxd uri", "url"],
}


def library_rows(raw: DataFrame, source: str) -> DataFrame:
    """Library items of a raw export whose columns carry the file's own headers."""
    names = {x.replace("﻿", "").strip().lower(): x for x in raw.columns}

    def first(field: str) -> Column:
        held = [_text(c(f"`{names[h]}`")) for h in LIBRARY_HEADERS[field] if h in names]
        return F.coalesce(*held) if held else F.lit(None).cast("string")

    title, imdb = first("title"), first("imdb_id")
    year = first("year").try_cast("int")
    key = F.concat(
        F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"),
        F.lit(":"),
        F.coalesce(year.cast("string"), F.lit("")),
    )
    other = [x for x in ("user_id", "item_id") if x in raw.columns]
    return raw.filter(title.isNotNull()).select(
        *other,
        F.coalesce(imdb, F.concat(F.lit(f"{source}:"), key)).alias("id"),
        title.alias("title"),
        year.alias("year"),
        ra.to_ten_point(first("rating").try_cast("double"), F.lit(source)).alias("rating"),
        first("watched").alias("watched"),
        first("url").alias("url"),
        F.when(imdb.rlike(r"^tt\d+$"), imdb).alias("imdb_id"),
        F.lit(source).alias("source"),
    )
