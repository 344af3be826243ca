"""Facts: distance to the work, sentences, roles, badges, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import slug

# Sentence of a fact by relation ({s} subject, {p} place).
FACT_SENTENCES = {
    "filming_location": "{s} was filmed at {p}",
    "narrative_location": "{s} is set at {p}",
    "studio_of": "{s} was made at {p}",
    "recorded_at": "{s} was recorded at {p}",
    "replica": "{p} was built for visitors; {s} was not filmed there",
    "inspiration_for": "{p} is where an idea in {s} came from",
    "author_place": "{p} is connected with the author of {s}",
    "artist_place": "{p} is connected with the artist behind {s}",
    "lived_here": "{s} lived at {p}",
    "worked_here": "{s} worked at {p}",
    "wrote_here": "{s} wrote at {p}",
    "died_here": "{s} died at {p}",
    "buried_here": "{s} is buried at {p}",
    "commemorated_here": "{s} is commemorated at {p}",
}
CREATOR_RELATIONS = (
    "lived_here worked_here wrote_here died_here buried_here commemorated_here author_place "
    "artist_place"
).split()
# Label of a place's role in a work.
ROLE_LABELS = {
    "fictional": "Fictional place",
    "narrative": "Set here in the story",
    "inspiration": "The idea came from here",
    "replica": "Built for visitors, not filmed here",
    "author": "Where the author worked",
    "studio": "Filmed at a studio",
    "on_location": "Filmed on location",
    "unknown": "Location unconfirmed",
}
# How a source is named in a review sentence.
SOURCE_WHO = {
    "moviemaps": "MovieMaps",
    "wikipedia": "Wikipedia",
    "permit_record": "a city filming permit",
    "reelstreets": "Reelstreets",
    "movielocations": "MovieLocations",
    "fandom": "a fan wiki",
    "open_plaques": "a commemorative plaque at this address",
}


def fact_distance(relation: Column, subject_type: Column) -> Column:
    """0 the work itself, 1 the people behind it, 2 mere inspiration."""
    return (
        F.when(relation == "inspiration_for", 2)
        .when((subject_type == "creator") | relation.isin("author_place", "artist_place"), 1)
        .otherwise(0)
    )


def fact_sentence(
    relation: Column, subject: Column, place: Column, about: Column, year: Column,
    statement: Column,
) -> Column:
    """Stored statement, else the relation's sentence with subject, topic and year."""

    def fill(text: str) -> Column:
        parts = []
        for piece in text.replace("{s}", "\0s\0").replace("{p}", "\0p\0").split("\0"):
            if piece:
                parts.append({"s": subject, "p": place}.get(piece, F.lit(piece)))
        return F.concat(*parts)

    base = F.lit(None).cast("string")
    for key, text in reversed(FACT_SENTENCES.items()):
        base = F.when(relation == key, fill(text)).otherwise(base)
    base = F.coalesce(base, fill("{p} is connected with {s}"))
    topic = F.when(F.trim(about) != "", F.concat(F.lit(" — "), F.trim(about)))
    stated = F.when(year > 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")")))
    made = F.concat(
        base, F.coalesce(topic, F.lit("")), F.coalesce(stated, F.lit("")), F.lit(".")
    )
    return F.coalesce(F.when(F.trim(statement) != "", F.trim(statement)), made)


def place_role(place_class: Column, relation: Column, on_lot: Column) -> Column:
    """Role of a place in a work; the lot only decides what nothing else does."""
    kind = F.coalesce(place_class, F.lit("unknown"))
    return (
        F.when(kind == "fictional", "fictional")
        .when((relation == "narrative_location") | (kind == "narrative_real"), "narrative")
        .when(relation == "inspiration_for", "inspiration")
        .when(relation == "replica", "replica")
        .when(relation == "author_place", "author")
        .when(kind == "studio_interior", "studio")
        .when(kind.isin("real_exterior", "real_interior"), "on_location")
        .when(on_lot, "studio")
        .otherwise("unknown")
    )


def role_label(role: Column) -> Column:
    """Text of a role."""
    label = F.lit(None).cast("string")
    for key, text in ROLE_LABELS.items():
        label = F.when(role == key, text).otherwise(label)
    return label


def precision_badge(precision: Column, building_id: Column | None = None) -> Column:
    """Text of a precision."""
    low = F.lower(F.coalesce(precision, F.lit("")))
    built = low == "building"
    if building_id is not None:
        built = built | building_id.isNotNull()
    return (
        F.when(built, "Building")
        .when(low == "street", "Street")
        .when(low == "point", "Exact point")
        .when(low == "city", "City only")
        .when(low.isin("country", "region"), "Region only")
        .otherwise("Unknown precision")
    )


def point_badge(shot_on_set: Column, place_class: Column, precision: Column) -> Column:
    """Badge of a map point."""
    return (
        F.when(F.coalesce(shot_on_set, F.lit(False)), "studio")
        .when(place_class == "narrative_real", "narrative")
        .when(precision.isin("country", "city"), "approximate")
        .otherwise("exact")
    )


def submission_sentence(
    sentence: Column, place: Column, work: Column, source_kind: Column, status: Column,
    by_title: Column,
) -> Column:
    """Review sentence of a queue row."""
    who = F.lit("an external source")
    for key, text in SOURCE_WHO.items():
        who = F.when(source_kind == key, text).otherwise(who)
    stated = F.trim(F.coalesce(sentence, F.lit("")))
    head = F.when(
        stated != "", F.concat(stated, F.lit(" — recorded for "), work, F.lit(" by "), who)
    ).otherwise(
        F.concat(place, F.lit(" is listed as a location for "), work, F.lit(" by "), who)
    )
    checked = " We have checked the source. It is still a candidate, not part of our graph."
    tail = F.when(status == "verified", checked).otherwise(" Not yet verified by us.")
    caveat = F.when(
        by_title,
        F.concat(
            F.lit(" Matched to "), work,
            F.lit(" by title, not by identifier — check it is the same work."),
        ),
    ).otherwise("")
    return F.concat(head, F.lit("."), tail, caveat)


def work_slug(title: Column, year: Column, work_id: Column) -> Column:
    """title-year--id; the id alone when nothing readable is left."""
    text = F.regexp_replace(F.substring(slug(title), 1, 60), "-+$", "")
    readable = F.concat_ws("-", F.when(text != "", text), year.cast("string"))
    key = work_id.cast("string")
    return F.when(readable == "", key).otherwise(F.concat(readable, F.lit("--"), key))


def id_from_slug(text: Column) -> Column:
    """The id behind the last separator."""
    return F.regexp_extract(text, r"^(?:.*--)?(.*)$", 1)


def article_languages(available: Column, home: Column, limit: int = 3) -> Column:
    """English first, then home languages, then the rest; at most ``limit``."""
    english = F.filter(available, lambda x: x == "en")
    native = F.filter(home, lambda x: (x != "en") & F.array_contains(available, x))
    return F.slice(F.array_distinct(F.concat(english, native, available)), 1, max(1, limit))
