"""Gates on what a text reader extracted: quotes, plot positions, accepted places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phrases
from ..functions.fold import normalize_name
from ..session import computed, snapshot
from . import textmatch
from .numbering import group_ranks, top_per_key

c = F.col

MAX_PER_ARTICLE = 25
ROLES = {
    "filming": "filming_location", "author": "author_place", "inspiration": "author_place",
    "writing": "author_place",
}
MIN_PLOT_WORDS, MAX_PLOT_WORDS = 6, 20


def plot_scenes(quotes: DataFrame, plots: DataFrame, key: str) -> DataFrame:
    """Places of each plot in the order the text reaches them.

    ``quotes``: location, text; ``plots``: key, text. Only quotes of 6 to 20
    words that occur verbatim count; the earliest occurrence places a location.
    """
    n = phrases.word_count(c("text"))
    fair = quotes.filter(n.between(MIN_PLOT_WORDS, MAX_PLOT_WORDS))
    hits = textmatch.quotes_in_texts(
        fair.select("location", "text"), plots, "location", key
    )
    placed = hits.groupBy(key, "location").agg(F.min("at").alias("at"))
    return group_ranks(
        placed, [key], [c("at"), c("location")], F.floor(c("at") / 4096), "sequence_index"
    )


def extraction_reasons(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Row-level reason to drop an extracted place, NULL when it may be accepted.

    ``late`` is told of rows without an ``early`` reason only.
    ``rows``: article_id, position, place_name, source_sentence, role;
    ``articles``: article_id, prose, brought to comparison form once.
    """
    from ..functions.evidence import literal_map

    name, sentence = c("_name"), c("_said")
    relation = F.try_element_at(literal_map(ROLES), F.lower(F.trim("role")))
    early = (
        F.when(
            (normalize_name(name) == "") | ~F.char_length(name).between(2, 160), "no_name"
        ).when(c("relation_kind").isNull(), "role_not_accepted")
    )
    # Each test runs once a row, and only where all before it let the row pass.
    late = F.coalesce(
        F.when(~F.char_length(sentence).between(10, 400), "quote_wrong_length"),
        F.when(~c("_form").contains(phrases.quote_form(c("source_sentence"))), "quote_not_in_source"),
        phrases.quote_rejection(sentence),
        F.when(~phrases.mentions_place(sentence, name), "quote_is_about_elsewhere"),
        F.when(phrases.names_a_person(name, sentence), "names_a_person"),
        F.when(
            ~phrases.supports_role(sentence, c("relation_kind")),
            F.when(sentence.rlike(phrases.js(phrases.PLAN_NOT_FACT)), "quote_is_a_plan_not_a_fact").otherwise(
                "quote_does_not_support_role"
            ),
        ),
    )
    forms = computed(articles.select("article_id", "prose"), _form=phrases.quote_form(c("prose"))).drop("prose")
    told = computed(rows, _name=F.trim("place_name"), relation_kind=relation)
    told = computed(told, early=early).join(forms, "article_id").withColumn("_said", F.trim("source_sentence"))
    return computed(told, late=F.when(c("early").isNull(), late)).select(
        "article_id", "position", c("_name").alias("place_name"), c("_said").alias("source_sentence"),
        "relation_kind", "early", "late",
    )


def accept_extractions(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """Accept at most 25 distinct places per article, in order; others get a reason.

    A place repeats an accepted one when the heads are equal and the areas
    overlap or one names none. That relation is not transitive, so it is decided
    in order, but only among the distinct area lists of one head in one article.
    """
    # Judged once: what passes, and every row with its reason, are read from there.
    judged = snapshot(
        computed(
            extraction_reasons(rows, articles).drop("source_sentence"),
            head=F.when(c("early").isNull(), normalize_name(phrases.place_head(c("place_name")))),
            areas=F.when(c("early").isNull(), F.array_sort(F.array_distinct(phrases.area_keys(c("place_name"))))),
        )
    )
    key = ["article_id", "head"]
    passing = judged.filter(c("early").isNull() & c("late").isNull())
    lists = passing.groupBy(*key, "areas").agg(F.min("position").alias("position"))
    ordered = lists.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("position", "areas"))).alias("lists")
    )

    def alike(a, b):
        return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)

    def fold(kept, item):
        seen = F.exists(kept, lambda k: alike(k["areas"], item["areas"]))
        return F.when(seen & (c("head") != ""), kept).otherwise(F.concat(kept, F.array(item)))

    empty = F.array().cast("array<struct<position:int,areas:array<string>>>")
    kept = ordered.withColumn("kept", F.aggregate("lists", empty, fold)).select(*key, "kept")
    entries = kept.select("article_id", F.explode("kept.position").alias("position"))
    first = top_per_key(entries, ["article_id"], [c("position")], MAX_PER_ARTICLE)
    limits = first.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("position").alias("_last")
    )
    out = (
        judged.join(kept, key, "left")
        .join(limits, "article_id", "left")
        .withColumn("_full", (c("_n") >= MAX_PER_ARTICLE) & (c("position") > c("_last")))
    )
    repeated = F.exists(
        F.coalesce("kept", empty),
        lambda k: (k["position"] < c("position"))
        & (k["position"] <= c("_last"))
        & alike(k["areas"], c("areas")),
    ) & (c("head") != "")
    reason = F.coalesce(
        "early",
        F.when(F.coalesce(repeated, F.lit(False)), "duplicate"),
        F.when(F.coalesce(c("_full"), F.lit(False)), "over_limit"),
        "late",
    )
    return out.select(
        "article_id", "position", "place_name", "relation_kind", reason.alias("reason")
    )


def best_images(images: DataFrame, key: str, limit: int = 8) -> DataFrame:
    """Best images per page: valid path, each path once, votes, average, width."""
    valid = images.filter(c("path").rlike(r"^/[A-Za-z0-9._-]+$"))
    first = valid.groupBy(key, "path").agg(
        F.min(F.struct("position", "votes", "average", "width")).alias("_r")
    ).select(key, "path", "_r.*")
    order = [F.desc("votes"), F.desc("average"), F.desc("width"), c("position")]
    return top_per_key(first, [key], order, limit)


PHOTO_SOURCES = ["mapillary", "wikimedia", "streetview"]


def best_photo(photos: DataFrame, key: str, heading: float | None = None) -> DataFrame:
    """One photo per place: first source that has a creditable one, then the score.

    ``photos``: key, photo_id, source, author, licence, distance_m, angle.
    """
    from ..functions.geo import bearing_difference

    needs_credit = c("source").isin("mapillary", "wikimedia")
    usable = photos.filter(
        c("source").isin(PHOTO_SOURCES)
        & (~needs_credit | (c("author").isNotNull() & c("licence").isNotNull()))
    )
    away = F.lit(0.0)
    if heading is not None:
        away = F.coalesce(
            F.least(bearing_difference(c("angle"), F.lit(heading)), F.lit(90.0)), F.lit(0.0)
        )
    rank = F.array_position(F.lit(PHOTO_SOURCES), c("source"))
    score = c("distance_m") + away
    return usable.groupBy(key).agg(
        F.min(F.struct(rank.alias("r"), score.alias("score"), "photo_id", "source")).alias("_b")
    ).select(key, c("_b.photo_id").alias("photo_id"), c("_b.source").alias("source"),
             c("_b.score").alias("score"))


def best_described(queue: DataFrame) -> DataFrame:
    """Longest note of each work at each point."""
    note = phrases.scene_note(c("source_sentence"), c("place_name"))
    rows = queue.select("lat", "lng", "work_id", "id", note.alias("note"))
    size = F.coalesce(F.char_length("note"), F.lit(0))
    return rows.groupBy("lat", "lng", "work_id").agg(
        F.min(F.struct((-size).alias("s"), "id", "note")).alias("_b")
    ).select("lat", "lng", "work_id", c("_b.id").alias("id"), c("_b.note").alias("note"))
