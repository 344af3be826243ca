"""Facts of works and places, card rows and what may be shown on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts as fa
from .grouped import grouped_map
from .numbering import top_per_key

c = F.col

# Relations under which nothing was filmed at a place.
NEVER_FILMED = ["narrative_location", "inspiration_for", "replica", "author_place", "artist_place"]
FINE_PRECISIONS = ["point", "building", "street"]
ROLE_ORDER = ["on_location", "unknown", "studio", "narrative", "fictional"]
MAX_PROFILE_PLACES = 60


def matchable_for_frames(places: DataFrame, links: DataFrame) -> DataFrame:
    """Precise, identified places that some film was really shot at."""
    filmed = links.filter(~c("relation_kind").isin(NEVER_FILMED)).select("place_id").distinct()
    good = places.filter(
        c("lat").isNotNull()
        & c("wikidata_id").isNotNull()
        & c("geocode_precision").isin(FINE_PRECISIONS)
    )
    return good.join(filmed, "place_id", "left_semi")


def all_facts(
    links: DataFrame, works: DataFrame, creator_links: DataFrame, creators: DataFrame
) -> DataFrame:
    """Facts of works and of people in one table."""
    of_works = links.join(works.select("work_id", "title", "kind"), "work_id").select(
        c("link_id").alias("fact_id"),
        F.lit("work").alias("subject_type"),
        c("work_id").alias("subject_id"),
        c("title").alias("subject_name"),
        c("kind").alias("subject_kind"),
        "place_id",
        "relation_kind",
        "narrative_order",
        "confidence",
    )
    of_people = creator_links.join(creators, "creator_id").select(
        "fact_id",
        F.lit("creator").alias("subject_type"),
        c("creator_id").alias("subject_id"),
        c("name").alias("subject_name"),
        c("kind").alias("subject_kind"),
        "place_id",
        "relation_kind",
        "stated_year",
    )
    return of_works.unionByName(of_people, allowMissingColumns=True)


def fact_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence rows per fact, keyed like the facts."""
    kind = F.when(c("subject_type") == "link", "work").when(
        c("subject_type") == "creator_link", "creator"
    )
    return (
        evidence.withColumn("subject_type", kind)
        .filter(c("subject_type").isNotNull())
        .groupBy("subject_type", c("subject_id").alias("fact_id"))
        .agg(F.count(F.lit(1)).alias("evidence_count"))
    )


def facts_of_works(facts: DataFrame, work_creators: DataFrame) -> DataFrame:
    """Every work with its own facts and those of its creators."""
    own = facts.filter(c("subject_type") == "work").withColumn("work_id", c("subject_id"))
    people = facts.filter(c("subject_type") == "creator").join(
        work_creators.select("work_id", c("creator_id").alias("subject_id")), "subject_id"
    )
    return own.unionByName(people)


def place_cards(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with their distance from the subject and evidence counts."""
    return facts.join(fact_evidence(evidence), ["subject_type", "fact_id"], "left").withColumn(
        "evidence_count", F.coalesce("evidence_count", F.lit(0).cast("long"))
    ).withColumn("distance", fa.fact_distance(c("relation_kind"), c("subject_type")))


def stable_order() -> list[Column]:
    """Order of the facts on a place card."""
    return [
        c("distance"), c("subject_name"), c("narrative_order").asc_nulls_first(),
        c("stated_year").asc_nulls_last(), c("fact_id"),
    ]


def profile_places(rows: DataFrame, limit: int = MAX_PROFILE_PLACES) -> DataFrame:
    """Places of each work: nearest facts first, then role, then confidence."""
    rank = F.array_position(F.lit(ROLE_ORDER), c("role")) - 1
    order = [
        c("distance"), rank, F.coalesce("place_confidence", F.lit(0.0)).desc(), c("fact_id")
    ]
    return top_per_key(rows, ["work_id"], order, limit)


def place_coverage(facts: DataFrame) -> DataFrame:
    """Facts and distinct subjects by kind at each place."""
    noun = (
        F.when(c("subject_type") == "creator", "person")
        .when(c("subject_kind").isin("film", "series", "book"), c("subject_kind"))
        .otherwise("work")
    )
    rows = facts.withColumn("noun", noun)
    # One row per subject first: a subject with very many facts shrinks before the pivot.
    subjects = rows.groupBy("place_id", "noun", "subject_type", "subject_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return subjects.groupBy("place_id").agg(
        F.sum("n").alias("fact_count"),
        *[
            F.count(F.when(c("noun") == k, 1)).alias(f"{k}_count")
            for k in ("film", "series", "book", "person", "work")
        ],
    )


def role_tally(rows: DataFrame) -> DataFrame:
    """Places per role of each work."""
    roles = ["on_location", "studio", "narrative", "fictional", "unknown", "inspiration", "replica", "author"]
    return rows.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("place_count"),
        F.count(F.when(c("distance") > 1, 1)).alias("nearby_count"),
        *[F.count(F.when(c("role") == r, 1)).alias(r) for r in roles],
    )


def coverage_line() -> Column:
    """Sentence over a role tally."""
    n = c("place_count")
    first = F.concat(n.cast("string"), F.when(n == 1, " place").otherwise(" places"))
    filmed = F.when(
        c("on_location") > 0,
        F.concat(c("on_location").cast("string"), F.lit(" filmed on location")),
    )
    nearby = F.when(
        c("nearby_count") > 0,
        F.concat(c("nearby_count").cast("string"), F.lit(" nearby rather than in the film")),
    )
    return F.concat(F.concat_ws(" · ", first, filmed, nearby), F.lit("."))


def spoiler_gate(scenes: DataFrame, places: DataFrame, progress: int | None) -> DataFrame:
    """Scenes with what lies beyond the reader's progress blanked out."""
    ok = F.coalesce("spoiler_tier", F.lit(0)) <= max(progress or 0, 0)
    rows = scenes.withColumn("revealed", ok).join(
        places.select("place_id", "name", "lat", "lng"), "place_id", "left"
    )
    hidden = ["place_id", "name", "lat", "lng"]
    return rows.select(
        *[x for x in scenes.columns if x != "place_id"],
        "revealed",
        *[F.when(c("revealed"), c(x)).alias(x) for x in hidden],
    )


def trail_progress(scenes: DataFrame, progress: int) -> DataFrame:
    """Scenes per work: all, shown, hidden, highest tier."""
    shown = F.coalesce("spoiler_tier", F.lit(0)) <= progress
    return scenes.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(shown, 1)).alias("revealed_count"),
        F.count(F.when(~shown, 1)).alias("hidden_count"),
        F.max("spoiler_tier").alias("highest_tier"),
    )


def stored_frames(pairs: DataFrame, works: DataFrame, places: DataFrame, links: DataFrame,
                  frames: DataFrame) -> DataFrame:
    """Frame of a (work, place) pair, telling what is missing when there is none."""
    linked = links.select("work_id", "place_id").distinct().withColumn("_linked", F.lit(True))
    known_work = works.select("work_id", F.lit(True).alias("_work"))
    known_place = places.select("place_id", F.lit(True).alias("_place"))
    rows = (
        pairs.join(known_work, "work_id", "left")
        .join(known_place, "place_id", "left")
        .join(linked, ["work_id", "place_id"], "left")
        .join(frames, ["work_id", "place_id"], "left")
    )
    state = (
        F.when(c("_work").isNull() | c("_place").isNull(), "no_work_or_place")
        .when(c("_linked").isNull(), "no_link")
        .when(c("file_path").isNull(), "no_frame")
        .otherwise("frame")
    )
    return rows.select("work_id", "place_id", "file_path", state.alias("state"))


def work_candidates(submissions: DataFrame, limit: int = 60) -> DataFrame:
    """Queue rows on a work's card: checked first, mappable first, then by name."""
    status = F.when(c("status") == "verified", 0).when(c("status") == "pending", 2).otherwise(4)
    mappable = F.when(c("lat").isNotNull() & c("lng").isNotNull(), 0).otherwise(1)
    name = F.trim("place_name")
    rows = submissions.filter((c("status") != "rejected") & (name != ""))
    return top_per_key(rows, ["work_id"], [status + mappable, name, c("id")], limit)


def fold_bindings(links: DataFrame) -> DataFrame:
    """One row per (work, place): first date, one sample, number of distinct kinds."""
    return links.groupBy("work_id", "place_id").agg(
        F.min("created_at").alias("first_date"),
        F.min_by("relation_kind", "link_id").alias("sample"),
        F.count_distinct("relation_kind").alias("types"),
    )


def venue_spellings(submissions: DataFrame) -> DataFrame:
    """Spellings of one venue collapsed: shortest name, how many spellings.

    Names fit when their heads are equal and their areas agree, so only names of
    one head are compared, and of those only the distinct area lists.
    """
    import pandas as pd

    from ..functions.fold import normalize_name
    from ..functions.phrases import area_keys, place_head

    rows = submissions.select("place_name").distinct().select(
        "place_name",
        normalize_name(place_head(c("place_name"))).alias("head"),
        F.array_join(F.array_sort(F.array_distinct(area_keys(c("place_name")))), "|").alias("areas"),
    )
    lists = rows.groupBy("head", "areas").agg(
        F.min("place_name").alias("first"), F.count(F.lit(1)).alias("spellings"),
        F.min(F.struct(F.length("place_name").alias("n"), "place_name")).alias("short"),
    )

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[frozenset]] = []
        pdf = pdf.sort_values("first").reset_index(drop=True)
        label = []
        for text in pdf["areas"]:
            mine = frozenset(x for x in text.split("|") if x)
            fits = (
                g for g, held in enumerate(groups)
                if pdf["head"][0] and all(not mine or not o or mine & o for o in held)
            )
            home = next(fits, None)
            if home is None:
                home = len(groups)
                groups.append([])
            groups[home].append(mine)
            label.append(home)
        pdf["venue"] = label
        return pdf[["head", "venue", "spellings", "n", "name"]]

    flat = lists.select("head", "areas", "first", "spellings", "short.n", c("short.place_name").alias("name"))
    made = grouped_map(
        flat, "head", collapse, "head string, venue int, spellings long, n int, name string"
    )
    return made.groupBy("head", "venue").agg(
        F.min(F.struct("n", "name"))["name"].alias("name"), F.sum("spellings").alias("spellings")
    )


def walkable(places: DataFrame) -> DataFrame:
    """Located places with a building or a fine precision."""
    fine = F.lower("geocode_precision").isin(FINE_PRECISIONS)
    return places.filter(c("lat").isNotNull() & (c("osm_building_id").isNotNull() | fine))
