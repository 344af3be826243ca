"""Queue review: reasons, signals, verdicts, source rules, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as ev, geo, phrases
from ..functions.fold import normalize_name
from ..session import computed
from . import spatial

c = F.col

# Sources anyone can check at the spot, and why.
CHECKABLE = {
    "open_plaques": "the inscription is on a wall at this coordinate and anyone can read it",
    "permit_record": "a filming permit issued by the city for this address",
}
MAX_NAME_WORDS = 12
AGREEMENT_M = 150.0
BAND_M = 30_000.0
# Donors of a borrowed coordinate, best first.
COORDINATE_DONORS = ["moviemaps", "permit_record", "wikipedia"]
NEEDS_SENTENCE = ["wikipedia", "reelstreets", "movielocations", "open_plaques", "fandom"]
NEEDS_RECORD = ["permit_record", "moviemaps", "reelstreets", "movielocations", "open_plaques"]
NEEDS_REVISION = ["wikipedia", "fandom"]


def disqualification(refused_sources: list[str] | None = None) -> Column:
    """First reason to reject a queue row, NULL when there is none."""
    name = F.trim(F.coalesce("place_name", F.lit("")))
    lat, lng = c("lat"), c("lng")
    both = lat.isNotNull() & lng.isNotNull()
    chain = F.when(c("source_kind").isin(refused_sources or []), "refused_source")
    return (
        chain.when(name == "", "no_place_name")
        .when(~name.rlike(r"\p{L}"), "name_has_no_letters")
        .when(F.lower(name).isin(phrases.NOT_A_PLACE), "not_a_place")
        .when(name.rlike(phrases.CREDIT_ONLY), "photo_credit_not_a_place")
        .when(both & ((F.abs(lat) > 90) | (F.abs(lng) > 180)), "impossible_coordinate")
        .when(both & (lat == 0) & (lng == 0), "null_island")
    )


def blocker() -> Column:
    """First reason to leave a queue row pending."""
    name = F.trim(F.coalesce("place_name", F.lit("")))
    long = F.char_length(name) > 2 * MAX_NAME_WORDS
    return (
        F.when(name.rlike(phrases.js(phrases.CREDIT_TAIL)), "unusable_name:photo_credit_appended")
        .when(name.rlike(phrases.js(phrases.CAPTION_MARKER)), "unusable_name:caption_prefix_not_cut")
        .when(long & (phrases.word_count(name) > MAX_NAME_WORDS), "unusable_name:sentence_not_a_name")
        .when(c("lat").isNull() | c("lng").isNull(), "no_coordinate")
    )


def signals(corroborated: Column, agrees: Column) -> Column:
    """Signals of a row in their fixed order.

    ``corroborated`` tells whether another source names the place, ``agrees``
    whether a borrowed coordinate lies near. A stated id that only echoes the
    row's own geocode is no signal.
    """
    entity = c("wikidata_id").rlike(r"^Q[1-9]\d*$")
    cited = (c("source_url") != "") & phrases.states_something(c("source_sentence"))
    return F.array_compact(
        F.array(
            F.when(entity, "wikidata_entity"),
            F.when(corroborated, "independent_corroboration"),
            F.when(cited, "cited_source"),
            F.when(agrees, "coordinate_agreement"),
        )
    )


def review(rows: DataFrame, corroborated: Column, agrees: Column) -> DataFrame:
    """Verdict per queue row: status, score, reason. One pass, no shuffle."""
    checkable = F.try_element_at(ev.literal_map(CHECKABLE), c("source_kind"))
    found = computed(rows, _refused=disqualification(), _blocked=blocker(), _signals=signals(corroborated, agrees))
    found = computed(found, _score=ev.review_score(c("_signals"))).withColumn("_checkable", checkable)
    claim = F.arrays_overlap("_signals", F.lit(["cited_source", "independent_corroboration"]))
    passed = claim & (c("_score") >= ev.VERIFY_THRESHOLD)
    joined = F.array_join("_signals", "+")
    status = (
        F.when(c("_refused").isNotNull(), "rejected")
        .when(c("_blocked").isNotNull(), "pending")
        .when(c("_checkable").isNotNull() | passed, "verified")
        .otherwise("pending")
    )
    reason = F.coalesce(
        "_refused", "_blocked", "_checkable",
        F.when(passed, joined)
        .when(F.size("_signals") == 0, "no_signal_yet")
        .otherwise(F.concat(F.lit("insufficient:"), joined)),
    )
    score = (
        F.when(c("_refused").isNotNull() | c("_blocked").isNotNull(), 0.0)
        .when(c("_checkable").isNotNull(), 1.0)
        .otherwise(c("_score"))
    )
    return found.select(
        *rows.columns,
        status.alias("verdict"),
        score.alias("score"),
        reason.alias("reason"),
        c("_signals").alias("signals"),
    )


def tally(verdicts: DataFrame) -> DataFrame:
    """Rows per status and reason, with subtotals."""
    return verdicts.rollup("verdict", "reason").agg(F.count(F.lit(1)).alias("row_count"))


def source_rule_violations(rows: DataFrame, record_id: Column, revision: Column) -> DataFrame:
    """Rows whose source kind demands evidence they do not carry."""
    kind = c("source_kind")
    sentence_ok = F.coalesce(F.length(F.trim("source_sentence")) >= 10, F.lit(False))
    record_ok = F.coalesce(F.length(F.trim(record_id)) > 0, F.lit(False))
    revision_ok = F.coalesce(revision > 0, F.lit(False))
    known = kind.isin(sorted(set(NEEDS_SENTENCE + NEEDS_RECORD + NEEDS_REVISION)))
    ok = (
        known
        & (~kind.isin(NEEDS_SENTENCE) | sentence_ok)
        & (~kind.isin(NEEDS_RECORD) | record_ok)
        & (~kind.isin(NEEDS_REVISION) | revision_ok)
    )
    return rows.filter(~ok)


def coordinate_agreement(rows: DataFrame) -> DataFrame:
    """Rows another source places within 150 m for the same work and name.

    Rows meet in bands of latitude, and of a band only names that several sources have there.
    Copies of one (work, name, source, point) are one row in the join.
    """
    spots = computed(
        rows.filter(geo.has_point(c("lat"), c("lng"))).select("work_id", "place_name", "source_kind", "lat", "lng"),
        name=normalize_name(c("place_name")),
    ).filter(c("name").isNotNull() & c("work_id").isNotNull() & c("source_kind").isNotNull()).drop("place_name")
    spots = spots.withColumn("_home", spatial.row_of(c("lat"), BAND_M)).withColumn(
        "_band", F.explode(spatial.rows_around(c("lat"), AGREEMENT_M + 1.0, BAND_M))
    )
    keys = ["work_id", "name", "_band"]
    there = Window.partitionBy(*keys)
    spots = spots.withColumn("_least", F.min("source_kind").over(there)).withColumn(
        "_most", F.max("source_kind").over(there)
    ).filter(c("_least") != c("_most")).select(*keys, "_home", "source_kind", "lat", "lng").distinct()
    other = spots.filter(c("_home") == c("_band")).select(
        *keys, c("source_kind").alias("o_kind"), c("lat").alias("o_lat"), c("lng").alias("o_lng"),
    )
    metres = geo.flat_m(c("lat"), c("lng"), c("o_lat"), c("o_lng"))
    near = spatial.shuffled(spots).join(spatial.shuffled(other), keys).filter(
        (c("source_kind") != c("o_kind")) & (metres <= AGREEMENT_M)
    )
    return near.select("work_id", "name", "source_kind", "lat", "lng").distinct()


def corroborated(rows: DataFrame, located: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``name_norm`` and two flags: the same work and name come from another source
    too (``corroborated``), and such a source puts it within 150 m (``agrees``).

    The rows are dealt out once, by work and name, together with the agreeing spots.
    ``located`` may give the same rows more cheaply where their ids aren't needed.
    """
    named = computed(rows, name_norm=normalize_name(c("place_name")))
    named = named.filter(c("work_id").isNotNull() & c("name_norm").isNotNull())
    agreeing = coordinate_agreement(rows if located is None else located).withColumnRenamed("name", "name_norm")
    both = named.withColumn("_found", F.lit(False)).unionByName(
        agreeing.withColumn("_found", F.lit(True)), allowMissingColumns=True
    )
    name = Window.partitionBy("work_id", "name_norm")
    spot = Window.partitionBy("work_id", "name_norm", "source_kind", "lat", "lng")
    flagged = (
        both.repartition("work_id", "name_norm")
        .withColumn("corroborated", F.coalesce(F.min("source_kind").over(name) != F.max("source_kind").over(name), F.lit(False)))
        .withColumn("agrees", F.max("_found").over(spot))
    )
    return flagged.filter(~c("_found")).drop("_found")


def best_link_score(rows: DataFrame) -> DataFrame:
    """Highest score per (place, work), never above one."""
    return rows.groupBy("place_id", "work_id").agg(
        F.least(F.lit(1.0), F.max("score")).alias("confidence")
    )


def source_profile(rows: DataFrame) -> DataFrame:
    """Shape of each source: rows, located rows, name lengths, sentences as names."""
    name = F.trim("place_name")
    return rows.groupBy("source_kind").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(F.when(geo.has_point(c("lat"), c("lng")), 1)).alias("located"),
        F.round(F.avg(F.length(name)), 4).alias("mean_name_length"),
        F.count(F.when(phrases.word_count(name) > MAX_NAME_WORDS, 1)).alias("sentence_names"),
    )


def single_point_names(rows: DataFrame) -> DataFrame:
    """Per work: names, and names whose located rows share exactly one point."""
    points = rows.filter(geo.has_point(c("lat"), c("lng"))).select(
        "work_id", normalize_name(c("place_name")).alias("name"), "lat", "lng"
    ).distinct()
    names = points.groupBy("work_id", "name").agg(F.count(F.lit(1)).alias("points"))
    return names.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("names"), F.count(F.when(c("points") == 1, 1)).alias("agreeing")
    )


def first_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the first by ``order`` (a total order within the key)."""
    rest = [x for x in rows.columns if x not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, *[c(f"_r.{x}").alias(x) for x in rest])


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row per key; an incoming row wins a tie."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    order = F.struct(-c(version), -c("_new"))
    return first_per_key(both, keys, order).drop("_new")


def insert_if_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table does not hold yet."""
    return incoming.join(current.select(*keys).distinct(), keys, "left_anti")


def harvest_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """new / changed / same / gone per record, by fingerprint of the other columns."""

    def print_of(df: DataFrame, name: str) -> DataFrame:
        rest = sorted(x for x in df.columns if x != key)
        text = F.to_json(F.struct(*rest))
        return df.select(key, F.sha2(text, 256).alias(name))

    both = print_of(before, "_old").join(print_of(after, "_fresh"), key, "full_outer")
    state = (
        F.when(c("_old").isNull(), "new")
        .when(c("_fresh").isNull(), "gone")
        .when(c("_old") == c("_fresh"), "same")
        .otherwise("changed")
    )
    return both.select(key, state.alias("state"))


def fill_missing(rows: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """Fill an identifier where it is missing, skipping values already taken.

    ``found`` brings at most one value per key. A value that another row holds,
    or that is offered to several rows, is a collision and left out.
    """
    taken = rows.filter(c(column).isNotNull()).select(c(column).alias("_v")).distinct()
    asked = found.join(rows.filter(c(column).isNull()).select(key), key, "left_semi").select(
        key, c(column).alias("_v")
    )
    offered = asked.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    judged = asked.join(taken.withColumn("_taken", F.lit(True)), "_v", "left").join(offered, "_v")
    clean = F.coalesce("_taken", F.lit(False)) | (c("_n") > 1)
    judged = judged.select(key, F.when(~clean, c("_v")).alias("_v"), clean.alias("collision"))
    return (
        rows.join(judged, key, "left")
        .withColumn(column, F.coalesce(column, "_v"))
        .withColumn("collision", F.coalesce("collision", F.lit(False)))
        .drop("_v")
    )
