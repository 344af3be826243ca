"""Queue to graph: evidence plans and promotion."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

EVIDENCE_KEY = ["subject_type", "subject_id", "method"]


def missing_evidence(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned evidence that is not held yet, each row once; NULL references match."""
    key = F.coalesce("source_ref", F.lit("")).alias("_ref")
    wanted = planned.select("*", key).dropDuplicates([*EVIDENCE_KEY, "_ref"])
    held = existing.select(*EVIDENCE_KEY, key).distinct()
    return wanted.join(held, [*EVIDENCE_KEY, "_ref"], "left_anti").drop("_ref")


PROMOTE_RADIUS_M = 40.0


def promotion_groups(rows: DataFrame) -> DataFrame:
    """Group of every promotable row: by its entity id, else near and alike.

    ``rows``: id, place_name, lat, lng, wikidata_id. A group without an id is
    placed by its first row and named by its shortest name, which is always some
    member's; members are therefore linked by name matches within 80 m, and the
    ordered pass runs inside those components over distinct (name, point).
    """
    from ..functions.fold import names_match, normalize_name
    from ..session import snapshot
    from . import blocks
    from .grouping import affix_match

    with_id = rows.filter(c("wikidata_id").isNotNull())
    first = with_id.groupBy("wikidata_id").agg(F.min("id").alias("group_id"))
    by_id = with_id.join(first, "wikidata_id").select("id", "group_id")
    bare = rows.filter(c("wikidata_id").isNull())
    shaped = snapshot(
        bare.groupBy("place_name", "lat", "lng").agg(F.min("id").alias("sid")).withColumn(
            "key", normalize_name(c("place_name"))
        )
    )
    made = blocks.first_fit(
        shaped.select(c("sid").alias("node"), c("place_name").alias("name"), "key", "lat", "lng"),
        PROMOTE_RADIUS_M, names_match, affix_match, lambda one, two: (len(one), one) < (len(two), two),
    )
    placed = shaped.join(made, c("sid") == c("node")).select("place_name", "lat", "lng", c("grp").alias("group_id"))
    by_name = bare.join(placed, ["place_name", "lat", "lng"]).select("id", "group_id")
    return by_id.unionByName(by_name)


SNIPPET_CHARS = 500
QID = r"^Q[1-9]\d*$"
KIND = "filming_location"

#: What a citation is known by, besides its subject; NULLs are equal.
CITED = ["source_url", "source_ref"]


def new_citations(planned: DataFrame, held: DataFrame) -> DataFrame:
    """Planned evidence whose subject doesn't hold that URL and reference yet."""
    url = c("source_url") if "source_url" in held.columns else F.lit(None).cast("string")
    there = held.select(
        c("subject_type").alias("_t"), c("subject_id").alias("_s"), url.alias("_u"), c("source_ref").alias("_r")
    )
    same = (
        (c("subject_type") == c("_t")) & (c("subject_id") == c("_s"))
        & c("source_url").eqNullSafe(c("_u")) & c("source_ref").eqNullSafe(c("_r"))
    )
    return planned.join(there, same, "left_anti")


def _after_largest(table: DataFrame, column: str, rows: DataFrame, number: str, name: str) -> DataFrame:
    """``rows`` with ``name``: their running number above the largest id of ``table``, by a one-row join."""
    top = table.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("_top")).withColumn("_one", F.lit(1))
    return (
        rows.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one")
        .withColumn(name, c("_top") + c(number)).drop("_top", "_one", number)
    )


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return c(name) if name in df.columns else F.lit(None).cast(kind)


class Promotion(Mapping):
    """What ``promote`` yields: each table is planned when it is first asked for.

    Steps that several tables need run once, and those that none of the asked tables needs not at all.
    """

    TABLES = ["groups", "places", "links", "statements", "evidence", "marked"]

    def __init__(self, rows: DataFrame, places: DataFrame, links: DataFrame, evidence: DataFrame, lots: DataFrame | None):
        self._places, self._links, self._evidence, self._lots = places, links, evidence, lots
        self._asked = rows
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.TABLES:
            raise KeyError(name)
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}_table")()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.TABLES)

    def __len__(self) -> int:
        return len(self.TABLES)

    @cached_property
    def rows(self) -> DataFrame:
        """The queue is read once; all tables start from this snapshot."""
        from ..session import snapshot

        rows = self._asked.withColumn("_reason", _column(self._asked, "reason")).withColumn(
            "_source", _column(self._asked, "geocode_source")
        ).withColumn("_source_id", _column(self._asked, "geocode_source_id"))
        return snapshot(rows)

    @cached_property
    def _member(self) -> DataFrame:
        from ..session import snapshot

        return snapshot(promotion_groups(self.rows))

    @cached_property
    def _groups(self) -> DataFrame:
        from ..operators import matching
        from ..operators.numbering import dense_ids
        from ..session import cut_lineage

        best = F.struct(F.length("place_name"), c("place_name"))
        lead = F.min_by(F.struct("lat", "lng", "wikidata_id", "_reason", "_source", "_source_id"), "id")
        groups = self.rows.join(self._member, "id").groupBy("group_id").agg(
            F.min_by("place_name", best).alias("name"), lead.alias("_lead"),
            F.least(F.lit(1.0), F.max("score")).alias("confidence"), F.count(F.lit(1)).alias("members"),
        ).select("group_id", "name", "_lead.*", "confidence", "members")
        groups = cut_lineage(groups)
        held = matching.existing_places(groups, self._places)
        groups = cut_lineage(groups.join(held, "group_id").withColumn("is_new", c("place_id").isNull()))
        numbers = dense_ids(groups.filter("is_new").select("group_id"), ["group_id"], "group_id", 4096, "_n")
        numbers = _after_largest(self._places, "place_id", numbers, "_n", "_new_id")
        return cut_lineage(
            groups.join(numbers, "group_id", "left")
            .withColumn("place_id", F.coalesce("place_id", "_new_id")).drop("_new_id")
        )

    @property
    def _placed(self) -> DataFrame:
        """The rows with their place; what reads it takes only the columns it uses."""
        of = self._groups.select("group_id", "place_id")
        return self.rows.drop("place_id").join(self._member, "id").join(of, "group_id")

    @cached_property
    def _matched(self) -> DataFrame:
        from ..session import snapshot

        wanted = self._placed.filter(c("work_id").isNotNull()).groupBy("work_id", "place_id").agg(
            F.least(F.lit(1.0), F.max("score")).alias("confidence"),
            F.min_by("quote", F.when(c("quote").isNotNull(), c("id"))).alias("statement"),
        )
        held_statement = F.max(_column(self._links, "statement"))
        known = self._links.filter(c("relation_kind") == KIND).groupBy("work_id", "place_id").agg(
            F.min("link_id").alias("link_id"), held_statement.alias("held_statement")
        )
        return snapshot(wanted.join(known, ["work_id", "place_id"], "left"))

    def _groups_table(self) -> DataFrame:
        return self._groups.drop("_reason", "_source", "_source_id")

    def _places_table(self) -> DataFrame:
        from ..operators import spatial

        fresh_places = self._groups.filter("is_new")
        entity = F.coalesce(c("wikidata_id").rlike(QID), F.lit(False)) | F.coalesce(
            (c("_source") == "wikidata") & c("_source_id").rlike(QID), F.lit(False)
        )
        if self._lots is None:
            on_lot = fresh_places.select("place_id").limit(0)
        else:
            points = fresh_places.select("place_id", "lat", "lng")
            on_lot = spatial.points_in_polygons(points, "place_id", self._lots, "lot_id")
        return fresh_places.join(on_lot.select("place_id", F.lit(True).alias("_lot")), "place_id", "left").select(
            "place_id", "wikidata_id", "name", "lat", "lng", F.lit("unknown").alias("place_class"),
            F.when(entity, "point").otherwise("none").alias("geocode_precision"),
            F.coalesce("_lot", F.lit(False)).alias("shot_on_set"), "confidence",
            F.lit("verified").alias("confidence_band"), F.lit("verified").alias("status"),
            c("_reason").alias("status_reason"),
        )

    def _links_table(self) -> DataFrame:
        from ..operators.numbering import dense_ids
        from ..session import snapshot

        fresh = dense_ids(
            self._matched.filter(c("link_id").isNull()).drop("link_id", "held_statement"), ["work_id", "place_id"],
            "work_id", 64, "_n",
        )
        return snapshot(
            _after_largest(self._links, "link_id", fresh, "_n", "link_id").select(
                "link_id", "work_id", "place_id", F.lit(KIND).alias("relation_kind"), "confidence", "statement"
            )
        )

    def _statements_table(self) -> DataFrame:
        return self._matched.filter(
            c("link_id").isNotNull() & c("held_statement").isNull() & c("statement").isNotNull()
        ).select("link_id", "statement")

    def _evidence_table(self) -> DataFrame:
        link_of = self._matched.filter(c("link_id").isNotNull()).select("work_id", "place_id", "link_id").unionByName(
            self["links"].select("work_id", "place_id", "link_id")
        )
        # A row meets its link once and is told twice, of its place and of its link.
        placed = self._placed.join(link_of, ["work_id", "place_id"], "left")

        def cited(subject: str, id_: str) -> Column:
            return F.when(c(id_).isNotNull(), F.struct(F.lit(subject).alias("subject_type"), c(id_).alias("subject_id")))

        told = F.substring(_column(placed, "source_sentence"), 1, SNIPPET_CHARS)
        subjects = F.array_compact(F.array(cited("place", "place_id"), cited("link", "link_id")))
        proof = placed.select("*", F.inline(subjects)).select(
            "subject_type", "subject_id", F.lit("text_mention").alias("method"),
            F.nullif(c("source_url"), F.lit("")).alias("source_url"),
            F.nullif(c("source_kind"), F.lit("")).alias("source_ref"),
            F.nullif(told, F.lit("")).alias("snippet"), F.lit(True).alias("agrees"), c("id").alias("submission_id"),
        )
        return new_citations(proof, self._evidence)

    def _marked_table(self) -> DataFrame:
        return self._placed.select("id", "place_id")


def promote(
    rows: DataFrame, places: DataFrame, links: DataFrame, evidence: DataFrame, lots: DataFrame | None = None
) -> Promotion:
    """Everything a promotion writes, as six tables that a second run leaves empty.

    ``rows``: verified, located, unpromoted queue rows with their score and quote; ``lots``:
    studio lots as ``spatial.polygons`` gives them. New places and links are numbered above
    the largest id there is. A link is known by work, place and relation; a known one keeps
    its id, takes the evidence, and takes the quote as its statement where it has none. Each
    row is one citation of its place and one of its link, unless they hold its URL and source
    already. A row without a work makes no link.
    """
    return Promotion(rows, places, links, evidence, lots)


def _joined(held: DataFrame, made: DataFrame) -> DataFrame:
    return held.unionByName(made, allowMissingColumns=True)


def after_promotion(
    plan: Mapping[str, DataFrame], submissions: DataFrame, places: DataFrame, links: DataFrame, evidence: DataFrame
) -> dict[str, DataFrame]:
    """The four tables as they are once ``plan`` is written."""
    told = plan["statements"].select("link_id", c("statement").alias("_told"))
    filled = links.withColumn("statement", _column(links, "statement")).join(told, "link_id", "left")
    filled = filled.withColumn("statement", F.coalesce("statement", "_told")).drop("_told")
    marked = submissions.join(plan["marked"].select("id", c("place_id").alias("_placed")), "id", "left")
    return {
        "places": _joined(places, plan["places"]),
        "links": _joined(filled, plan["links"]),
        "evidence": _joined(evidence, plan["evidence"].drop("submission_id")),
        "submissions": marked.withColumn("place_id", F.coalesce("place_id", "_placed")).drop("_placed"),
    }


def gates(tables: dict[str, DataFrame], plan: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows that forbid publishing: citations without a source, new facts without a citation, a fact twice."""
    from ..operators import quality

    no_people = plan["links"].select(c("link_id").alias("fact_id"), "place_id", "relation_kind").limit(0)
    return {
        "evidence_has_a_source": quality.evidence_without_source(plan["evidence"], CITED),
        "links_have_evidence": quality.facts_without_evidence(plan["links"], no_people, tables["evidence"]),
        "places_are_unique": quality.duplicate_keys(tables["places"], ["place_id"]),
        "links_are_unique": quality.duplicate_keys(
            tables["links"].join(plan["links"].select("work_id", "place_id").distinct(), ["work_id", "place_id"], "left_semi"),
            ["work_id", "place_id", "relation_kind"],
        ),
    }
