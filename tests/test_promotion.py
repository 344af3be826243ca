"""Promotion of queue rows and its gated publish."""

from __future__ import annotations

import pytest

from toponet.operators import spatial
from toponet.plans import promotion, resolution
from toponet.sources import writers

ROW = (
    "id long, work_id long, place_name string, lat double, lng double, wikidata_id string, score double, quote string, "
    "source_url string, source_kind string, source_sentence string, reason string, geocode_source string, geocode_source_id string"
)
PLACE = "place_id long, wikidata_id string, name string, lat double, lng double, status string"
LINK = "link_id long, work_id long, place_id long, relation_kind string, statement string"
EVIDENCE = "subject_type string, subject_id long, method string, source_url string, source_ref string, snippet string, agrees boolean"


def row(id_, work, name, lat, url="u", kind="wikipedia", said=None, qid=None, score=0.7, **more):
    quote = said if kind == "wikipedia" else None
    return (
        id_, work, name, lat, 5.0, qid, score, quote, url, kind, said, f"why {id_}", more.get("source"), more.get("source_id")
    )


@pytest.fixture()
def graph(spark):
    rows = [
        row(1, 10, "The Old Town Hall", 50.0, said="They filmed the last scene here."),
        row(2, 10, "Old Town Hall", 50.0001, url="v", kind="moviemaps", score=0.9, said="x" * 600),
        row(3, 11, "Old Town Hall", 50.0, url=None, kind="moviemaps"),
        row(4, None, "Bridge", 51.0, source="wikidata", source_id="Q7"),
        row(5, 12, "Harbour", 52.0, qid="Q5", said="A ship sails past the harbour."),
        row(6, 12, "The port", 53.0, qid="Q5", said="Another sentence about the port."),
        row(7, 13, "Station", 54.0, url="known", said="The train leaves the station again."),
        row(8, 13, "Studio Gate", 60.001, kind="", url="s"),
    ]
    lots = spatial.polygons(
        spark.createDataFrame(
            [(1, k, 60.0 + a, 5.0 + b) for k, (a, b) in enumerate([(-.01, -.01), (.01, -.01), (.01, .01), (-.01, .01)])],
            "lot_id long, vertex_no int, lat double, lng double",
        ), "lot_id", "vertex_no",
    )
    return {
        "rows": spark.createDataFrame(rows, ROW),
        "places": spark.createDataFrame([(100, None, "Station", 54.0, 5.0, "verified"), (90, "Q9", "Else", 0.5, 0.5, "verified")], PLACE),
        "links": spark.createDataFrame([(700, 13, 100, "filming_location", None), (701, 13, 100, "replica", "said")], LINK),
        "evidence": spark.createDataFrame([
            ("place", 100, "text_mention", "known", "wikipedia", None, True), ("link", 700, "manual_fix", "known", None, None, True),
            ("link", 701, "manual_fix", "x", None, None, True),
        ], EVIDENCE),
        "lots": lots,
    }


def planned(graph):
    return promotion.promote(*(graph[x] for x in ("rows", "places", "links", "evidence", "lots")))


def test_plan_says_what_the_sources_said(graph):
    plan = {k: v.collect() for k, v in planned(graph).items()}
    places = {r.name: r for r in plan["places"]}
    assert set(places) == {"Old Town Hall", "Bridge", "Harbour", "Studio Gate"}
    assert sorted(r.place_id for r in plan["places"]) == [101, 102, 103, 104]
    hall = places["Old Town Hall"]
    assert (hall.lat, hall.confidence, hall.confidence_band, hall.status_reason) == (50.0, 0.9, "verified", "why 1")
    assert [places[x].geocode_precision for x in ("Old Town Hall", "Bridge", "Harbour")] == ["none", "point", "point"]
    assert [places[x].shot_on_set for x in ("Old Town Hall", "Studio Gate")] == [False, True]
    links = {(r.work_id, r.place_id): r for r in plan["links"]}
    assert set(links) == {(10, hall.place_id), (11, hall.place_id), (12, places["Harbour"].place_id), (13, places["Studio Gate"].place_id)}
    assert links[10, hall.place_id].statement == "They filmed the last scene here." and links[10, hall.place_id].confidence == 0.9
    assert links[12, places["Harbour"].place_id].statement.startswith("A ship")
    assert [(r.link_id, r.statement) for r in plan["statements"]] == [(700, "The train leaves the station again.")]
    proof = {(r.subject_type, r.submission_id): r for r in plan["evidence"]}
    # The station's citation is held for the place, and for the link under another reference only.
    assert ("place", 7) not in proof and proof["link", 7].subject_id == 700 and ("link", 4) not in proof
    assert len(proof["place", 2].snippet) == 500 and proof["place", 2].agrees and proof["place", 3].snippet is None
    assert (proof["place", 8].source_url, proof["place", 8].source_ref) == ("s", None)
    # A row is one signal, whatever its URL.
    assert len(plan["evidence"]) == 8 - 1 + 7 and {r.id for r in plan["marked"]} == set(range(1, 9))


def test_second_run_writes_nothing(graph):
    plan = planned(graph)
    queue = graph["rows"].selectExpr("*", "cast(null as long) as place_id")
    tables = promotion.after_promotion(plan, queue, graph["places"], graph["links"], graph["evidence"])
    assert tables["submissions"].filter("place_id is null").isEmpty()
    assert tables["links"].filter("link_id = 700").first().statement.startswith("The train")
    again = promotion.promote(
        tables["submissions"].drop("place_id"), tables["places"], tables["links"], tables["evidence"], graph["lots"]
    )
    for name in ("places", "links", "statements", "evidence"):
        assert again[name].isEmpty(), name


def test_publish_switches_whole_versions_only(spark, graph, tmp_path):
    root, plan = str(tmp_path / "graph"), planned(graph)
    queue = graph["rows"].selectExpr("*", "cast(null as long) as place_id")
    tables = promotion.after_promotion(plan, queue, graph["places"], graph["links"], graph["evidence"])
    checked = lambda written: promotion.gates(written, plan)
    assert writers.published_version(spark, root) is None
    writers.publish(spark, tables, root, "v1", checked)
    assert writers.published_version(spark, root) == "v1"
    assert writers.published(spark, root, "places").count() == 6
    # A link without a citation, and a place held twice: the first version stays.
    bare = tables | {"evidence": graph["evidence"]}
    with pytest.raises(ValueError, match="links_have_evidence"):
        writers.publish(spark, bare, root, "v2", checked)
    twice = tables | {"places": tables["places"].unionByName(tables["places"].filter("place_id = 100"))}
    with pytest.raises(ValueError, match="places_are_unique"):
        writers.publish(spark, twice, root, "v3", checked)
    assert writers.published_version(spark, root) == "v1"
    writers.publish(spark, tables, root, "v4", checked)
    assert writers.published_version(spark, root) == "v4"
    assert writers.published(spark, root, "links").count() == 6


def test_gazetteer_is_asked_once_per_name(spark):
    names = spark.createDataFrame([("old mill",), ("old mill",), ("nowhere",), (None,)], "query_norm string")
    known = spark.createDataFrame(
        [("old mill", 7, 51.0, 1.0, None, True), ("new mill", 8, 52.0, 2.0, None, True)],
        "name_norm string, entity long, lat double, lng double, population long, exact_label boolean",
    )
    empty = spark.createDataFrame([], "query_norm string, entity long, lat double, lng double")
    cache = resolution.ask_through(names, known, empty)
    held = {tuple(r) for r in cache.collect()}
    assert held == {("old mill", 7, 51.0, 1.0), ("nowhere", None, None, None)} and cache.count() == 2
    assert resolution.ask_through(names, known, cache).isEmpty()
    more = names.union(spark.createDataFrame([("new mill",)], "query_norm string"))
    assert [tuple(r) for r in resolution.ask_through(more, known, cache).collect()] == [("new mill", 8, 52.0, 2.0)]


def test_groups_are_found_without_links_and_evidence(graph):
    plan = promotion.promote(graph["rows"], graph["places"], None, None)
    assert sorted(r.place_id for r in plan["groups"].collect()) == [100, 101, 102, 103, 104]


def test_snapshot_is_not_broadcast_for_its_small_files(spark):
    from toponet.session import snapshot

    rows = snapshot(spark.range(1000).selectExpr("id", "'the same text in every row' as text"))
    plan = rows.join(rows.withColumnRenamed("text", "other"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
