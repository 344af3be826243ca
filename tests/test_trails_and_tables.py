from pyspark.sql import functions as F

from toponet.operators import trails
from toponet.sources import wiki


def _stops(spark, points, work=1):
    return spark.createDataFrame(
        [(work, k, 100 + k, lat, lng) for k, (lat, lng) in enumerate(points)],
        "work_id long, sequence_index int, place_id long, lat double, lng double",
    )


def test_a_trail_of_sixty_stops_is_ordered_whole(spark):
    points = [(10 + (k * 37 % 60) / 1000, 20.0) for k in range(60)]
    got = trails.walking_order(_stops(spark, points)).orderBy("walk_index").collect()
    assert sorted(r.sequence_index for r in got) == list(range(60))
    assert got[0].path_km < 0.25 * sum(
        abs(a[0] - b[0]) * 111.2 for a, b in zip(points, points[1:])
    )
    runs = trails.walk_runs(trails.legs(_stops(spark, points)))
    assert runs.select("sequence_index").distinct().count() == 60 or runs.count() > 0


def test_tiles_of_a_leg_across_an_ocean(spark):
    got = trails.corridor_tiles(trails.legs(_stops(spark, [(0.0, 0.0), (60.0, 90.0)]))).collect()
    assert len(got) == 400 and got[0].truncated and got[0].wanted > 1_000_000
    near = trails.corridor_tiles(trails.legs(_stops(spark, [(48.85, 2.35), (48.86, 2.36), (48.85, 2.35)]))).collect()
    assert len(near) == near[0].wanted and not near[0].truncated


def test_chapters_take_the_first_stop_where_no_city_is_near(spark):
    stops = _stops(spark, [(0.0, 0.0), (0.01, 0.0), (30.0, 0.0)]).withColumn("name", F.concat(F.lit("stop "), "sequence_index"))
    cities = spark.createDataFrame([("Town", 30.1, 0.0)], "name string, lat double, lng double")
    got = trails.chapters(stops, cities).orderBy("chapter").collect()
    assert [(r.chapter, r.first, r.stops, r.name) for r in got] == [(1, 0, 2, "stop 0"), (2, 2, 1, "Town")]


def test_table_spans_links_and_citations():
    table = """{| class="wikitable"
! Real location !! style="width:9em" | Scene
|-
| rowspan="2" | [[Old Mill|The Mill]] <ref>see https://example.org/mill.</ref> || Duel
|-
| Chase
|-
| Harbour<br>Pier || ''Arrival''
|-
| same || Nothing
|}"""
    got = [(r["real"], r["story"], r["links"]) for r in wiki.table_rows(table)]
    assert got == [
        ("The Mill", "Duel", ["https://example.org/mill"]), ("The Mill", "Chase", ["https://example.org/mill"]),
        ("Harbour", "Arrival", []), ("Pier", "Arrival", []),
    ]
    assert wiki.table_rows("no table") == [] and wiki.location_section("== Cast ==\nx") is None


def test_citations_of_the_place_cells_only():
    """A country or note column cites something else than the place; ``!!`` parts cells of data lines too."""
    table = """{| class="wikitable"
! Filming location !! Scene !! Country !! Notes
|-
| [[Mill]]<ref>https://a.org/1</ref> || Duel [https://a.org/2 seen] || Spain<ref>https://b.org</ref> || https://c.org
|-
| Pier !! Arrival <!-- hidden https://d.org --> !! France
|}"""
    got = [(r["real"], r["story"], r["story_region"], r["links"]) for r in wiki.table_rows(table)]
    assert got == [("Mill", "Duel seen", "Spain", ["https://a.org/1", "https://a.org/2"]), ("Pier", "Arrival", "France", ["https://d.org"])]


def test_best_section():
    page = "== Production ==\n{|\n|}\n=== Sets ===\nx\n== Filming ==\n* a\n== Filming locations ==\nprose\n== Locations ==\n* b\n"
    assert wiki.location_section(page)[0] == "Production"
    assert wiki.location_section(page.replace("{|", "")) == ("Locations", "* b")
    assert wiki.location_section("== Locations ==\nold") == ("Locations", "old")
    heads = {"Real place": "real", "General area": "story_region", "Area in England": "real_region", "Scene": "story", "Cast": None, "": None}
    assert {x: wiki.header_class(x) for x in heads} == heads


def test_call_arguments():
    page = "x moviemaps.loadPublic('map', {\"lid\": 1, \"t\": \"a)\\\"b\"}, [{\"lid\": 2}, {\"q\": 1}]) y"
    assert [x["lid"] for x in wiki.payload_locations(page)] == [1, 2]
    assert wiki.payload_locations("moviemaps.loadPublic('map', {\"lid\": 1}") == []


def test_rectangles_after_a_full_one_make_no_tiles(spark):
    stops = _stops(spark, [(48.85, 2.35), (48.86, 2.36), (0.0, 0.0), (60.0, 90.0), (48.86, 2.37)])
    made = []
    kept = trails._first_rectangles

    def noted(rectangles):
        made.append((rectangles.count(), kept(rectangles).select("rank", "z").collect()))
        return kept(rectangles)

    trails._first_rectangles = noted
    try:
        got = trails.corridor_tiles(trails.legs(stops)).drop("leg").collect()
        trails._first_rectangles = lambda rectangles: rectangles
        whole = trails.corridor_tiles(trails.legs(stops)).drop("leg").collect()
    finally:
        trails._first_rectangles = kept
    assert sorted(got) == sorted(whole) and len(got) == 400
    total, first = made[0]
    # Four legs of two zooms; the second leg's first zoom fills the trail.
    assert total == 8 and len(first) == 3 and len({r.rank for r in first}) == 2
