"""Queue rows next to a place of their name: found without the pairs of rows and places."""

from __future__ import annotations

import random

from toponet.operators import answers, matching, spatial

NAMES = ["old mill", "old mill inn", "the old mill", "mill", "pier", "old mill in london w1", ""]


def test_row_is_known_by_one_namesake(spark, monkeypatch):
    rng = random.Random(5)
    spots = [(rng.choice(NAMES), 10 + rng.randrange(40) * 0.0004, rng.choice([179.9999, -179.9999, 179.99])) for _ in range(160)]
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(spots[:100])], "id long, place_name string, lat double, lng double")
    known = spark.createDataFrame([(k, *x) for k, x in enumerate(spots[100:])], "place_id long, name string, lat double, lng double")
    a = rows.selectExpr("id as a_id", "place_name as a_name", "lat as a_lat", "lng as a_lng")
    pairs = spatial.near_named_pairs(a, known.withColumnRenamed("place_id", "id"), 150.0)
    want = set(range(100)) - {r.a_id for r in pairs.select("a_id").distinct().collect()}

    def never(*args, **kwargs):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(spatial, "near_named_pairs", never)
    got = [r.id for r in matching.not_already_known(rows, known).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < 100


def test_queue_rows_are_copied_to_few_cells(spark, monkeypatch):
    sizes = []
    whole = spatial.cover

    def watched(lat, lng, radius, size):
        sizes.append(size)
        return whole(lat, lng, radius, size)

    monkeypatch.setattr(spatial, "cover", watched)
    links = spark.createDataFrame([(1, 7, 8, "filming_location")], "link_id long, work_id long, place_id long, relation_kind string")
    places = spark.createDataFrame([(8, "Old Mill", 10.0, 179.9999)], "place_id long, name string, lat double, lng double")
    queue = [(1, 7, "Old Mill", "pending", 10.0, -179.9999, None), (2, 7, "Pier", "pending", 10.0, 5.0, None), (3, 6, "Old Mill", "pending", 10.0, 179.9999, None)]
    rows = spark.createDataFrame(queue, "id long, work_id long, place_name string, status string, lat double, lng double, place_id long")
    got = sorted((r.work_id, r.tier, r.ref) for r in answers.search_answer(links, places, rows).collect())
    assert got == [(6, "queued", 3), (7, "queued", 2), (7, "stated", 8)]
    assert min(sizes) >= 5 * 151
