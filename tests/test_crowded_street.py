"""Groups of a crowded street are found without the pairs of its names and points."""

from __future__ import annotations

import pytest

from toponet.plans import blocks, grouping, promotion


@pytest.fixture()
def edges(monkeypatch):
    """Numbers of edges that components were made of."""
    seen = []
    whole = grouping.components

    def watched(pairs):
        seen.append(pairs.count())
        return whole(pairs)

    monkeypatch.setattr(grouping, "components", watched)
    return seen


def street(n, lng=5.0):
    """``n`` points some centimetres apart, each third one with a longer name."""
    return [(k, "old mill inn" if k % 3 else "old mill", 50.0 + k * 1e-7, lng) for k in range(n)]


def test_answers_of_a_street_make_no_pairs(spark, edges):
    points = spark.createDataFrame(street(900), "point_id long, name string, lat double, lng double")
    assert {r.group_id for r in grouping.answer_groups(points).collect()} == {0}
    assert max(edges) < 20


def test_promoted_rows_of_a_street_make_no_pairs(spark, edges):
    rows = [(*x, None) for x in street(900)]
    frame = spark.createDataFrame(rows, "id long, place_name string, lat double, lng double, wikidata_id string")
    assert {r.group_id for r in promotion.promotion_groups(frame).collect()} == {0}
    assert max(edges) < 20


@pytest.mark.parametrize("size", [1, 2, 20_000])
def test_groups_meet_over_the_date_line_and_cell_borders(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", size)
    rows = [
        (1, "Pier", 10.0, 179.9999), (2, "Pier", 10.0, -179.9999), (3, "Pier", 10.0, 179.9), (4, "", 10.0, 179.9999),
        (5, "Old Pier", 10.0, -179.9995), (6, None, 10.0, 179.9999), (7, "Pier", None, None), (8, "Pier", float("nan"), 1.0),
    ]
    points = spark.createDataFrame(rows, "node long, name string, lat double, lng double").selectExpr(
        "node", "name", "lower(name) as key", "lat", "lng"
    )
    made = blocks.first_fit(
        points, 150.0, grouping._answer_names_alike, grouping._answer_name_fits, lambda one, two: len(one) < len(two)
    )
    assert {r.node: r.grp for r in made.collect()} == {1: 1, 2: 1, 5: 1, 3: 3, 4: 4, 6: 6, 7: 7, 8: 8}
