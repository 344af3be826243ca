"""Points along paths: a pair of path and point is made once."""

from __future__ import annotations

import pytest

from toponet.operators import spatial


@pytest.fixture()
def tables(spark):
    path = [
        (1, 3, 10.0, 5.0), (1, 1, 10.0, 5.0), (1, 2, 10.001, 5.0), (2, 1, 10.0005, 5.0), (2, None, 10.0005, 5.0),
        (None, 4, 10.0, 5.0), (3, 1, None, 5.0), (4, 1, 50.0, 179.9999),
    ]
    points = [(7, 10.0002, 5.0), (7, 10.0002, 5.0), (8, 10.0009, 5.0), (8, 50.0, -179.9999), (8, 10.0, 5.0), (9, 11.0, 5.0), (6, None, 5.0)]
    return (
        spark.createDataFrame(points, "place_id long, lat double, lng double"),
        spark.createDataFrame(path, "work_id long, at int, lat double, lng double"),
    )


def along(tables):
    points, path = tables
    return spatial.along_path(points, "place_id", path, "work_id", "at", 200.0)


def test_nearest_point_of_every_path(tables):
    got = {(r.work_id, r.place_id): (round(r.metres_off), r.along) for r in along(tables).collect()}
    assert got == {
        (1, 7): (22, 1), (1, 8): (0, 1), (2, 7): (33, None), (2, 8): (44, None), (None, 7): (22, 4), (None, 8): (0, 4),
        (4, 8): (14, 1),
    }
    assert along(tables).count() == len(got)


def test_pairs_are_not_shuffled(tables):
    """No aggregate stands above the join of paths and points, but for points at several places."""
    plan = along(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan[: plan.index("Aggregate")]
