"""Clusters of a work's names: few names in one row, many on their affixes, with equal results."""

import random

from toponet.plans import grouping

QUEUE = "id long, work_id long, place_name string, source_kind string, lat double, lng double"
WORDS = ["old", "new", "hall", "town", "city", "bridge", "all", "a"]


def queue(spark):
    dice = random.Random(3)
    return spark.createDataFrame(
        [
            (i, i % 9 if i % 50 else None, " ".join(dice.choices(WORDS, k=dice.randint(0, 3))), dice.choice(grouping.DONORS), 1.0, 2.0)
            for i in range(600)
        ], QUEUE,
    )


def clusters(df):
    return sorted(map(tuple, grouping.name_clusters(df).select("id", "work_id", "cluster_id").collect()))


def test_few_names_of_a_work_are_compared_in_one_row(spark, monkeypatch):
    df = queue(spark)

    def refused(heads):
        raise AssertionError("no work has many names")

    monkeypatch.setattr(grouping, "_many_name_clusters", refused)
    monkeypatch.setattr(grouping, "FEW_NAMES", 1000)
    few = clusters(df)
    assert few and all(work is not None for _, work, _ in few)
    monkeypatch.undo()
    monkeypatch.setattr(grouping, "FEW_NAMES", 2)
    assert clusters(df) == few


def test_a_work_of_many_names_leaves_the_others_in_one_row(spark, monkeypatch):
    df = queue(spark).filter("work_id <> 4 or id < 50")
    monkeypatch.setattr(grouping, "FEW_NAMES", 8)
    mixed = clusters(df)
    monkeypatch.setattr(grouping, "FEW_NAMES", 1000)
    assert clusters(df) == mixed
