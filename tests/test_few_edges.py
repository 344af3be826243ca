"""Components of few edges cost few tasks, and equal those of the shuffled rounds."""

import pytest

from toponet.plans import grouping


def _tasks(spark, made):
    """What ``made`` returns, and the tasks that ran for it."""
    context = spark.sparkContext
    context.setJobGroup("few-edges", "few-edges")
    try:
        out = made()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def _edges(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, x) for x in range(1, 30)]
    return spark.createDataFrame(chain + star + [(7, 7), (900, 901)], "a long, b long")


@pytest.fixture
def many_partitions(spark):
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_of_few_edges_are_few_tasks(spark, many_partitions):
    rows, tasks = _tasks(spark, lambda: grouping.components(_edges(spark)).collect())
    found = {r.node: r.component for r in rows}
    assert found[140] == 100 and found[500] == 1 and found[901] == 900
    # The first round of 64 tasks alone reads the edges; none of the later ones shuffles.
    assert tasks < 64 * 6, tasks


def test_rounds_with_and_without_shuffles_agree(spark, monkeypatch):
    few = sorted(map(tuple, grouping.components(_edges(spark)).collect()))
    monkeypatch.setattr(grouping, "LITTLE", 0)
    assert few == sorted(map(tuple, grouping.components(_edges(spark)).collect()))
