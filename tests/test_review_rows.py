"""Queue review: rows meet once, filters don't repeat expressions, numbers stay."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from toponet.fixtures import Views
from toponet.functions import phrases
from toponet.operators import review
from toponet.operators.numbering import dense_ids_on_key
from toponet.session import computed

c = F.col
SMALL = "/root/testdata/sf0.001"
ROW = "id long, work_id long, place_name string, source_kind string, lat double, lng double"


def test_rows_of_another_source_are_found_over_a_band_border(spark):
    edge = review.BAND_M / 111000.0
    rows = spark.createDataFrame(
        [
            (1, 1, "Hall", "a", edge - 0.0005, 5.0), (2, 1, "The hall", "b", edge, 5.0), (3, 1, "hall!", "b", edge + 0.0005, 5.0),
            (4, 1, "Hall", "a", None, None), (5, 2, "Hall", "a", edge, 5.0), (6, 1, "Hall", None, edge, 5.0),
            (7, None, "Hall", "b", edge, 5.0), (8, 1, None, "b", edge, 5.0), (9, 1, "Gate", "a", 1.0, 1.0), (10, 1, "Gate", "a", 1.0, 1.0),
            (11, 1, "Gate", "b", 0.0, 0.0),
        ], ROW,
    )
    got = {r.id: (r.corroborated, r.agrees) for r in review.corroborated(rows).collect()}
    assert got == {
        1: (True, True), 2: (False, False), 3: (True, True), 4: (True, False), 5: (False, False), 6: (True, False),
        9: (True, False), 10: (True, False), 11: (True, False),
    }


def test_queue_rows_are_dealt_out_once(spark):
    v = Views(spark, SMALL)
    plan = review.corroborated(v.submissions, v.submission_rows())._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan and "Join Inner, ((work_id" not in plan


def test_a_filter_does_not_repeat_what_it_reads(spark):
    rows = spark.createDataFrame([("a b",), ("c",)], "name string")
    made = computed(rows, key=F.upper("name")).filter(c("key") != "C").filter(c("key").isNotNull())
    assert [r.key for r in made.collect()] == ["A B"]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


def test_numbers_on_a_key_equal_one_window(spark):
    rows = spark.range(3000).select((c("id") * 7919 % 900).alias("k"), (c("id") % 13).alias("x"), "id")
    order = ["k", "x", "id"]
    want = rows.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long"))
    got = dense_ids_on_key(rows, order, "k", 16, "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_places_of_the_queue_stay_off_the_driver(spark):
    plan = Views(spark, SMALL).submissions._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_a_statement_is_more_than_its_source(spark):
    said = ["Source: somebody wrote this long text", "x" * 19, "x" * 20, None, "a" + " " * 30, "They filmed it here: the hall"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [r[0] for r in rows.orderBy("i").select(phrases.states_something(c("s"))).collect()]
    assert got == [False, False, True, False, False, True]
