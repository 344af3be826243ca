"""Costly text tests run once a row."""

from toponet.operators import extraction


def test_accepted_extractions_are_read_from_one_judgement(spark):
    said = "The film was shot at Union Station in June"
    articles = spark.createDataFrame([(1, f"Intro. {said}. The end.")], "article_id long, prose string")
    rows = spark.createDataFrame(
        [
            (1, 0, "Union Station", said, "filming"), (1, 1, "Union Station", said, "filming"),
            (1, 2, "Union Station", said, "other"), (1, 3, "Union Station", "It was never said anywhere", "filming"),
            (1, 4, "Paddington", "It was never said anywhere", "filming"), (1, 5, " ", None, "filming"),
        ],
        "article_id long, position int, place_name string, source_sentence string, role string",
    )
    made = extraction.accept_extractions(rows, articles)
    assert {r.position: r.reason for r in made.collect()} == {
        0: None, 1: "duplicate", 2: "role_not_accepted", 3: "duplicate", 4: "quote_not_in_source", 5: "no_name",
    }
    # The judgement lies in files: neither of its two readers makes it again.
    plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "regexp" not in plan and "contains(" not in plan
