"""Works of one title and kind meet a text once."""

from toponet.operators import textmatch


def test_works_of_one_title_meet_a_text_once(spark, monkeypatch):
    works = spark.createDataFrame(
        [(i, "Long Night Harbour", "film") for i in range(50, 10, -1)]
        + [(5, "Long Night Harbour", "book"), (7, "Other Title Here", "film")],
        "work_id long, title string, kind string",
    )
    texts = spark.createDataFrame(
        [(1, "It was filmed for Long Night Harbour here."), (2, "Nothing of that sort."), (3, "Long Night Harbours filmed")],
        "key long, text string",
    )
    seen, found_runs = [], textmatch.found_runs

    def watched(texts, key, text, leads):
        seen.append(leads.count())
        return found_runs(texts, key, text, leads)

    monkeypatch.setattr(textmatch, "found_runs", watched)
    rows = [(r.key, r.work_id, r["at"]) for r in textmatch.title_claims(texts, works, "key").collect()]
    assert rows == [(1, 11, 18)] and seen == [3]
