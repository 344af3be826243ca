"""Texts that hold quotes or titles, against plain substring tests."""

from __future__ import annotations

import random

import numpy as np

from toponet.operators import textmatch


def test_quotes_equal_substring_search(spark, monkeypatch):
    monkeypatch.setattr(textmatch, "BLOCK", 300)
    rng = random.Random(5)
    words = ["ein", "café", "straße", "日本語", "a", "of", "house", "tower", "x" * 30]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for k in range(80)]
    texts += [(80, None), (81, ""), (82, "  "), (83, "tower " * 2000 + "the very end")]
    quotes = [(f"q{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 16)))) for k in range(40)]
    for k in range(40):
        text = texts[rng.randrange(80)][1]
        at = rng.randrange(len(text) + 1)
        quotes.append((f"c{k}", text[at : at + rng.randrange(5, 80)].strip()))
    quotes += [("n", None), ("e", ""), ("last", "the very end"), ("one", "x" * 12), ("two", "ard " + "y" * 12)]
    got = textmatch.quotes_in_texts(
        spark.createDataFrame(quotes, "q string, text string"),
        spark.createDataFrame(texts, "d long, text string").repartition(3), "q", "d",
    ).collect()
    plain = {d: " ".join((t or "").split()) for d, t in texts}
    want = {
        (q, d, text.index(form))
        for q, t in quotes if t for form in [" ".join(t.split())] if len(form) >= 10
        for d, text in plain.items() if form in text
    }
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 40


def test_runs_leave_a_text_only_if_asked_for(spark):
    texts = spark.createDataFrame(
        [(k, " ".join(f"w{k}n{i}" for i in range(400)) + " the old clock tower") for k in range(50)], "d long, text string"
    )
    leads = textmatch._hashed(spark.createDataFrame([("old clock", 2)], "_text string, _words int"), "_text")
    found = textmatch.found_runs(texts, "d", "text", leads)
    assert found.join(leads, "_run").select("d").distinct().count() == 50
    # 20,050 runs of two words; by chance a bit of 65,536 agrees now and then.
    assert found.count() < 60
    assert textmatch.found_runs(texts, "d", "text", leads.limit(0)).count() == 0


def test_equal_spans_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"ab cd ab cdab cd", np.uint8)
    h = textmatch._hash_spans(data, np.array([0, 6, 11, 3]), np.array([5, 11, 16, 8]))
    assert h[0] == h[1] == h[2] != h[3]
