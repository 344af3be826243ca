"""Scalar functions on the cases the sources' own rules were written for."""

import unicodedata

from pyspark.sql import functions as F

from toponet.functions import evidence, facts, fold, geo, phrases, ratings

c = F.col


def values(spark, column, rows, schema="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_folding(spark):
    rows = ["Amélie", "ﬁnal ½ ＡＢ", "Straße", "Ⅳ Ångström", "한국 2", None]
    assert values(spark, fold.normalize_title(c("a")), rows)[:4] == [
        "amelie", "final 1 2 ab", "stra e", "iv angstrom",
    ]
    names = values(spark, fold.normalize_name(c("a")), rows)
    assert names[2] == "straße" and names[4] == unicodedata.normalize("NFKD", "한국 2") and names[5] is None


def test_names_match(spark):
    pairs = [
        ("union station", "union station"), ("union station", "old union station"),
        ("union", "old union station"), ("", "x"), ("old bridge", "bold bridge"),
    ]
    got = values(spark, fold.names_match(c("a"), c("b")), pairs, "a string, b string")
    assert got == [True, True, False, False, True]


def test_phrase_split(spark):
    rows = [
        "The Old Royal Naval College, Greenwich, London SE10", "corner of Main Street",
        "A40", "the bridge", "Café Royal in London, W1", "King's Head at the corner of Elm Road",
    ]
    got = values(spark, phrases.split_phrase(c("a")), rows)
    assert got[0].head == "Old Royal Naval College" and got[0].areas == ["Greenwich", "London"]
    assert got[2].refusal == "road_is_a_line_not_a_point"
    assert got[3].refusal == "head_is_a_common_noun"
    assert got[5].head == "King's Head"


def test_scene_note(spark):
    rows = [
        ("Vertigo film location: Scottie's home: 900 Lombard Street", "900 Lombard Street"),
        ("They meet here. Source: IMDb.", "Town Hall"), ("Town Hall", "Town Hall"), (None, "x"),
    ]
    got = values(spark, phrases.scene_note(c("a"), c("b")), rows, "a string, b string")
    assert got == ["Scottie's home", "They meet here", None, None]


def test_claim_sentence(spark):
    text = "Built in 1900 by a guild of masons from the county. The Third Man was filmed here in 1948 for weeks. It closed."
    at = text.index("Third")
    got = values(spark, phrases.claim_sentence(c("a"), F.lit(at)), [text])
    assert got == ["The Third Man was filmed here in 1948 for weeks."]


def test_role_evidence_and_plans(spark):
    rows = ["It was filmed in Rome.", "It may be filmed in Rome.", "A quiet street."]
    got = values(spark, phrases.supports_role(c("a"), F.lit("filming_location")), rows)
    assert got == [True, False, False]


def test_wikitext(spark):
    text = "'''Bold''' [[File:x.jpg|thumb|[[A]] b]] [[Rome|the city]]<ref>r</ref> {{cite|{{x}}}} end"
    assert values(spark, phrases.clean_wikitext(c("a")), [text]) == ["Bold the city end"]


def test_marks_that_cross_or_stay_open(spark):
    five = "'" * 5
    rows = {
        "a {{b [[c}} d]] e": "a d]] e", "a {{ b": "a {{ b", "a ]] b": "a ]] b", "x <!-- {{ <ref> --> y": "x y",
        "<ref name=a/>k<REF>l</REF>m<br/>n": "k m n", "{| t\n| {{q|}}\n|} after": "after",
        "[[File:a.jpg|[[b]] {{c}}]]z [[Image|view]]": "z view", "== One ==\ntext": "One.\n\ntext",
        f"<blockquote>said <b>x</b></blockquote> {five}both{five} [http://x.org y]": "both [http://x.org y]",
    }
    got = values(spark, phrases.clean_wikitext(c("a")), list(rows))
    assert dict(zip(rows, got)) == rows


def test_deeply_nested_markup_goes(spark):
    file, template = "[[A]] b", "x"
    for k in range(12):
        file, template = f"[[File:{k}.jpg|thumb|{file}]]", f"{{{{t{k}|{template}}}}}"
    assert values(spark, phrases.clean_wikitext(c("a")), [f"one {file} two {template} three", None]) == ["one two three", ""]


def test_scores(spark):
    rows = ["8.8/10", "92%", "61/100", "n/a", "12/0", "120%"]
    assert values(spark, ratings.normalize_score(c("a")), rows) == [88.0, 92.0, 61.0, None, None, None]


def test_confidence_fusion(spark):
    rows = [("wikidata_statement", None, True), ("text_mention", None, None), ("made_up", 1.0, True)]
    df = spark.createDataFrame(rows, "method string, weight double, agrees boolean")
    got = evidence.fused_confidence(c("method"), c("weight"), c("agrees"))
    row = df.agg(got["confidence"].alias("c"), got["supporting"].alias("s")).first()
    assert (row.c, row.s) == (0.95, 2)
    certain = spark.createDataFrame([("manual_fix", 1.0, True)] * 2, df.schema)
    assert certain.agg(got["confidence"].alias("c")).first().c == 1.0
    against = spark.createDataFrame([("manual_fix", None, False)], df.schema)
    assert against.agg(got["confidence"].alias("c")).first().c == 0.0


def test_precision_words(spark):
    rows = ["railway station", "city hall in Vienna", "island in Greece", "", "sovereign state"]
    got = values(spark, evidence.precision_from_type(c("a")), rows)
    assert got == ["building", "building", "region", "unknown", "country"]


def test_rounding_and_viewport(spark):
    got = values(spark, geo.half_up(c("a")), [-1.5, -0.5, 0.5, 2.5], "a double")
    assert got == [-1.0, 0.0, 1.0, 3.0]
    inside = geo.in_viewport(c("a"), c("b"), 170.0, 10.0, -170.0, -10.0)
    rows = [(0.0, 175.0), (0.0, -175.0), (0.0, 0.0), (20.0, 175.0)]
    assert values(spark, inside, rows, "a double, b double") == [True, True, False, False]


def test_fact_sentence(spark):
    none = F.lit(None).cast("string")
    got = facts.fact_sentence(
        F.lit("lived_here"), c("a"), F.lit("Rome"), none, F.lit(1920), none
    )
    assert values(spark, got, ["Ann"]) == ["Ann lived at Rome (1920)."]


def test_area_contradiction(spark):
    from toponet.operators.matching import contradicts_area

    rows = [
        ("London", "Canada", ["Ontario", "Canada"], "London, England"),
        ("Wildwood", "United States", ["Ventura County", "California", "United States"], "California"),
        ("Springfield", "United States", ["Oregon", "Lane County"], "Kent, Ohio"),
        ("Tbilisi", "Georgia", ["Georgia", "Caucasus"], "Georgia"),
    ]
    got = values(
        spark, contradicts_area(c("n"), c("k"), c("ch"), c("h")), rows,
        "n string, k string, ch array<string>, h string",
    )
    assert got == [True, False, True, False]
