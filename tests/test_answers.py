from toponet.operators import answers


def test_a_claim_that_repeats_a_refused_one_is_accepted(spark):
    # Alpha at 0 m, Beta 40 m on, Gamma 80 m on, and another Beta 550 m away.
    step = 1 / 111320.0
    claims = spark.createDataFrame(
        [
            (1, 1, "Alpha", 10.0, 20.0, None), (2, 1, "Beta", 10.0 + 40 * step, 20.0, None),
            (3, 1, "Gamma", 10.0 + 80 * step, 20.0, None), (4, 1, "Beta", 10.0 + 550 * step, 20.0, None),
            (5, 1, "Delta", 10.0 + 550 * step, 20.0, None), (6, 1, "Far", 11.0, 20.0, None),
        ],
        "id long, anchor_id long, name string, lat double, lng double, wikidata_id string",
    )
    anchors = spark.createDataFrame([(1, 10.0, 20.0, 5.0)], "anchor_id long, lat double, lng double, radius_km double")
    got = {r.id: r.reason for r in answers.accept_located(claims, claims.limit(0), anchors).collect()}
    again = "repeats_an_accepted_claim"
    assert got == {1: None, 2: again, 3: None, 4: None, 5: again, 6: "outside_city"}
