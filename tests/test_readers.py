"""File readers on small files: quoting, marks, missing values, bad rows."""

import gzip

from toponet.sources import readers


def test_ratings_dump(spark, tmp_path):
    path = tmp_path / "ratings.tsv.gz"
    path.write_bytes(gzip.compress(b"tconst\taverageRating\tnumVotes\ntt0000001\t5.7\t1988\ntt0000002\t\\N\t5\n"))
    got = [tuple(r) for r in readers.read_ratings_dump(spark, str(path)).collect()]
    assert got[0][0] == "tt0000001" and float(got[0][1]) == 5.7 and int(got[0][2]) == 1988 and got[1][1] is None


def test_harvest_counts_bad_rows(spark, tmp_path):
    path = tmp_path / "harvest.ndjson"
    path.write_text(
        '{"id": "1", "name": "Mill", "lat": 1.5, "lng": 2.5, "appearances": [{"movie_id": "7", "frames": []}]}\n{"id": broken\n'
    )
    rows = readers.read_harvest(spark, str(path)).cache()
    assert rows.filter("_corrupt_record is not null").count() == 1
    got = readers.appearances(rows.filter("_corrupt_record is null")).collect()
    assert [(r.name, r.movie_id, r.frames) for r in got] == [("Mill", "7", 0)]
    details = spark.createDataFrame([(got[0].location_id, "7", "x")], "location_id string, movie_id string, note string")
    assert readers.with_detail(readers.appearances(rows.filter("_corrupt_record is null")), details).first().note == "x"


def test_library_with_mark_and_quoted_lines(spark, tmp_path):
    path = tmp_path / "library.csv"
    path.write_bytes('﻿Name,Year,Rating\n"Two\nLines, ""quoted""",1999,4\n,2000,3\n'.encode())
    got = readers.read_library(spark, str(path), "letterboxd").collect()
    assert any((r.title or "").startswith("Two") and r.year == 1999 for r in got)
