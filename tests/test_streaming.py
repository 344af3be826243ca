"""Streams give the same answers as the batch side."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from toponet.operators import visits
from toponet.streaming import positions

c = F.col
FIX = "fix_id long, user_id long, ts timestamp, lat double, lng double, accuracy_m double"


def setup_rows():
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1, 8)
    fixes = [
        (i, i % 3, start + dt.timedelta(seconds=20 * i), 10 + rng.uniform(0, 0.001), 20 + rng.uniform(0, 0.001),
         rng.choice([5.0, 30.0, 200.0]))
        for i in range(300)
    ]
    places = [(p, 10 + rng.uniform(0, 0.001), 20 + rng.uniform(0, 0.001), p % 2 == 0, p) for p in range(12)]
    return fixes, places


def stream_of(spark, fixes):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame(fixes, FIX)
    for part in range(3):
        df.filter((c("fix_id") >= part * 100) & (c("fix_id") < part * 100 + 100)).coalesce(1).write.mode(
            "append"
        ).parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(spark, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    ).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch(spark):
    fixes, places = setup_rows()
    batch = spark.createDataFrame(fixes, FIX)
    spots = spark.createDataFrame(places, "place_id long, lat double, lng double, checked boolean, work_count long")
    src = stream_of(spark, fixes)

    fired = drain(spark, positions.geofence(positions.hits(src, spots, 45.0)), "fired")
    want = visits.fire_once(visits.fence_hits(batch, spots, 45.0))
    key = ["user_id", "place_id", "fix_id"]
    assert sorted(fired.select(key).collect()) == sorted(want.select(key).collect())
    assert fired.select("user_id", "place_id").distinct().count() == fired.count()

    moved = drain(spark, positions.movement(src), "moved")
    assert sorted(r.fix_id for r in moved.collect()) == sorted(
        r.fix_id for r in visits.movement_gate(batch).collect()
    )

    extra = ["checked", "work_count"]
    told = drain(spark, positions.ambient(positions.hits(src, spots, 45.0, extra)), "told")
    want = visits.ambient_picks(visits.fence_hits(batch, spots, 45.0, extra))
    assert sorted(told.select(key).collect()) == sorted(want.select(key).collect())

    seen = drain(spark, positions.check_ins(src, spots), "seen")
    pair = ["user_id", "place_id"]
    assert sorted(seen.select(pair).collect()) == sorted(visits.check_ins(batch, spots).select(pair).collect())


def test_windows_close_after_the_watermark(spark):
    fixes, _ = setup_rows()
    src = stream_of(spark, fixes).select("ts", "user_id", c("user_id").cast("string").alias("place_key"))
    got = drain(spark, positions.windowed_visits(src, "10 minutes"), "wins").collect()
    rows = {}
    for f in fixes:
        start = f[2].replace(minute=f[2].minute // 10 * 10, second=0)
        rows[(str(f[1]), start)] = rows.get((str(f[1]), start), 0) + 1
    assert got and all(rows[(r.place_key, r.w.start)] == r.visits for r in got)


def test_check_in_results(spark):
    rows = [(10.0, 5.0, False), (200.0, 5.0, False), (10.0, 500.0, False), (10.0, 5.0, True), (None, None, False)]
    df = spark.createDataFrame(rows, "m double, a double, v boolean")
    got = [r[0] for r in df.select(visits.check_in_result(c("m"), c("a"), c("v"))).collect()]
    assert got == ["checked_in", "too_far", "too_vague", "already_visited", "no_position"]
