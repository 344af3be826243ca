"""Cell joins against brute force, also near the poles and the date line."""

import math
import random

from pyspark.sql import functions as F

from toponet.operators import spatial
from toponet.plans import grouping

c = F.col


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def cloud(seed, n):
    rng = random.Random(seed)
    homes = [(0.0, 0.0), (60.0, 179.9999), (-59.9999, -179.9998), (88.0, 10.0), (10.0, -180.0), (45.0, 180.0)]
    return [
        (i, h[0] + rng.uniform(-0.003, 0.003), max(-180.0, min(180.0, h[1] + rng.uniform(-0.004, 0.004))))
        for i in range(n)
        for h in [homes[i % len(homes)]]
    ]


def test_radius_join_is_exact(spark):
    pts = cloud(1, 240)
    wrap = [(i + 1000, lat, -lng) for i, lat, lng in pts[:60]]
    df = spark.createDataFrame(pts + wrap, "id long, lat double, lng double")
    a = df.select(c("id").alias("a"), c("lat").alias("a_lat"), c("lng").alias("a_lng"))
    got = spatial.within_radius(a, df, 150.0, 150.0, spatial.great_circle())
    mine = {(r.a, r.id) for r in got.select("a", "id").collect()}
    rows = pts + wrap
    want = {(x[0], y[0]) for x in rows for y in rows if metres(x[1:], y[1:]) <= 150.0}
    assert mine == want and got.count() == len(want)


def test_nearest_is_exact(spark):
    pts = cloud(2, 120)
    df = spark.createDataFrame(pts, "pid long, lat double, lng double")
    origins = [(1, 0.0, 0.0), (2, 59.0, -179.0), (3, -80.0, 20.0)]
    o = spark.createDataFrame(origins, "oid long, a_lat double, a_lng double")
    got = spatial.nearest_k(o, "oid", df, "pid", 4).collect()
    for oid, lat, lng in origins:
        want = sorted((metres((lat, lng), p[1:]), p[0]) for p in pts)[:4]
        mine = sorted((r["rank"], r.pid) for r in got if r.oid == oid)
        assert [p for _, p in mine] == [p for _, p in want]


def test_polygon_and_centroid(spark):
    ring = [(0.0, 0.0), (0.0, 0.01), (0.01, 0.01), (0.01, 0.0)]
    rows = [(1, i, lat, lng) for i, (lat, lng) in enumerate(ring)]
    v = spark.createDataFrame(rows, "lot long, i int, lat double, lng double")
    lots = spatial.polygons(v, "lot", "i")
    p = spark.createDataFrame([(1, 0.005, 0.005), (2, 0.02, 0.005)], "id long, lat double, lng double")
    assert [r.id for r in spatial.points_in_polygons(p, "id", lots, "lot").collect()] == [1]
    centre = lots.select(spatial.ring_centroid(c("ring")).alias("c")).first().c
    assert abs(centre.lat - 0.005) < 1e-9 and abs(centre.lng - 0.005) < 1e-9


def py_match(a, b):
    x, y = a.split(" "), b.split(" ")
    s, l = (a, b) if len(x) <= len(y) else (b, a)
    return bool(a and b) and (a == b or (abs(len(x) - len(y)) <= 1 and (l.endswith(s) or l.startswith(s))))


def test_near_named_pairs_are_exact(spark):
    rng = random.Random(3)
    names = ["a", "ba", "old bridge", "bold bridge", "the old bridge", "old bridge inn", "x y z", "y z", "z"]
    rows = [(i, rng.choice(names), rng.uniform(0, 0.0009), rng.uniform(0, 0.0009)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, name string, lat double, lng double")
    a = df.select(c("id").alias("a_id"), c("name").alias("a_name"), c("lat").alias("a_lat"), c("lng").alias("a_lng"))
    got = {(r.a_id, r.id) for r in spatial.near_named_pairs(a, df, 40.0).collect()}
    want = {
        (x[0], y[0]) for x in rows for y in rows
        if py_match(x[1], y[1]) and math.floor(metres(x[2:], y[2:]) + 0.5) <= 40
    }
    assert got == want


def test_components_and_greedy(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)} | {(100, i) for i in range(101, 130)}
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    got = {r.node: r.component for r in grouping.components(df).collect()}
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in parent}
    near = {n: set() for n in parent}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for every in (True, False):
        groups = []
        for n in sorted(near):
            test = all if every else any
            home = next((g for g in groups if test(m in near[n] for m in g)), None)
            groups.append([n]) if home is None else home.append(n)
        want = {n: g[0] for g in groups for n in g}
        mine = {r.node: r.grp for r in grouping.greedy_groups(df, every).collect()}
        assert mine == want


def test_place_groups_hold_pairwise_and_survive_reordering(spark):
    rows = [
        (1, "Q1", "Café Royal", 10.0, 10.0, "real_exterior", "point", 0.5, "verified"),
        (2, None, "Cafe Royal", 10.0002, 10.0, "real_exterior", "point", 0.9, "verified"),
        (3, "Q2", "Café Royal", 10.0003, 10.0, "real_exterior", "point", 0.9, "verified"),
        (4, None, "Cafe Royal", 10.0, 10.0, "real_exterior", "city", 0.9, "verified"),
        (5, None, "Cafe Royal", 10.0, 10.0, "real_exterior", "city", 0.9, "verified"),
        (6, None, "Old Cafe Royal", 10.0001, 10.0, "real_exterior", "point", 0.9, "verified"),
    ]
    schema = "place_id long, wikidata_id string, name string, lat double, lng double, place_class string, geocode_precision string, confidence double, status string"
    for order in (rows, rows[::-1]):
        got = {r.place_id: r.group_id for r in grouping.place_groups(spark.createDataFrame(order, schema)).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1}
    groups = grouping.place_groups(spark.createDataFrame(rows, schema))
    links = spark.createDataFrame([(7, 1), (7, 2), (8, 6)], "work_id long, place_id long")
    kept = {r.group_id: r for r in grouping.surviving_places(groups, links).collect()}
    assert kept[1].place_id == 1 and kept[1].merged_count == 3 and kept[1].works == 2


def test_named_join_sends_no_grown_side_through_the_driver(spark):
    names = spark.createDataFrame(
        [(i, "union station of the old town", 10.0 + i / 1e4, 20.0) for i in range(50)],
        "id long, name string, lat double, lng double",
    )
    a = names.select(c("id").alias("a_id"), c("name").alias("a_name"), c("lat").alias("a_lat"), c("lng").alias("a_lng"))
    plan = spatial.near_named_pairs(a, names, 40.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
