"""Block-wise grouping equals the pass over everything, whatever the size of a block."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from toponet.plans import blocks, grouping, promotion


@pytest.fixture(params=[25, 20_000])
def size(request, monkeypatch):
    """Blocks that cut the larger components in a few pieces, and none at all."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", request.param)


def metres(a, b):
    (lat1, lng1), (lat2, lng2) = (map(math.radians, x) for x in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return math.floor(2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) + 0.5)


def test_greedy_groups_in_blocks(spark, size):
    rng = random.Random(6)
    edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)} | {(k, k + 1) for k in range(100, 130)})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    df = spark.createDataFrame(edges, "a long, b long")
    for every in (True, False):
        groups = []
        for n in sorted(near):
            home = next((g for g in groups if (all if every else any)(m in near[n] for m in g)), None)
            groups.append([n]) if home is None else home.append(n)
        want = {n: g[0] for g in groups for n in g}
        assert {r.node: r.grp for r in grouping.greedy_groups(df, every).collect()} == want


def test_long_chain_needs_few_rounds(spark, monkeypatch):
    """200,000 nodes in a line, each linked to the one before: pairs, in ten rounds of bounded size."""
    seen = []
    whole = blocks.grouped_map

    def watched(df, *rest):
        seen.append(df.filter(F.col("kind") == 0).count())
        return whole(df, *rest)

    monkeypatch.setattr(blocks, "grouped_map", watched)
    n = 200_000
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    comps = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    got = blocks.greedy(edges, comps, every=True)
    assert got.count() == n and got.filter(F.col("grp") != F.col("node") - F.col("node") % 2).count() == 0
    assert len(seen) == 10 and max(seen) == blocks.BLOCK_ROWS


NAMES = ["bar", "bar blue", "bar blue door", "blue door", "old bar", "red", "red lion", "red lion inn", ""]


def spots(seed, count):
    """Names on a few dozen crowded points of one street."""
    rng = random.Random(seed)
    places = [(51.5 + rng.randrange(12) * 0.00012, rng.randrange(4) * 0.00003) for _ in range(25)]
    return [(k, rng.choice(NAMES), *rng.choice(places)) for k in range(count)]


def test_same_spots_in_blocks(spark, size):
    rows = [(f"s:{k:012d}", name, lat, lng) for k, name, lat, lng in spots(1, 90)]

    def alike(a, b):
        far = metres(a[2:], b[2:])
        short, long = sorted((a[1], b[1]), key=len)
        return far <= 5 or far <= 40 and bool(short) and (short == long or long.startswith(short + " "))

    first = {}
    for row in rows:
        first.setdefault(row[1:], row)
    groups = []
    for row in sorted(first.values()):
        home = next((g for g in groups if all(alike(m, row) for m in g)), None)
        groups.append([row]) if home is None else home.append(row)
    want = {m[1:]: g[0][0] for g in groups for m in g}
    got = grouping.spot_groups(spark.createDataFrame(rows, "stop_id string, name string, lat double, lng double"))
    assert {r.stop_id: r.spot_id for r in got.collect()} == {r[0]: want[r[1:]] for r in rows}
    assert len(set(want.values())) < len(first)


def fits(one, two, long_prefix):
    if not one or not two:
        return False
    x, y = one.split(" "), two.split(" ")
    short, long = (one, two) if len(x) <= len(y) else (two, one)
    if one == two or abs(len(x) - len(y)) <= 1 and (long.endswith(short) or long.startswith(short)):
        return True
    short, long = sorted((one, two), key=len)
    return long_prefix and len(short.split(" ")) >= 2 and long.startswith(short + " ")


def one_pass(rows, radius, long_prefix, better):
    groups, out = [], {}
    seen = {}
    for k, name, lat, lng in rows:
        if (name, lat, lng) in seen:
            out[k] = seen[name, lat, lng]
            continue
        home = next(
            (g for g in groups if metres(g[1], (lat, lng)) <= radius and fits(name, g[2], long_prefix)), None
        )
        if home is None:
            home = [k, (lat, lng), name]
            groups.append(home)
        elif better(name, home[2]):
            home[2] = name
        out[k] = seen[name, lat, lng] = home[0]
    return out


def test_answers_in_blocks(spark, size):
    rng = random.Random(3)
    rows = [(k, rng.choice(NAMES), 10 + rng.randrange(40) * 0.0005, 0.0) for k in range(90)]
    got = grouping.answer_groups(spark.createDataFrame(rows, "point_id long, name string, lat double, lng double"))
    want = one_pass(rows, 150, True, lambda a, b: len(a) < len(b))
    assert {r.point_id: r.group_id for r in got.collect()} == want


def test_promotion_groups_in_blocks(spark, size):
    rows = [(k, name or "x", lat, lng, None) for k, name, lat, lng in spots(2, 90)]
    frame = spark.createDataFrame(
        rows, "id long, place_name string, lat double, lng double, wikidata_id string"
    )
    got = {r.id: r.group_id for r in promotion.promotion_groups(frame).collect()}
    want = one_pass([r[:4] for r in rows], 40, False, lambda a, b: (len(a), a) < (len(b), b))
    assert got == want


def test_names_say_what_all_their_keys_allow():
    rng = random.Random(4)
    keys = [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(30)] + [""]
    for _ in range(400):
        held = [rng.choice(keys) for _ in range(rng.randrange(1, 5))]
        said = blocks.Names.of(held[0])
        for key in held[1:]:
            said.add(key)
        for key in keys:
            want = all(key and x and (blocks.goes_on(key, x) or blocks.goes_on(x, key)) for x in held)
            assert said.fits(key) == bool(want), (held, key)
