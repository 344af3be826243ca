"""Order-dependent grouping of components of any size, block by block.

A rule that puts each row into the first group that fits depends on all earlier rows of its
component. Rows are ranked inside their component and cut into blocks of ``BLOCK_ROWS``; round
k decides the k-th block of every component at once. A task holds one block: its rows, the
links among them, and of the groups made before only those that a row of the block is linked
to. So most components are done in one round, a long chain takes its length over the block
size, and no task ever holds a component.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.grouped import grouped_map
from ..operators.numbering import group_ranks
from ..session import cut_lineage, snapshot

c = F.col

#: Rows of a component that one task decides at once.
BLOCK_ROWS = 20_000


def number_blocks(nodes: DataFrame, bucket: Column, size: int | None = None) -> DataFrame:
    """``nodes`` (node, component, ...) with ``block``; ``bucket`` is a coarse form of ``node``."""
    size = size or BLOCK_ROWS
    large = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") > size).select("component")
    few = nodes.join(large, "component", "left_anti").withColumn("block", F.lit(0))
    many = group_ranks(
        nodes.join(large, "component", "left_semi"), ["component"], [c("node")], bucket, "_rank"
    )
    return cut_lineage(
        few.unionByName(many.withColumn("block", F.floor((c("_rank") - 1) / size).cast("int")).drop("_rank"))
    )


def by_blocks(nodes: DataFrame, step: Callable[[DataFrame, int, DataFrame | None], DataFrame]) -> DataFrame:
    """What ``step(rows of block k, k, results so far)`` yields for all blocks."""
    last = nodes.agg(F.max("block")).first()[0] or 0
    done = None
    for k in range(last + 1):
        made = cut_lineage(step(nodes.filter(c("block") == k), k, done))
        done = made if done is None else done.unionByName(made)
    return done


def _linked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, v, v_block, u, u_block) of every edge, ``v`` the later node."""
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter(
        c("v") != c("u")
    ).distinct()
    later = nodes.select(c("node").alias("v"), "component", c("block").alias("v_block"))
    earlier = nodes.select(c("node").alias("u"), c("block").alias("u_block"))
    return cut_lineage(pairs.join(later, "v").join(earlier, "u"))


def greedy(edges: DataFrame, comps: DataFrame, every: bool, size: int | None = None) -> DataFrame:
    """(node, grp): each node joins the first group in which every (or any) member is its neighbour.

    ``comps`` gives (node, component) of the edges (a, b); a group is named by its first node.
    A group made in an earlier block travels as one row per node that it is linked to, with
    the number of its members and of those that are neighbours.
    """
    nodes = number_blocks(comps, F.floor(c("node") / 4096), size)
    links = _linked(edges, nodes)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list] = {}
        held: dict[int, dict] = {}
        members: dict[int, int] = {}
        for kind, a, b, n, of in zip(pdf["kind"], pdf["a"], pdf["b"], pdf["n"], pdf["members"]):
            if kind == 1:
                near.setdefault(a, []).append(b)
            elif kind == 2:
                held.setdefault(a, {})[b] = n
                members[b] = of
        group_of: dict[int, int] = {}
        for node in sorted(pdf["a"][pdf["kind"] == 0]):
            known = dict(held.get(node, ()))
            for other in near.get(node, ()):
                known[group_of[other]] = known.get(group_of[other], 0) + 1
            fits = [g for g, n in known.items() if not every or n == members[g]]
            group = min(fits, default=node)
            group_of[node] = group
            members[group] = members.get(group, 0) + 1
        return pd.DataFrame({"node": list(group_of), "grp": list(group_of.values())}, dtype="int64")

    def step(part: DataFrame, k: int, done: DataFrame | None) -> DataFrame:
        zero = F.lit(0).cast("long")

        def row(kind: int, a: Column, b: Column, n: Column = zero, members: Column = zero) -> list[Column]:
            return [
                "component", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), n.alias("n"),
                members.alias("members"),
            ]

        mine = links.filter(c("v_block") == k)
        rows = part.select(*row(0, c("node"), c("node"))).unionByName(
            mine.filter(c("u_block") == k).select(*row(1, c("v"), c("u")))
        )
        if done is not None:
            linked = mine.filter(c("u_block") < k).join(done.withColumnRenamed("node", "u"), "u").groupBy(
                "component", "v", "grp"
            ).agg(F.count(F.lit(1)).alias("n"))
            sizes = done.groupBy("grp").agg(F.count(F.lit(1)).alias("of"))
            rows = rows.unionByName(linked.join(sizes, "grp").select(*row(2, c("v"), c("grp"), c("n"), c("of"))))
        return grouped_map(rows, "component", assign, "node long, grp long")

    return by_blocks(nodes, step)


def whole_metres(lat1: float, lng1: float, lat2: float, lng2: float) -> int:
    """Great-circle metres between points in radians, halves up."""
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return math.floor(2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) + 0.5)


def _placed() -> Column:
    """Whether a shape has a key and a point."""
    fine = (c("key") != "") & (F.abs("lat") < 1e6) & (F.abs("lng") < 1e6)
    return F.coalesce(fine, F.lit(False))


def alike_cells(shapes: DataFrame, reach_m: float, alike: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """``shapes`` with ``spot``, a number of their cell and key, and the pairs (a, b) of spots that may be alike.

    Shapes within ``reach_m`` whose keys are ``alike`` (the shorter first, which begins or ends the longer)
    have one spot or a pair of them. Spots of a crowded street are few, its pairs of shapes are not.
    """
    size = reach_m + 1.0
    cell = spatial.cell_of(c("lat"), c("lng"), size)
    shapes = shapes.withColumn("_cell", cell).withColumn("spot", F.xxhash64("_cell", "key"))
    named = shapes.filter(_placed())
    around = named.select(
        c("spot").alias("a"), c("key").alias("a_key"),
        F.explode(spatial.cover(c("lat"), c("lng"), F.lit(size), size)).alias("_cell"),
    ).distinct()
    spots = named.select(c("spot").alias("b"), "key", "_cell").distinct()
    short = around.withColumn("_key", F.explode(spatial._affix_keys(c("a_key"), "es", False)))
    long = spots.withColumn("_key", F.explode(spatial._affix_keys(c("key"), "es", True)))
    pairs = spatial.shuffled(short).join(spatial.shuffled(long), ["_cell", "_key"]).filter(
        (c("a") != c("b")) & (c("key").startswith(c("a_key")) | c("key").endswith(c("a_key")))
        & alike(c("a_key"), c("key"))
    )
    return shapes.drop("_cell"), pairs.select("a", "b").distinct()


class Near:
    """Groups by where their first point is and by the key of their present name.

    A group is listed in the 27 cubes around its point, so whatever lies within the radius is found in
    one cube, at the date line and the poles too; of a cube only the keys that fit are looked at.
    """

    def __init__(self, radius_m: float, fits: Callable[[str, str], bool], keys: set[str]):
        self.radius_m, self.fits, self.side = radius_m, fits, radius_m + 1.0
        self.keys, self.cubes, self.groups = keys, {}, {}
        self.alike: dict[str, set[str]] = {}
        # A key that fits another begins or ends it.
        for key in keys:
            for n in range(1, len(key) + 1):
                for piece in (key[:n], key[-n:]):
                    if piece in keys:
                        self.alike.setdefault(key, set()).add(piece)
                        self.alike.setdefault(piece, set()).add(key)

    def cube(self, lat: float, lng: float) -> tuple[int, int, int]:
        flat = 6371000.0 * math.cos(lat)
        at = flat * math.cos(lng), flat * math.sin(lng), 6371000.0 * math.sin(lat)
        return tuple(math.floor(x / self.side) for x in at)

    def _lists(self, lat: float, lng: float) -> list[dict]:
        x, y, z = self.cube(lat, lng)
        return [
            self.cubes.setdefault((x + i, y + j, z + k), {}) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)
        ]

    def put(self, group: int, name: str, key: str, lat: float, lng: float) -> None:
        self.groups[group] = [name, key, lat, lng]
        for here in self._lists(lat, lng):
            here.setdefault(key, []).append(group)

    def rename(self, group: int, name: str, key: str) -> None:
        _, old, lat, lng = said = self.groups[group]
        said[:2] = name, key
        if key != old:
            for here in self._lists(lat, lng):
                here[old].remove(group)
                if not here[old]:
                    del here[old]
                here.setdefault(key, []).append(group)

    def first(self, key: str, lat: float, lng: float) -> int | None:
        """The smallest group near enough whose key fits."""
        here, alike = self.cubes.get(self.cube(lat, lng)), self.alike.get(key, ())
        best = None
        for one in (x for x in list(here) if x in alike) if here and len(here) < len(alike) else alike:
            there = here and here.get(one)
            if there and self.fits(key, one):
                for group in there:
                    if (best is None or group < best) and whole_metres(*self.groups[group][2:], lat, lng) <= self.radius_m:
                        best = group
        return best


def first_fit(
    shapes: DataFrame, radius_m: float, alike: Callable[[Column, Column], Column],
    fits: Callable[[str, str], bool], better: Callable[[str, str], bool], size: int | None = None,
) -> DataFrame:
    """(node, grp): each shape joins the first group whose first point is near and whose name fits.

    ``shapes``: node, name, key, lat, lng. A group is known by its first shape, and named by
    the name that is ``better`` than all before. ``fits`` compares the keys of two names, the
    shape's first; ``alike`` is the same on columns. A group's name is a member's, so a shape only
    meets groups with a member within twice the radius whose key fits. Shapes that can meet so are
    joined over spots (``alike_cells``): pairs of shapes are never made, which a crowded street has by the million.
    """
    from .grouping import components

    spotted, pairs = alike_cells(shapes, 2 * radius_m, alike)
    pairs = cut_lineage(pairs)
    comps = components(pairs)
    spotted = spotted.join(comps.withColumnRenamed("node", "spot"), "spot", "left")
    spotted = snapshot(spotted.withColumn("component", F.coalesce("component", "spot")))
    # A shape that no other can meet is its own group, and so is one without a key or a point.
    sizes = spotted.filter(_placed()).groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    met = sizes.filter(c("_n") > 1).select("component")
    state = ["name", "key", "lat", "lng"]
    nodes = number_blocks(
        spotted.filter(_placed()).join(met, "component", "left_semi"), F.floor(c("node") / 4096), size
    )
    both = pairs.unionByName(pairs.select(c("b").alias("a"), c("a").alias("b")))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        round_ = int(pdf["k"].iloc[0])
        near = Near(radius_m, fits, set(pdf["key"]))
        columns = [pdf["kind"], pdf["node"], pdf["name"], pdf["key"], np.radians(pdf["lat"]), np.radians(pdf["lng"])]
        rows = sorted(zip(*(x.tolist() for x in columns), pdf["lat"].tolist(), pdf["lng"].tolist()), key=lambda x: x[1])
        points = {}
        for kind, node, name, key, lat, lng, *point in rows:
            if kind == 3:
                near.put(node, name, key, lat, lng)
                points[node] = point
        out, touched = [], set()
        for kind, node, name, key, lat, lng, *point in rows:
            if kind == 3:
                continue
            home = near.first(key, lat, lng)
            if home is None:
                home = node
                near.put(node, name, key, lat, lng)
                points[node] = point
                touched.add(home)
            elif better(name, near.groups[home][0]):
                near.rename(home, name, key)
                touched.add(home)
            out.append((0, node, home, 0, None, None, None, None))
        out += [(3, g, g, round_, *near.groups[g][:2], *points[g]) for g in touched]
        return pd.DataFrame(out, columns=["kind", "node", "grp", "k", *state])

    def step(part: DataFrame, k: int, done: DataFrame | None) -> DataFrame:
        def row(kind: int) -> list:
            return ["component", F.lit(kind).alias("kind"), "node", *state, F.lit(k).alias("k")]

        rows = part.select(*row(0))
        if done is not None:
            asked = part.select("component", c("spot").alias("a")).distinct()
            asked = asked.unionByName(asked.join(both, "a").select("component", c("b").alias("a"))).distinct()
            held = done.filter(c("kind") == 0).join(nodes.select("node", "spot"), "node").select(
                c("spot").alias("a"), "grp"
            ).distinct()
            carried = asked.join(held, "a").select("component", "grp").distinct()
            latest = done.filter(c("kind") == 3).groupBy("grp").agg(F.max_by(F.struct(*state), "k").alias("s"))
            known = carried.join(latest, "grp").select("component", c("grp").alias("node"), "s.*")
            rows = rows.unionByName(known.select(*row(3)))
        return grouped_map(
            rows, "component", assign,
            "kind int, node long, grp long, k int, name string, key string, lat double, lng double",
        )

    grouped = by_blocks(nodes, step).filter(c("kind") == 0).select("node", "grp")
    alone = spotted.filter(_placed()).join(met, "component", "left_anti").unionByName(spotted.filter(~_placed()))
    return grouped.unionByName(alone.select("node", c("node").alias("grp")))


class Names:
    """What all the keys said at one point allow: a key fits if it goes on after each of them or they after it.

    Keys of which one always goes on after the other are a chain, and its longest key decides.
    Once two part, a key fits up to the words before the first parting only. An empty key fits nothing.
    """

    CHAIN, PARTED, NEVER = range(3)

    def __init__(self, kind: int, text: str):
        self.kind, self.text = kind, text

    @classmethod
    def of(cls, key: str) -> "Names":
        return cls(cls.CHAIN if key else cls.NEVER, key)

    def fits(self, key: str) -> bool:
        if not key or self.kind == self.NEVER:
            return False
        if self.kind == self.PARTED:
            return goes_on(key, self.text)
        return goes_on(key, self.text) or goes_on(self.text, key)

    def add(self, key: str) -> None:
        if not key:
            self.kind = self.NEVER
        if self.kind == self.NEVER:
            return
        if self.kind == self.CHAIN and goes_on(self.text, key):
            self.text = key
        elif not goes_on(key, self.text) and not (self.kind == self.PARTED and goes_on(self.text, key)):
            words = []
            for one, two in zip(self.text.split(" "), key.split(" ")):
                if one != two:
                    break
                words.append(one)
            self.text = " ".join(words)
            self.kind = self.PARTED if words else self.NEVER


def goes_on(short: str, long: str) -> bool:
    """Whether ``long`` is ``short`` or goes on after it with a blank."""
    return long == short or long.startswith(short + " ")


def same_spots(shapes: DataFrame, points: DataFrame, size: int | None = None) -> DataFrame:
    """(node, grp): each shape joins the first group all of whose members are at its spot.

    ``shapes``: node (text), key, point, component. ``points``: p, q, close for the pairs of
    points of a component near enough for equal names, both ways and with itself; ``close``
    ones are one spot whatever the names. A group is carried as one row per point it has
    (``Names`` says what its keys there allow), so a crowded point is one row.
    """
    nodes = number_blocks(shapes, F.substring("node", 1, 14), size)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict] = {}
        groups: dict[str, dict] = {}
        at: dict[int, set] = {}
        rows, round_ = [], int(pdf["k"].iloc[0])
        for kind, node, key, p, q, flag in zip(*(pdf[x] for x in ("kind", "node", "key", "p", "q", "flag"))):
            if kind == 0:
                rows.append((node, key, p))
            elif kind == 1:
                near.setdefault(p, {})[q] = bool(flag)
            else:
                groups.setdefault(node, {})[p] = Names(flag, key)
                at.setdefault(p, set()).add(node)
        out, touched = [], set()
        for node, key, p in sorted(rows):
            around = near[p]
            home = node
            for group in sorted(set().union(*(at.get(q, ()) for q in around))):
                if all(q in around and (around[q] or said.fits(key)) for q, said in groups[group].items()):
                    home = group
                    break
            said = groups.setdefault(home, {})
            if p in said:
                said[p].add(key)
            else:
                said[p] = Names.of(key)
                at.setdefault(p, set()).add(home)
            touched.add((home, p))
            out.append((0, node, home, 0, None, p, 0))
        out += [(2, g, g, round_, groups[g][p].text, p, groups[g][p].kind) for g, p in touched]
        return pd.DataFrame(out, columns=["kind", "node", "grp", "k", "key", "p", "flag"])

    def step(part: DataFrame, k: int, done: DataFrame | None) -> DataFrame:
        def row(kind: int, node: Column, key: Column, p: Column, q: Column, flag: Column) -> list:
            return [
                "component", F.lit(kind).alias("kind"), node.alias("node"), key.alias("key"), p.alias("p"),
                q.alias("q"), flag.cast("int").alias("flag"), F.lit(k).alias("k"),
            ]

        none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
        here = part.select("component", c("point").alias("p")).distinct()
        around = here.join(points, "p")
        rows = part.select(*row(0, c("node"), c("key"), c("point"), zero, zero)).unionByName(
            around.select(*row(1, none, none, c("p"), c("q"), c("close")))
        )
        if done is not None:
            latest = done.filter(c("kind") == 2).groupBy("grp", "p").agg(
                F.max_by(F.struct("key", "flag"), "k").alias("s")
            )
            touched = around.select("component", c("q").alias("p")).distinct().join(
                latest.select("grp", "p"), "p"
            ).select("component", "grp").distinct()
            rows = rows.unionByName(
                touched.join(latest, "grp").select(*row(2, c("grp"), c("s.key"), c("p"), zero, c("s.flag")))
            )
        return grouped_map(
            rows, "component", assign, "kind int, node string, grp string, k int, key string, p long, flag int"
        )

    return by_blocks(nodes, step).filter(c("kind") == 0).select("node", "grp")
