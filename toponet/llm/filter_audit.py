"""Audit of how quality filters overlap: every order's steps, and exact Shapley shares.

Each document gets one bit per filter that it fails. Counted by part and bits, these give
for every coalition of filters (2 to their number, 32 here) how many documents it removes.
Differences of two coalitions are the counts of a step in an order of the filters. The
Shapley share of a filter comes from constrained least squares: an additive game is fitted
to all coalitions, weighted by the Shapley kernel, under the constraint that its parts sum
to what all filters remove. The normal equations are the same for every part, so they are
solved once, in rationals, for the matrix that turns coalition counts into shares; a share
times the number of orders is a whole number.

Equal texts are equal SHA-256 digests. Only digests, ids and bits are shuffled. Copies are
counted by (digest, part, bits, labels) before they meet the smallest id of their digest,
and that id is laid out under ``SALT`` join keys, so a text that a third of all documents
have is a few rows.

Null text is empty text, a null source the part ''. A document with a null id has no label,
is never a copy and makes none. Rows that repeat an id and its text are all counted, and are no
copies of one another. Of several labels of an id, any that says 1 counts. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

c = F.col

FILTERS = "ABCDE"
SALT = 16
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits of the filters that look at one text: A is 1, B is 2, C is 4, D is 8."""
    words = F.array_remove(F.split(text, _SPACE, -1), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        n < 50,
        100 * different < 65 * n,
        100 * capitals > 5 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def _copies(rows: DataFrame) -> DataFrame:
    """(part, bits, good, toxic, n, copies): rows of one kind and text, and how many of them copy a smaller id."""
    kind = ["digest", "part", "bits", "good", "toxic"]
    each = rows.groupBy(*kind, "id", "no_id").agg(F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(
        each.groupBy(*kind).agg(
            F.sum("n").alias("n"), F.sum(F.when(c("no_id"), 0).otherwise(c("n"))).alias("with_id"),
            F.min(F.when(~c("no_id"), F.struct("id", "n"))).alias("least"),
        )
    )
    first = (
        groups.groupBy("digest").agg(F.min("least.id").alias("first"), F.count(F.lit(1)).alias("kinds"))
        .filter(c("kinds") > 1)
        .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    )
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("part", "good", "toxic"), F.lit(SALT)).cast("int"))
    # A digest of one kind has its smallest id in that kind.
    own = F.coalesce(c("first"), c("least.id")) == c("least.id")
    copies = c("with_id") - F.when(own, c("least.n")).otherwise(0)
    return salted.join(first, ["digest", "salt"], "left").select(
        "part", "bits", "good", "toxic", "n", copies.alias("copies")
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents by part and failed filters, with the labelled ones among them."""
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    digest, id_ = F.unhex(F.sha2(text, 256)), c("doc_id").cast("long")
    rows = docs.select(
        # Null ids are spread by their text; the flag keeps them from meeting a label.
        F.coalesce(id_, F.xxhash64(text)).alias("id"), id_.isNull().alias("no_id"),
        F.coalesce(c("source").cast("string"), F.lit("")).alias("part"),
        failures(text).alias("bits"), digest.alias("digest"),
    )
    said = (
        labels.filter(c("doc_id").isNotNull())
        .groupBy(c("doc_id").cast("long").alias("id"), F.lit(False).alias("no_id"))
        .agg(
            F.max(F.coalesce(c("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(c("toxic") == 1, F.lit(False))).alias("toxic"),
        )
    )
    marked = rows.join(said, ["id", "no_id"], "left").select(
        "id", "no_id", "part", "bits", "digest", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    both = _copies(marked).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(c("bits"), (c("n") - c("copies")).alias("n")),
            F.struct((c("bits") + 16).alias("bits"), c("copies").alias("n")),
        )).alias("x"),
    ).filter(c("x.n") > 0)
    return both.groupBy("part", c("x.bits").alias("bits")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(c("good"), c("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(c("toxic"), c("x.n")).otherwise(0)).alias("toxic"),
    )


def coalitions(counted: DataFrame, size: int) -> DataFrame:
    """(part, n, gone, good_gone, toxic_gone): by coalition (its bits are the place), what it removes."""
    each = counted.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit((1 << size) - 1))))
    hit = c("bits").bitwiseAND(c("s")) != 0
    gone = [F.sum(F.when(hit, c(x)).otherwise(0)).cast("long").alias(x) for x in ("n", "good", "toxic")]
    # One row per part and coalition; all coalitions of a part are a list of fixed length.
    tabled = each.groupBy("part", "s").agg(F.sum("n").cast("long").alias("all"), *gone)
    listed = tabled.groupBy("part").agg(
        F.max("all").alias("n"), F.sort_array(F.collect_list(F.struct("s", "n", "good", "toxic"))).alias("by")
    )
    return listed.select(
        "part", "n", c("by.n").alias("gone"), c("by.good").alias("good_gone"), c("by.toxic").alias("toxic_gone")
    )


def solve(left: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of left X = right by elimination in rationals."""
    rows = [list(a) + list(b) for a, b in zip(left, right)]
    size = len(rows)
    for k in range(size):
        pivot = next(r for r in range(k, size) if rows[r][k] != 0)
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(size):
            if r != k and rows[r][k] != 0:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    return [row[size:] for row in rows]


def share_matrix(size: int) -> list[list[int]]:
    """By filter and coalition: weight of the coalition's count in the filter's share, times the number of orders.

    Least squares of sum over i in S of x_i against v(S), weighted by the Shapley kernel,
    under sum of all x_i = v(all). Its normal equations have one Lagrange multiplier; the
    right sides are one column per coalition, so their solution is the matrix wanted.
    """
    everyone = (1 << size) - 1
    inside = [[s >> i & 1 for i in range(size)] for s in range(1 << size)]
    weight = [
        Fraction(size - 1, comb(size, sum(x)) * sum(x) * (size - sum(x))) if 0 < sum(x) < size else Fraction(0)
        for x in inside
    ]
    one = Fraction(1)
    left = [
        [sum((weight[s] * x[i] * x[j] for s, x in enumerate(inside)), Fraction(0)) for j in range(size)] + [one]
        for i in range(size)
    ] + [[one] * size + [Fraction(0)]]
    right = [[weight[s] * x[i] for s, x in enumerate(inside)] for i in range(size)]
    right.append([one if s == everyone else Fraction(0) for s in range(1 << size)])
    shares = [[x * factorial(size) for x in row] for row in solve(left, right)[:size]]
    if any(x.denominator != 1 for row in shares for x in row):
        raise ArithmeticError("a share times the number of orders has to be whole")
    return [[int(x) for x in row] for row in shares]


def steps(removed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of every step of every order, and the shares summed over all orders."""
    size = len(filters)
    shares = F.array(*[
        sum((F.lit(w) * c("gone")[s] for s, w in enumerate(row) if w), F.lit(0).cast("long"))
        for row in share_matrix(size)
    ])
    orders = " ".join("".join(x) for x in permutations(filters))
    each = removed.withColumn("shares", shares).withColumn("filter_order", F.explode(F.split(F.lit(orders), " ")))
    each = each.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    # Places in an order count from 1.
    places = [F.locate(x, c("filter_order")) for x in filters]
    before = sum((F.when(at < c("step"), 1 << k).otherwise(0) for k, at in enumerate(places)), F.lit(0))
    here = sum((F.when(at == c("step"), k).otherwise(0) for k, at in enumerate(places)), F.lit(0))
    own = sum((F.when(at == c("step"), 1 << k).otherwise(0) for k, at in enumerate(places)), F.lit(0))
    each = each.withColumn("before", before).withColumn("filter", here).withColumn("own", own).withColumn(
        "after", c("before") + c("own")
    )

    def at(counts: str, coalition: Column) -> Column:
        return F.get(counts, coalition)

    here = at("gone", c("after")) - at("gone", c("before"))
    return each.select(
        "part", "filter_order", "step", (c("n") - at("gone", c("after"))).alias("kept"), here.alias("removed"),
        (at("gone", c("own")) - here).alias("redundant"),
        (at("gone", F.lit((1 << size) - 1)) - at("gone", (1 << size) - 1 - c("own"))).alias("unique_fails"),
        (at("good_gone", c("after")) - at("good_gone", c("before"))).alias("good_lost"),
        (at("toxic_gone", c("after")) - at("toxic_gone", c("before"))).alias("toxic_lost"),
        F.get("shares", c("filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    return steps(coalitions(cells(docs, labels), len(FILTERS)))
