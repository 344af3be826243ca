"""Near-duplicates by bottom-k sketches of word shingles.

One hash function orders all shingles; a document keeps its smallest, small sets whole.

1. Documents with equal shingle sets are one class from the start.
2. Inverted lists hold retained values. Two sets of the wanted similarity share at
   least ``need`` retained values (exactly so while both sets are retained whole; for
   larger sets except with a chance below 1e-6), so each class only enters the lists
   of its first ``size - need + 1`` values, the rarest first. Whole sets have lists of
   their own; sets that a larger one may resemble are in both. Values that many
   documents share, as in a common passage, come last and are hardly ever listed.
   Rarity is read from a table of ``COUNTERS`` sums, whatever the corpus.
3. Pairs: every class meets the leaders of most of its lists. Linked classes merge, and
   lists with one component are done. Other lists get other leaders. As soon as the
   pairs between different components of a list are about as many as list entries, or
   after the last leaders, the rest is paired: lists of up to ``SHORT`` classes as they
   are, while the classes of longer ones are listed anew, under the rarest values of
   their full sets and by size. A pair meets there only if the common value is among
   the first ``size - shared + 1`` of both, ``shared`` being what two sets of just these
   sizes must have in common. This loses no link, but texts that share a passage meet
   no more, since their own values come first. What is left are pairs near the threshold.
4. The sketch of the union, the smallest values of both sketches together, estimates
   the similarity; what can't reach the threshold goes. The rest is counted on full
   sets: a link is exact.

Null or empty text has the empty set, and links with nothing. Rows that share a
doc_id are one document. A null doc_id is its own component (null), not kept.
Other columns pass through ``drop_near_duplicates``. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import top_per_key
from ..plans.grouping import components
from . import words as W
from .tables import forget, lend, written

c = F.col

#: Sets up to ``FULL`` shingles are retained whole, of larger ones the ``SKETCH`` smallest hashes.
FULL, SKETCH = 256, 128
#: Chance to be below ``need`` shared values at exactly the threshold.
MISS = 1e-7
COUNTERS = 1 << 20
FILTER_BITS = 1 << 22
#: Leaders that each class meets, round by round.
LEADERS = (1, 4, 8, 8)
#: The rest is paired at once when that is no more than so many pairs per list entry.
REST = 2
#: Longer lists are made anew from full sets before their classes are paired.
SHORT = 16
#: Size bands between a set and the smallest set that can match it.
BANDS = 2


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document of a block."""
    small = W.LOWER[data]
    starts, ends = W.bounds(small, at, W.WHITE)
    word_at = W.per_document(starts, at)
    h = W.hashes(small, starts, ends)
    owner = W.owners(word_at)
    grams, first = W.windows(h, owner, width)
    cut = np.searchsorted(owner[first], np.arange(len(at)))
    out = []
    for d, (lo, hi) in enumerate(zip(word_at[:-1], word_at[1:])):
        if 0 < hi - lo < width:
            few = np.zeros(1, np.uint64)
            for k in range(lo, hi):
                few = W.mix(few * np.uint64(0xA0761D6478BD642F) + h[k : k + 1] + np.uint64(1))
            out.append(few >> np.uint64(1))
        else:
            # 63 bits: the order is the same for signed numbers.
            out.append(np.unique(grams[cut[d] : cut[d + 1]] >> np.uint64(1)))
    return out


def _signed(values: list[np.ndarray]) -> pa.Array:
    sizes = np.array([0, *map(len, values)], np.int64).cumsum().astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, print_a, print_b, sketch): size, set fingerprint, smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(1)):
                sets = shingle_sets(data, at, width)
                prints = np.array([
                    (np.bitwise_xor.reduce(W.mix(x)), W.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum())
                    if len(x) else (0, 0) for x in sets
                ], np.uint64).reshape(-1, 2).view(np.int64)
                yield W.record_batch(
                    doc_id=batch.column(0)[lo:hi], n_shingles=np.array(list(map(len, sets)), np.int64),
                    print_a=np.ascontiguousarray(prints[:, 0]), print_b=np.ascontiguousarray(prints[:, 1]),
                    sketch=_signed([x if len(x) <= FULL else x[:SKETCH] for x in sets]),
                )

    schema = "doc_id long, n_shingles long, print_a long, print_b long, sketch array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, width: int, wanted: bytes) -> DataFrame:
    """(id, set) of the documents whose bit is set; a bit may also let others pass."""
    shared = lend(docs.sparkSession, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = (W.mix(ids.view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            for lo, hi, data, at in W.blocks(batch.column(1)):
                yield W.record_batch(id=batch.column(0)[lo:hi], set=_signed(shingle_sets(data, at, width)))

    rows = docs.filter(c("doc_id").isNotNull()).select("doc_id", "text")
    return rows.mapInArrow(run, "id long, set array<long>")


def least_shared(percent: int, chance: float = MISS) -> int:
    """Retained values that two larger sets at the threshold share, except with ``chance``."""
    p, total, need = percent / 100, 0.0, 0
    while total < chance:
        total += comb(SKETCH, need) * p**need * (1 - p) ** (SKETCH - need)
        need += 1
    return need - 1


def _counter(value: Column) -> Column:
    return F.pmod(F.shiftright(value, 20), F.lit(COUNTERS)).cast("int")


def _often(sets: DataFrame, column: str) -> np.ndarray:
    """How many rows hold a value, in ``COUNTERS`` sums."""
    sums = (
        sets.select(F.explode(column).alias("value")).groupBy(_counter(c("value")).alias("k"))
        .agg(F.count(F.lit(1)).alias("n")).toArrow()
    )
    table = np.zeros(COUNTERS, np.int64)
    table[sums["k"].to_numpy()] = sums["n"].to_numpy()
    return table


def postings(classes: DataFrame, percent: int, table: np.ndarray) -> DataFrame:
    """(value, id, n) of the values each class is listed under."""
    shared = lend(classes.sparkSession, table)
    most = least_shared(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            out = []
            for n, value in zip(sizes, batch.column(2)):
                value = value.values.to_numpy()
                often = shared.value[(value >> 20) % COUNTERS]
                keys = np.zeros(0, np.int64)
                if n <= FULL:
                    need = -(-percent * n // 100)
                    # Complements, so that these lists are apart from those of larger sets.
                    keys = ~value[np.lexsort((value, often))[: n - need + 1]]
                if 100 * n >= percent * FULL:
                    low = value[:SKETCH]
                    rare = low[np.lexsort((low, often[:SKETCH]))[: len(low) - most + 1]]
                    keys = np.concatenate([keys, rare])
                out.append(keys)
            counts = [len(x) for x in out]
            yield W.record_batch(
                value=np.concatenate(out) if out else np.zeros(0, np.int64),
                id=np.repeat(batch.column(0).to_numpy(), counts), n=np.repeat(sizes, counts),
            )

    return classes.select("id", "n", "sketch").mapInArrow(run, "value long, id long, n long")


def _size_roles(n: int, percent: int) -> Iterator[tuple[int, int, int]]:
    """(key, role, smallest size of a partner) of the size lists a set of ``n`` shingles is in.

    A key names the band of the larger set and how many bands the smaller one lies below.
    Roles: 0 for sets of one band, 1 for the larger, 2 for the smaller of two bands.
    """
    width = -log(percent / 100) / BANDS
    band = int(log(n) / width)
    least, most = -(-percent * n // 100), 100 * n // percent

    def start(b: int) -> int:
        return int(exp(b * width))

    yield band * (BANDS + 2), 0, max(start(band), least)
    # One step more than BANDS: an edge may be rounded either way.
    for step in range(1, BANDS + 2):
        if band >= step and start(band - step + 1) + 1 >= least:
            yield band * (BANDS + 2) + step, 1, max(start(band - step), least)
        if start(band + step) <= most:
            yield (band + step) * (BANDS + 2) + step, 2, max(start(band + step), n)


def _size_lists(sets: DataFrame, percent: int, table: np.ndarray) -> DataFrame:
    """(id, n, value, size, role, place) of the rarest values of full sets (id, set)."""
    shared = lend(sets.sparkSession, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.values.to_numpy()
                n = len(x)
                if not n:
                    continue
                ranked = x[np.lexsort((x, shared.value[(x >> 20) % COUNTERS]))]
                roles = [
                    (size, role, n + 1 - -(-percent * (n + other) // (100 + percent)))
                    for size, role, other in _size_roles(n, percent)
                ]
                sizes, kinds, counts = (np.array(y, np.int32) for y in zip(*roles))
                counts = np.clip(counts, 0, n)
                total = int(counts.sum())
                yield W.record_batch(
                    id=np.full(total, i, np.int64), n=np.full(total, n, np.int64),
                    value=np.concatenate([ranked[:k] for k in counts]), size=np.repeat(sizes, counts),
                    role=np.repeat(kinds, counts),
                    place=np.concatenate([np.arange(k, dtype=np.int64) for k in counts]),
                )

    return sets.mapInArrow(run, "id long, n long, value long, size int, role int, place long")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure) of the pairs whose retained values allow the threshold.

    Where both sets are retained whole the answer is exact; else the union sketch
    estimates it.
    """
    left = classes.select(c("id").alias("a"), c("n").alias("a_n"), c("sketch").alias("a_kept"))
    right = classes.select(c("id").alias("b"), c("n").alias("b_n"), c("sketch").alias("b_kept"))
    inter = F.size(F.array_intersect("a_kept", "b_kept"))
    exact = 100 * inter >= percent * (c("a_n") + c("b_n") - inter)
    one, two = F.slice("a_kept", 1, SKETCH), F.slice("b_kept", 1, SKETCH)
    union = F.slice(F.array_sort(F.array_union(one, two)), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(one, two), union))
    sure = F.greatest("a_n", "b_n") <= FULL
    return pairs.join(right, "b").join(left, "a").filter(
        F.when(sure, exact).otherwise(both >= least_shared(percent))
    ).select("a", "b", sure.alias("sure"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(c("id").alias("a"), c("set").alias("a_set"))
    right = sets.select(c("id").alias("b"), c("set").alias("b_set"))
    inter = F.size(F.array_intersect("a_set", "b_set"))
    alike = 100 * inter >= percent * (F.size("a_set") + F.size("b_set") - inter)
    return pairs.join(right, "b").join(left, "a").filter(alike).select("a", "b")


def _can_match(percent: int) -> Column:
    """Sizes near enough for the threshold."""
    return (100 * F.least("n", "m")) >= (percent * F.greatest("n", "m"))


def _may_link(times: Column, percent: int) -> Column:
    """Whether two classes that share ``times`` listed values can reach the threshold.

    A whole set is listed under its first ``n - need + 1`` values in one order of all values.
    What two such sets share is among the listed values of both, or follows the listed ones of
    the set whose list ends first, so it is ``times`` and ``need - 1`` of one of them at most.
    """
    def after(n: str) -> Column:
        return F.ceil(percent * c(n) / 100) - 1

    most = times + F.greatest(after("n"), after("m"))
    wanted = 100 * most >= percent * (c("n") + c("m") - most)
    return F.when(F.greatest("n", "m") <= FULL, (times > 0) & wanted).otherwise(F.lit(True))


def _shared() -> Column:
    """Number of shared values from the lists of whole sets; their keys are below zero."""
    return F.sum(F.when(c("value") < 0, 1).otherwise(0))


def _leader_pairs(lists: DataFrame, percent: int, turn: int, leaders: int) -> DataFrame:
    """Each class with the ``leaders`` commonest of its lists, where they are not yet together.

    Of a leader that a class meets in few of their common lists the bound can't be told, so any leader counts.
    """
    rank = F.xxhash64("id", F.lit(turn)) if turn else c("id")
    first = lists.groupBy("value").agg(
        F.min_by(F.struct("id", "n", "comp"), rank).alias("lead")
    ).select("value", c("lead.id").alias("lead"), c("lead.n").alias("m"), c("lead.comp").alias("lead_comp"))
    met = lists.join(first, "value").filter((c("comp") != c("lead_comp")) & _can_match(percent))
    times = met.groupBy("id", "lead").agg(F.count(F.lit(1)).alias("times"))
    best = top_per_key(times, ["id"], [c("times").desc(), c("lead")], leaders)
    return best.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def _all_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different components whose common lists allow the threshold."""
    other = lists.select("value", c("id").alias("b"), c("n").alias("m"), c("comp").alias("b_comp"))
    met = lists.join(other, "value").filter((c("comp") < c("b_comp")) & _can_match(percent))
    shared = met.groupBy("id", "b", "n", "m").agg(_shared().alias("times"))
    # Classes of different components meet in every list they share: none of those is closed.
    return shared.filter(_may_link(c("times"), percent)).select(
        F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")
    )


def _size_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components with a value early enough in both for sets of their sizes."""
    one = lists.filter(c("role") != 2).withColumn("same", c("role") == 0).drop("role")
    two = lists.filter(c("role") != 1).select(
        "value", "size", c("id").alias("b"), c("n").alias("m"), c("place").alias("b_place"), c("comp").alias("b_comp")
    )

    def early(size: Column, place: Column) -> Column:
        return (100 + percent) * (size - place) >= percent * (c("n") + c("m"))

    met = one.join(two, ["value", "size"]).filter(
        (c("comp") != c("b_comp")) & (~c("same") | (c("id") < c("b"))) & _can_match(percent)
        & early(c("n"), c("place")) & early(c("m"), c("b_place"))
    )
    return met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def _rest(lists: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """All pairs that may still link: of short lists directly, of long ones from full sets.

    Two classes that share a long list are both listed anew, so they meet there if they
    can be linked; classes that share short lists only are paired by these.
    """
    long = lists.groupBy("value").count().filter(c("count") > SHORT).select("value")
    crowd = written(lists.join(long, "value", "left_semi").select("id", "n", "comp").distinct(), "crowd")
    pairs = _all_pairs(lists.join(long, "value", "left_anti"), percent)
    if crowd.isEmpty():
        return pairs
    sets = full_sets(docs, width, _bit_map(crowd.select(c("id").alias("a"), c("id").alias("b"))))
    sets = written(sets, "sets")
    # Counted on full sets: sketches say nothing of the values that they don't retain.
    again = _size_lists(sets, percent, _often(sets, "set")).join(crowd, ["id", "n"])
    return pairs.unionByName(_size_pairs(again, percent)).distinct()


def _is_little(lists: DataFrame) -> bool:
    """Whether the pairs between components of a list are about as many as list entries."""
    each = lists.groupBy("value", "comp").agg(F.count(F.lit(1)).cast("double").alias("n"))
    whole = each.groupBy("value").agg(F.sum("n").alias("n"), F.sum(c("n") * c("n")).alias("own"))
    row = whole.agg(F.sum((c("n") * c("n") - c("own")) / 2).alias("pairs"), F.sum("n").alias("entries")).first()
    return row.pairs <= REST * row.entries


def _open_lists(lists: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Lists with members of several components, with the components as they are now."""
    if comps is not None:
        lists = lists.drop("comp").join(comps, c("id") == c("node"), "left").select(
            "value", "id", "n", F.coalesce("component", "id").alias("comp")
        )
    several = lists.groupBy("value").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter(
        c("x") != c("y")
    ).select("value")
    return written(lists.join(several, "value", "left_semi"), "lists")


def _bit_map(pairs: DataFrame) -> bytes:
    """Bits of the ids in ``pairs``, gathered as words; a full map would only let more rows pass."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    made = ids.mapInArrow(_bit_words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, "<i8")
    words[made["word"].to_numpy()] = made["bits"].to_numpy()
    return words.tobytes()


def _bit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bit = np.unique(W.mix(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS))
        word, first = np.unique((bit >> np.uint64(6)).astype(np.int32), return_index=True)
        ones = np.uint64(1) << (bit & np.uint64(63))
        yield W.record_batch(
            word=word, bits=(np.bitwise_or.reduceat(ones, first) if len(bit) else ones).view(np.int64)
        )


def near_classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text"))
    whole = written(sketches(docs, width), "sketches")
    same = ["print_a", "print_b", "n_shingles"]
    known = whole.filter((c("n_shingles") > 0) & c("doc_id").isNotNull())
    classes = known.groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumnRenamed("n_shingles", "n"), "classes")
    made = written(whole.drop("sketch"), "sizes")
    forget(whole)
    table = _often(classes, "sketch")
    all_lists = written(postings(classes, percent, table).withColumn("comp", c("id")), "postings")
    lists = _open_lists(all_lists, None)
    forget(all_lists)
    comps = None
    turn, last = 0, False
    while not last and not lists.isEmpty():
        last = turn == len(LEADERS) or turn > 0 and _is_little(lists)
        if last:
            pairs = _rest(lists, docs, width, percent)
        else:
            pairs = _leader_pairs(lists, percent, turn, LEADERS[turn])
        turn += 1
        pairs = written(_estimated(pairs, classes, percent), "pairs")
        if pairs.isEmpty():
            forget(pairs)
            continue
        found, open_ = pairs.filter("sure").select("a", "b"), pairs.filter(~c("sure")).select("a", "b")
        if not open_.isEmpty():
            sets = full_sets(docs, width, _bit_map(open_))
            found = found.unionByName(written(_verified(open_, sets, percent), "verified"))
        if comps is not None:
            # A star says all that the links of earlier rounds said.
            found = found.unionByName(comps.select(c("node").alias("a"), c("component").alias("b")))
        comps = components(found)
        if not last:
            before, lists = lists, _open_lists(lists, comps)
            forget(before)
    forget(lists)
    named = classes.select("print_a", "print_b", c("n").alias("n_shingles"), "id")
    if comps is not None:
        named = named.join(comps, c("id") == c("node"), "left").withColumn("id", F.coalesce("component", "id"))
    named = named.select(*same, c("id").alias("component"))
    found = made.drop("sketch").join(named, same, "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def report(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """Set size, component and verdict of every document."""
    return near_classes(docs, width, percent).withColumn(
        "kept", F.coalesce(c("doc_id") == c("component_id"), F.lit(False))
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest of their group, with all their columns."""
    gone = report(docs, width, percent).filter(~c("kept") & c("doc_id").isNotNull()).select(
        c("doc_id").alias("_gone")
    ).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == c("_gone"), "left_anti")
