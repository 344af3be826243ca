"""Runs of repeated word sequences, found in a Re-Pair grammar of the word ids.

A run is a maximal stretch of words with smallest period q and at least ``max(6, 4 q)`` words.

1. Of a run's words each recurs within q words, four times or more, and q is at most a
   quarter of any stretch that holds the run. Words that don't recur so in their stretch
   end it; this is repeated until nothing changes, and what is left of prose is little.
2. Re-Pair over the stretches of a block of whole documents: per round every pair of
   neighbours that is more frequent than the pairs it overlaps becomes a nonterminal
   wherever that is so (equal neighbours pair from the left), until no pair does twice.
   What is left of a stretch is halved into nonterminals of one place each.
3. A run is found where it crosses the boundary between the two halves of a nonterminal,
   once per nonterminal: at least two periods lie on one side, so each period is tried
   against the words next to the boundary, and both ends of a match are found by bisection
   on hashes modulo two primes. The least period of equal bounds is the smallest one.
4. These intervals are moved to every place where the nonterminal was made; those inside a
   larger one of the same period go. The smallest nonterminal around a run holds it whole,
   so the rest are the maximal intervals.

Documents are independent, so nothing is shuffled; a block is ``words.BLOCK`` bytes of whole
documents or one longer document. Equal words are equal 64-bit hashes.

Null or empty text has no words and no runs. A null doc_id gets no planted repeats. Repeated
rows are documents of their own; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

c = F.col

#: Least words of a run, and least repeats of its period.
LEAST, TIMES = 6, 4
#: Periods tried at once.
TRIED = 1 << 20
#: Words of which the joined text is made at once.
JOINED = 1 << 17
_PRIMES = ((2147483647, 1103515245), (2147483629, 1566083941))

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def stretches(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, stretch) of the words that may lie in a run; a stretch is consecutive words of one document."""
    place, part = np.arange(len(ids)), owner
    done, several = [], 0
    while len(place):
        length = np.bincount(part)
        key = part * (int(ids.max()) + 1) + ids[place]
        order = np.argsort(key, kind="stable")
        k, p = key[order], place[order]
        new = np.r_[True, k[1:] != k[:-1]]
        group = np.cumsum(new) - 1
        count = np.bincount(group)[group]
        gap = np.where(new[1:], len(ids), p[1:] - p[:-1])
        near = np.minimum(np.r_[len(ids), gap], np.r_[gap, len(ids)])
        fine = np.empty(len(place), bool)
        fine[order] = (count >= TIMES) & (TIMES * near <= length[part[order]])
        settled = np.bincount(part, ~fine, minlength=len(length)) == 0
        whole = settled[part] & (length[part] >= LEAST)
        if whole.any():
            done.append((place[whole], part[whole] + several))
        several += len(length)
        rest = fine & ~settled[part]
        place, part = place[rest], part[rest]
        if len(place):
            part = np.cumsum(np.r_[False, (np.diff(place) != 1) | (np.diff(part) != 0)])
            long = (np.bincount(part) >= LEAST)[part]
            place, part = place[long], np.unique(part[long], return_inverse=True)[1]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, part = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(place, kind="stable")
    place, part = place[order], part[order]
    return place, np.cumsum(np.r_[False, part[1:] != part[:-1]])


class Grammar:
    """Nonterminals by number: first place, words, words of the left half; and all places where each was made."""

    def __init__(self, ids: np.ndarray, part: np.ndarray):
        self._found: list[tuple[np.ndarray, ...]] = []
        self._made: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        symbol, at, words = ids.astype(np.int64), np.arange(len(ids)), np.ones(len(ids), np.int64)
        first = int(ids.max()) + 1 if len(ids) else 0
        rng = np.random.default_rng(12)
        while len(symbol) > 1:
            chosen, kind = self._choose(symbol, part, first + self.size, rng)
            if not len(chosen):
                break
            symbol, at, words, part = self._replace(symbol, at, words, part, chosen, kind, first)
        while len(symbol) > 1:
            # The rest in halves: every second neighbour of a stretch, each its own nonterminal.
            head = np.r_[True, part[1:] != part[:-1]]
            nth = np.arange(len(part)) - np.maximum.accumulate(np.where(head, np.arange(len(part)), 0))
            chosen = np.flatnonzero((nth[:-1] % 2 == 0) & ~head[1:])
            if not len(chosen):
                break
            symbol, at, words, part = self._replace(
                symbol, at, words, part, chosen, np.arange(len(chosen)), first
            )
        if self._found:
            self.place, self.words, self.left = (np.concatenate(x) for x in zip(*self._found))
            number, where = (np.concatenate(x) for x in zip(*self._made))
            order = np.argsort(number, kind="stable")
            self.number, self.where = number[order], where[order]
        else:
            self.place = self.words = self.left = self.number = self.where = np.zeros(0, np.int64)

    @staticmethod
    def _choose(symbol: np.ndarray, part: np.ndarray, symbols: int, rng) -> tuple[np.ndarray, np.ndarray]:
        """(places, pair number) of the pairs to replace in this round."""
        a, b = symbol[:-1], symbol[1:]
        open_ = part[1:] == part[:-1]
        pair, kind, count = np.unique(np.where(open_, a * symbols + b, -1), return_inverse=True, return_counts=True)
        # In x x x x every second pair counts, from the left.
        twin = open_ & (a == b)
        index = np.arange(len(a))
        begin = np.maximum.accumulate(np.where(twin & ~np.r_[False, twin[:-1]], index, 0))
        open_ &= ~(twin & ((index - begin) % 2 == 1))
        # Often first; between equally frequent pairs chance decides, so neighbours rarely wait for each other.
        rank = np.where(open_ & (count[kind] >= 2), count[kind] * len(pair) + rng.permutation(len(pair))[kind], -1)
        best = (rank >= 0) & (rank > np.r_[-1, rank[:-1]]) & (rank > np.r_[rank[1:], -1])
        best &= np.bincount(kind[best], minlength=len(pair))[kind] >= 2
        chosen = np.flatnonzero(best)
        return chosen, np.unique(kind[chosen], return_inverse=True)[1]

    def _replace(self, symbol, at, words, part, chosen, kind, first):
        """The sequence with nonterminals at the chosen places."""
        _, sample = np.unique(kind, return_index=True)
        one = chosen[sample]
        self._found.append((at[one], words[one] + words[one + 1], words[one]))
        self._made.append((kind + self.size, at[chosen]))
        symbol, words = symbol.copy(), words.copy()
        symbol[chosen] = first + self.size + kind
        words[chosen] += words[chosen + 1]
        self.size += len(sample)
        keep = np.ones(len(symbol), bool)
        keep[chosen + 1] = False
        return symbol[keep], at[keep], words[keep], part[keep]


class Matcher:
    """Equality of stretches of ``ids`` by sums of powers modulo two primes."""

    def __init__(self, ids: np.ndarray):
        self._sums, self._powers = [], []
        for prime, base in _PRIMES:
            powers = np.ones(1, np.uint64)
            while len(powers) <= len(ids):
                step = np.uint64(pow(base, len(powers), prime))
                powers = np.r_[powers, powers * step % np.uint64(prime)]
            self._powers.append(powers)
            terms = (ids.astype(np.uint64) + np.uint64(1)) % np.uint64(prime) * powers[: len(ids)] % np.uint64(prime)
            self._sums.append(np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)])

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` ids from ``i`` are those from ``j``, which is not before ``i``."""
        fine = np.ones(len(i), bool)
        for (prime, _), sums, powers in zip(_PRIMES, self._sums, self._powers):
            p = np.uint64(prime)
            one = (sums[i + n] - sums[i]) % p * powers[j - i] % p
            fine &= one == (sums[j + n] - sums[j]) % p
        return fine

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """Longest common stretch from ``i`` and ``j`` on (way 1) or up to them (way -1), ``most`` words at most."""
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            back = mid if way < 0 else 0
            fine = self.same(i - back, j - back, mid)
            low, high = np.where(fine, mid, low), np.where(fine, high, mid - 1)
        return low


def crossing(grammar: Grammar, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(nonterminal, start, end, period): runs over each boundary, within the nonterminal at its first place."""
    match = Matcher(ids)
    big = np.flatnonzero(grammar.words >= LEAST)
    tries = grammar.words[big] // TIMES
    total = np.r_[0, np.cumsum(tries)]
    out, lo = [], 0
    while lo < len(big):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + TRIED, "right")) - 1)
        node = np.repeat(big[lo:hi], tries[lo:hi])
        q = np.arange(len(node)) - np.repeat(total[lo:hi] - total[lo], tries[lo:hi]) + 1
        lo = hi
        begin = grammar.place[node]
        mid, end = begin + grammar.left[node], begin + grammar.words[node]
        # Two periods to the right of the boundary, or to the left; ``x`` is where the first of them begins.
        for x, fits in ((mid, mid + 2 * q <= end), (mid - 2 * q, mid - 2 * q >= begin)):
            some = np.flatnonzero(fits)
            some = some[(ids[x[some]] == ids[x[some] + q[some]])]
            some = some[match.same(x[some], x[some] + q[some], q[some])]
            at, p = x[some], q[some]
            start = at - match.reach(at, at + p, at - begin[some], -1)
            stop = at + p + match.reach(at, at + p, end[some] - at - p, 1)
            long = (stop - start >= np.maximum(LEAST, TIMES * p)) & (start < mid[some]) & (stop > mid[some])
            out.append((node[some][long], start[long], stop[long], p[long]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    node, start, stop, q = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((q, stop, start, node))
    node, start, stop, q = node[order], start[order], stop[order], q[order]
    new = np.r_[True, (np.diff(node) != 0) | (np.diff(start) != 0) | (np.diff(stop) != 0)][: len(node)]
    return node[new], start[new], stop[new], q[new]


def maximal(start: np.ndarray, stop: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """The intervals that lie in no other of the same period, by start, then period."""
    order = np.lexsort((-stop, start, q))
    start, stop, q = start[order], stop[order], q[order]
    if len(q):
        group = np.cumsum(np.r_[False, np.diff(q) != 0])
        ends = stop + group * (int(stop.max()) + 1)
        top = np.r_[-1, np.maximum.accumulate(ends)[:-1]]
        keep = ends > top
        start, stop, q = start[keep], stop[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], stop[order], q[order]


def find_runs(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the documents of a block, by start, then period."""
    place, part = stretches(ids, owner)
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none
    text = np.unique(ids[place], return_inverse=True)[1]
    grammar = Grammar(text, part)
    node, start, stop, q = crossing(grammar, text)
    lo, hi = np.searchsorted(grammar.number, node), np.searchsorted(grammar.number, node, "right")
    times = hi - lo
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    shift = grammar.where[np.repeat(lo, times) + nth] - np.repeat(grammar.place[node], times)
    start, stop, q = maximal(
        np.repeat(start, times) + shift, np.repeat(stop, times) + shift, np.repeat(q, times)
    )
    # A stretch is consecutive words.
    return place[start], place[stop - 1] + 1, q


def planted(doc_ids: list, word_at: np.ndarray) -> np.ndarray:
    """Place of the original word that stands at each place of a block."""
    source = np.arange(int(word_at[-1]))
    for doc, lo, hi in zip(doc_ids, word_at[:-1], word_at[1:]):
        n = int(hi - lo)
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[lo + a : hi] = lo + a + np.arange(n - a) % p
    return source


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept_at: np.ndarray) -> list[str]:
    """SHA-256 of each document's words joined by one space; words and documents in order."""
    hashers = [hashlib.sha256() for _ in kept_at[1:]]
    for lo in range(0, len(starts), JOINED):
        hi = min(lo + JOINED, len(starts))
        size = ends[lo:hi] - starts[lo:hi] + 1
        at = np.r_[0, np.cumsum(size)]
        index = np.arange(at[-1]) + np.repeat(starts[lo:hi] - 1 - at[:-1], size)
        said = data[np.maximum(index, 0)]
        said[at[:-1]] = 0x20
        raw = memoryview(said)
        d = int(np.searchsorted(kept_at, lo, "right")) - 1
        while d < len(hashers) and kept_at[d] < hi:
            a, b = max(int(kept_at[d]), lo), min(int(kept_at[d + 1]), hi)
            if a < b:
                # The first word of a document has no space before it.
                hashers[d].update(raw[at[a - lo] + (a == kept_at[d]) : at[b - lo]])
            d += 1
    return [x.hexdigest() for x in hashers]


def block_runs(doc_ids: list, data: np.ndarray, at: np.ndarray, plant: bool) -> dict[str, list]:
    """The result's columns for the documents of a block."""
    starts, ends = W.bounds(data, at, W.WHITE)
    word_at = W.per_document(starts, at)
    owner = W.owners(word_at)
    source = planted(doc_ids, word_at) if plant else np.arange(len(starts))
    ids = np.unique(W.hashes(data, starts, ends), return_inverse=True)[1].astype(np.int64)[source]
    start, stop, q = find_runs(ids, owner)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start + q, 1)
    np.add.at(edge, stop, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    collapsed = _digests(data, starts[source[kept]], ends[source[kept]], np.searchsorted(kept, word_at))
    doc = owner[start] if len(start) else start
    run_at = np.searchsorted(doc, np.arange(len(word_at)))
    made = {x: [] for x in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256")}
    for d, (lo, hi) in enumerate(zip(run_at[:-1], run_at[1:])):
        runs = [
            (int(s), int(n), int(p)) for s, n, p in
            zip(start[lo:hi] - word_at[d], stop[lo:hi] - start[lo:hi], q[lo:hi])
        ]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        text = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        for name, value in zip(made, (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest()
        )):
            made[name].append(value)
    return made | {"collapsed_sha256": collapsed}


def runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Number of runs, the longest one and the two digests of every document.

    ``plant`` first repeats words of some documents, as the registered query does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(1)):
                ids = batch.column(0)[lo:hi]
                made = block_runs(ids.to_pylist(), data, at, plant)
                yield W.record_batch(
                    doc_id=ids, **{k: pa.array(v, types.get(k, pa.int64())) for k, v in made.items()}
                )

    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
