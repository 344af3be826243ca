"""Benchmark decontamination with a generalised suffix automaton of words.

The normalised words of the test items build automata of at most
``BLOCK_WORDS`` words each (one, for a usual benchmark). Documents stream their
words through the automaton, which tracks the longest run that ends here and
occurs in an item. A run of at least ``WINDOW`` words, or a whole shorter item,
marks its words as hit. Every further block is one more pass over the same
rows; nothing is joined or shuffled.

Null or empty text: no words, no hits. Null item text or id: no windows. An item
may have several rows; a repeated document row is treated like its twin. Other
columns pass through ``remove_spans`` untouched. Empty documents give an empty
result, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

c = F.col

WINDOW = 10
#: Most item words of one automaton; its states and edges are at most two and three times as many.
BLOCK_WORDS = 100_000

#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became small.
SEPARATORS = W.byte_table(
    bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
)


def normal_words(data: np.ndarray, at: np.ndarray):
    """(hash, start, end, first word by document) of the normalised words of a block."""
    small = W.LOWER[data]
    starts, ends = W.bounds(small, at, SEPARATORS)
    return W.hashes(small, starts, ends), starts, ends, W.per_document(starts, at)


class Automaton:
    """Suffix automaton of many word sequences; state 0 is the empty run."""

    def __init__(self, window: int):
        self.window = window
        self.words: dict[int, int] = {}
        self.length, self.link = [0], [-1]
        self.edges: list[dict[int, int]] = [{}]
        self.sequences: list[tuple[str, list[int]]] = []
        self.size = 0

    def _grow(self, last: int, word: int) -> int:
        """State of the run that ends with ``word`` after ``last``."""
        length, link, edges = self.length, self.link, self.edges
        known = edges[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        made = -1
        if known is None:
            made = len(length)
            length.append(length[last] + 1)
            link.append(0)
            edges.append({})
            while last >= 0 and word not in edges[last]:
                edges[last][word] = made
                last = link[last]
            if last < 0:
                return made
            known = edges[last][word]
            if length[known] == length[last] + 1:
                link[made] = known
                return made
        # The state also holds longer runs: split off those that end here.
        split = len(length)
        length.append(length[last] + 1)
        link.append(link[known])
        edges.append(dict(edges[known]))
        link[known] = split
        if made >= 0:
            link[made] = split
        while last >= 0 and edges[last].get(word) == known:
            edges[last][word] = split
            last = link[last]
        return made if made >= 0 else split

    def add(self, item: str, hashes: list[int]) -> None:
        ids = [self.words.setdefault(h, len(self.words) + 1) for h in hashes]
        state = 0
        for word in ids:
            state = self._grow(state, word)
        self.sequences.append((item, ids))
        self.size += len(ids)

    def finish(self) -> dict:
        """Flat tables for streaming: edges, links, items by window state, short items."""
        base = len(self.words) + 1
        flat = {s * base + w: t for s, out in enumerate(self.edges) for w, t in out.items()}
        items: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for item, ids in self.sequences:
            state = 0
            for n, word in enumerate(ids, 1):
                state = flat[state * base + word]
                if n >= self.window:
                    items.setdefault(self._window_state(state), set()).add(item)
            if 0 < len(ids) < self.window:
                short.setdefault(state, []).append((len(ids), item))
        above = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            up = self.link[state]
            above[state] = state if state in short else (above[up] if up >= 0 else -1)
        hashes = np.array(list(self.words), np.uint64)
        order = np.argsort(hashes)
        return {
            "base": base, "flat": flat, "link": self.link, "length": self.length, "items": items,
            "short": short, "above": above, "window": self.window, "hashes": hashes[order],
            "ids": (order + 1).astype(np.int64),
            "least": min([self.window, *(k for x in short.values() for k, _ in x)]),
        }

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state


def follow(model: dict, ids: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
    """(hit word ranges, items) of one run of known words."""
    flat, base, link, length = model["flat"], model["base"], model["link"], model["length"]
    above, short, items, window = model["above"], model["short"], model["items"], model["window"]
    ranges, found = [], set()
    state = matched = 0
    for i, word in enumerate(ids):
        after = flat.get(state * base + word)
        while after is None and state:
            state = link[state]
            matched = length[state]
            after = flat.get(state * base + word)
        if after is None:
            continue
        state, matched = after, matched + 1
        if matched >= window:
            at = state
            while length[link[at]] >= window:
                at = link[at]
            found |= items[at]
            if ranges and ranges[-1][1] > i - matched:
                ranges[-1] = (min(ranges[-1][0], i - matched + 1), i + 1)
            else:
                ranges.append((i - matched + 1, i + 1))
        at = above[state]
        while at >= 0:
            for size, item in short[at]:
                if size <= matched:
                    found.add(item)
                    ranges.append((i - size + 1, i + 1))
            at = above[link[at]]
    return ranges, found


def merged(ranges: np.ndarray) -> np.ndarray:
    """Union of ranges (n, 2), sorted and apart."""
    if len(ranges) < 2:
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.r_[True, ranges[1:, 0] > reach[:-1]]
    return np.stack([ranges[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(ranges) - 1]]], 1)


def block_hits(model: dict, data: np.ndarray, at: np.ndarray):
    """{document: (ranges, items)} of a block, and its words."""
    h, starts, ends, word_at = normal_words(data, at)
    hits: dict[int, tuple[list, set]] = {}
    if len(h) and len(model["hashes"]):
        place = np.searchsorted(model["hashes"], h)
        place[place == len(model["hashes"])] = 0
        ids = np.where(model["hashes"][place] == h, model["ids"][place], 0)
        # Runs of words that some item has, inside one document.
        cut = ids == 0
        edge = np.zeros(len(h) + 1, bool)
        edge[word_at] = True
        edge[:-1] |= cut
        edge[1:] |= cut
        marks = np.flatnonzero(edge)
        lo, hi = marks[:-1], marks[1:]
        use = (hi - lo >= model["least"]) & ~cut[lo]
        for a, b in zip(lo[use].tolist(), hi[use].tolist()):
            ranges, found = follow(model, ids[a:b].tolist())
            if ranges:
                d = int(np.searchsorted(word_at, a, "right")) - 1
                base = a - int(word_at[d])
                kept = hits.setdefault(d, ([], set()))
                kept[0].extend((x + base, y + base) for x, y in ranges)
                kept[1].update(found)
    return hits, starts, ends, word_at


def automata(benchmark: DataFrame, window: int, shortest: int) -> Iterator[dict]:
    """Finished automata of at most ``BLOCK_WORDS`` item words, one after the other."""
    rows = benchmark.select(
        c("item_id").cast("string").alias("item"), c("text").cast("string").alias("text")
    ).filter(c("item").isNotNull() & c("text").isNotNull())
    model = Automaton(window)
    for row in rows.toLocalIterator():
        raw = np.frombuffer(row.text.encode(), np.uint8)
        h, *_ = normal_words(raw, np.array([0, len(raw)]))
        if len(h) < max(shortest, 1):
            continue
        # A longer item goes in pieces that share window - 1 words.
        for lo in range(0, max(1, len(h) - window + 1), BLOCK_WORDS):
            piece = h[lo : lo + BLOCK_WORDS + window - 1].tolist()
            if model.size and model.size + len(piece) > BLOCK_WORDS:
                yield model.finish()
                model = Automaton(window)
            model.add(row.item, piece)
    yield model.finish()


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = 1) -> DataFrame:
    """(row, text, n_words, n_hit, ranges, items) per row; ``row`` holds its other columns.

    ``ranges`` are merged word ranges as pairs of 64-bit numbers, ``items`` the
    ids of the items found.
    """
    context = docs.sparkSession.sparkContext
    others = [c(x) for x in docs.columns if x != "text"]
    frame = docs.select(
        F.struct(*others, F.lit(0).alias("_")).alias("row"), c("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"), F.lit(b"").alias("ranges"),
        F.array().cast("array<string>").alias("items"),
    )
    for model in automata(benchmark, window, shortest):
        shared = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, text, _, _, ranges, items = batch.columns
                for lo, hi, data, at in W.blocks(text):
                    hits, _, _, word_at = block_hits(shared.value, data, at)
                    before, names = ranges[lo:hi].to_pylist(), items[lo:hi].to_pylist()
                    n_hit = np.array([_words_in(x) for x in before], np.int64)
                    for d, (found, of) in hits.items():
                        old = np.frombuffer(before[d], np.int64).reshape(-1, 2)
                        new = merged(np.concatenate([old, np.array(found, np.int64).reshape(-1, 2)]))
                        before[d], n_hit[d] = new.tobytes(), int((new[:, 1] - new[:, 0]).sum())
                        names[d] = sorted({*names[d], *of})
                    yield W.record_batch(
                        row=row[lo:hi], text=text[lo:hi], n_words=np.diff(word_at), n_hit=n_hit,
                        ranges=pa.array(before, pa.binary()), items=pa.array(names, pa.list_(pa.string())),
                    )

        frame = frame.mapInArrow(run, frame.schema)
    return frame


def _words_in(ranges: bytes) -> int:
    pairs = np.frombuffer(ranges, np.int64).reshape(-1, 2)
    return int((pairs[:, 1] - pairs[:, 0]).sum())


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and item digest of every document."""
    found = find_spans(docs.select(c("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return found.select(
        c("row.doc_id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (c("n_hit") > 0).alias("contaminated"),
    )


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5, shortest: int = 5
) -> DataFrame:
    """Documents without their hit spans; one with more than ``coverage`` of its words hit goes.

    Items of fewer than ``shortest`` words are ordinary phrases and left alone.
    Columns stay as they are, but for ``text``.
    """
    found = find_spans(docs, benchmark, window, shortest)
    kept = found.filter(c("n_hit") <= coverage * c("n_words")).select("row", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, text, ranges = batch.columns
            said, spans = text.to_pylist(), ranges.to_pylist()
            for i, x in enumerate(spans):
                if x:
                    raw = said[i].encode()
                    data = np.frombuffer(raw, np.uint8)
                    _, starts, ends, _ = normal_words(data, np.array([0, len(raw)]))
                    parts, last = [], 0
                    for a, b in np.frombuffer(x, np.int64).reshape(-1, 2):
                        parts.append(raw[last : starts[a]])
                        last = int(ends[b - 1])
                    said[i] = b"".join([*parts, raw[last:]]).decode()
            yield W.record_batch(row=row, text=pa.array(said, pa.string()))

    kept = kept.mapInArrow(run, kept.select("row", "text").schema)
    return kept.select(*[
        c("text") if name == "text" else c("row").getField(name).alias(name) for name in docs.columns
    ])
