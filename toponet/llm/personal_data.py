"""Personal data: formal patterns, and words that give a protected entity away.

Base spans are e-mail and IP addresses, card and phone numbers, leftmost and
non-overlapping per kind; a match that fails its test is dropped. Words of three letters
or more outside of them are terms. A single value seldom recurs, so a protected entity
is also what stands behind it: its kind, the domain and the account of an e-mail
address, the network of an IP address, the block of a number (``entities``). Over the
corpus, counted by documents, the disclosure of an entity e by a term t is
log(P(e | t) / P(e)) / log(1 / P(e)), 0 where t says nothing and 1 where t only occurs
with e, times k / (k + ``SHRINK``) for the k texts that hold both and differ outside of base
spans. A term is disclosing from ``DISCLOSURE`` on for any entity. Such
terms become spans of kind ``term`` wherever they stand, in texts without the entity too;
``sanitise`` replaces spans by their kind and takes out terms from ``REMOVE`` on.

Null text is empty and has no spans. A repeated row is treated like its twin. Ties
of position go by kind. Other columns pass through ``sanitise``. Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W

c = F.col

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE, REMOVE = 0.9, 0.99
SHRINK = 0.25
#: With fewer texts no pair gets to DISCLOSURE.
LEAST_TEXTS = math.ceil(DISCLOSURE * SHRINK / (1 - DISCLOSURE) - 1e-9)
#: Least and most bits of the map of wanted terms.
FILTER_BITS, MOST_BITS = 1 << 20, 1 << 26

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = W.byte_table(b"0123456789")
_AT, _PLUS, _DOT = W.byte_table(b"@"), W.byte_table(b"+"), W.byte_table(b".")
_OF_WORD = W.byte_table(bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def emails(text: str) -> list[tuple[int, int]]:
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            low = found.end()
            out.append((start, low))
        at = text.find("@", max(at + 1, low))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) < 4 and int(part or "0") <= 255

    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        n = int(x) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]


def base_spans(text: str, signs: tuple[int, int, int, int]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; ``signs`` are the counts of digits, @, + and dots."""
    digits, at, plus, dots = signs
    found = []
    if at:
        found += [(a, 0, b) for a, b in emails(text)]
    if digits >= 4 and dots >= 3:
        found += [(a, 1, b) for a, b in addresses(text)]
    if digits >= 14:
        found += [(a, 2, b) for a, b in cards(text)]
    if digits >= 10 and plus:
        found += [(a, 3, b) for a, b in phones(text)]
    return sorted(found)


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def entities(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """Numbers of the values of the spans and of what stands behind them."""
    out = set()
    for start, kind, end in spans:
        value = text[start:end].lower()
        names = ["", value]
        if kind == 0:
            account, _, domain = value.partition("@")
            account = "".join(x for x in account.partition("+")[0] if x.isalpha())
            names += [f"@{domain}"] + [f"{account}@"] * (len(account) > 2)
        elif kind == 1:
            names.append(value.rpartition(".")[0])
        else:
            digits = "".join(x for x in value if x.isdigit())
            names[1:] = [digits, f"{digits[:6] if kind == 2 else digits[:-4]}*"]
        out.update(f"{KINDS[kind]}:{x}" for x in names)
    return sorted(map(_number, out))


def terms(data: np.ndarray, at: np.ndarray):
    """(hash, document, start, end) of the terms of a block, in characters of their document; A-Z are small.

    Letters are A-Z, a-z and all beyond ASCII but Latin-1 signs, general punctuation to symbols, and CJK punctuation.
    """
    small = W.LOWER[data]
    lead = small[:-2]
    for width, found in (
        (2, np.flatnonzero(small[:-1] == 0xC2)),
        (3, np.flatnonzero((lead == 0xE2) & (small[1:-1] >= 0x80) & (small[1:-1] <= 0xAF))),
        (3, np.flatnonzero((lead == 0xE3) & (small[1:-1] == 0x80))),
    ):
        for k in range(width):
            small[found + k] = 0x20
    starts, ends = W.bounds(small, at, _OF_WORD)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    long = chars[ends] - chars[starts] >= 3
    starts, ends = starts[long], ends[long]
    owner = W.owners(W.per_document(starts, at))
    first = chars[at[:-1]][owner]
    return W.hashes(small, starts, ends), owner, chars[starts] - first, chars[ends] - first


def _between(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, last = [], 0
    for start, _, end in spans:
        parts.append(text[last:start])
        last = max(last, end)
    return "\0".join([*parts, text[last:]])


def outside(text: str, spans: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the words touch no span."""
    held = np.zeros(len(text) + 1, np.int64)
    for a, _, b in spans:
        held[a + 1 : b + 1] = 1
    held = np.cumsum(held)
    return held[ends] == held[starts]


_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_BASE_SQL = "array<struct<start:long,kind:int,end:long>>"
_HITS = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_LONGS = pa.list_(pa.int64())


def _signs(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([W.counted(x[data], at) for x in (_DIGIT, _AT, _PLUS, _DOT)], 1)


def _text(data: np.ndarray, at: np.ndarray, d: int) -> str:
    return data[at[d] : at[d + 1]].tobytes().decode("utf-8", "replace")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, entities, terms, context) of every row; ``key`` stands for id and text, ``context`` for
    the text outside of its spans. Rows without spans have no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(2)):
                signs = _signs(data, at)
                base, known, said = ([[]] * (hi - lo) for _ in range(3))
                context = np.zeros(hi - lo, np.int64)
                for d in np.flatnonzero(signs[:, :2].any(1)):
                    text = _text(data, at, d)
                    spans = base_spans(text, tuple(signs[d].tolist()))
                    if spans:
                        h, _, starts, ends = terms(data[at[d] : at[d + 1]], np.array([0, at[d + 1] - at[d]]))
                        h = np.unique(h[outside(text, spans, starts, ends)])
                        base[d], known[d], said[d] = spans, entities(text, spans), h.view(np.int64)
                        context[d] = _number(_between(text, spans))
                yield W.record_batch(
                    doc_id=batch.column(0)[lo:hi], key=batch.column(1)[lo:hi],
                    base=pa.array([[dict(zip(("start", "kind", "end"), x)) for x in y] for y in base], _BASE),
                    entities=pa.array(known, _LONGS), terms=pa.array(said, _LONGS), context=context,
                )

    return _rows(docs).mapInArrow(
        run, f"doc_id long, key long, base {_BASE_SQL}, entities array<long>, terms array<long>, context long"
    )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        c("doc_id").cast("long").alias("doc_id"), F.xxhash64(c("doc_id").cast("long"), "text").alias("key"),
        c("text").cast("string").alias("text"),
    )


def _bit_map(found: DataFrame) -> bytes:
    """A bit for every ``term`` of ``found``; about one in eight is set, up to MOST_BITS."""
    bits = min(MOST_BITS, max(FILTER_BITS, 1 << (8 * found.count()).bit_length()))
    place = F.pmod("term", F.lit(bits))
    words = found.select(
        F.floor(place / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(term, {bits}) % 64 as int))").alias("bit")
    ).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, "<i8")
    for row in words.toLocalIterator():
        out[row["at"]] = row["bits"]
    return out.tobytes()


def _wanted(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = (h % np.uint64(8 * len(bits))).astype(np.int64)
    return (bits[place >> 3] >> (place & 7) & 1).astype(bool)


def _document_terms(docs: DataFrame, wanted: bytes) -> DataFrame:
    """(term, documents) of terms whose bit is set, summed per block."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(0)):
                h, owner, _, _ = terms(data, at)
                use = _wanted(bits, h)
                pairs = np.unique(np.stack([h[use], owner[use].astype(np.uint64)], 1), axis=0)
                term, n = np.unique(pairs[:, 0], return_counts=True)
                yield W.record_batch(term=term.view(np.int64), n=n.astype(np.int64))

    return docs.select(c("text").cast("string").alias("text")).mapInArrow(run, "term long, n long")


def _places(docs: DataFrame, wanted: bytes) -> DataFrame:
    """(key, hits) of the texts that hold terms whose bit is set, outside of base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(1)):
                h, owner, starts, ends = terms(data, at)
                use = _wanted(bits, h)
                h, owner, starts, ends = h[use].view(np.int64), owner[use], starts[use], ends[use]
                signs = _signs(data, at)
                rows, hits = [], []
                for d, first in zip(*np.unique(owner, return_index=True)):
                    own = slice(first, np.searchsorted(owner, d, "right"))
                    stays = np.ones(own.stop - own.start, bool)
                    if signs[d, :2].any():
                        text = _text(data, at, d)
                        stays = outside(text, base_spans(text, tuple(signs[d].tolist())), starts[own], ends[own])
                    rows.append(lo + d)
                    hits.append([
                        {"term": x, "start": a, "end": b}
                        for x, a, b in zip(h[own][stays].tolist(), starts[own][stays].tolist(), ends[own][stays].tolist())
                    ])
                yield W.record_batch(
                    key=batch.column(0).take(pa.array(rows, pa.int64())), hits=pa.array(hits, _HITS)
                )

    return _rows(docs).select("key", "text").mapInArrow(
        run, "key long, hits array<struct<term:long,start:long,end:long>>"
    )


def disclosing(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(term, disclosure) of the terms from ``DISCLOSURE`` on, by the entity that each discloses most."""
    seen = scanned.select(F.explode("entities").alias("entity"), "context", "terms")
    known = (
        seen.groupBy("entity", "context").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_entity"))
        .filter(c("texts") >= LEAST_TEXTS).drop("texts")
    )
    pairs = cut_lineage(
        seen.join(known, "entity").select("entity", "n_entity", "context", F.explode("terms").alias("term"))
        .groupBy("entity", "n_entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "n_entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("together"))
        .filter(c("texts") >= LEAST_TEXTS)
    )
    if pairs.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("disclosure"))
    counts = _document_terms(docs, _bit_map(pairs.select("term").distinct())).groupBy("term").agg(
        F.sum("n").alias("n_term")
    )
    own = F.least(c("n_entity") / F.lit(float(max(scanned.count(), 2))), F.lit(0.999))
    given = F.least(c("together") / F.greatest("n_term", "together"), F.lit(1.0))
    strength = F.log(given / own) / -F.log(own) * c("texts") / (c("texts") + SHRINK)
    return (
        pairs.join(counts, "term").select("term", strength.alias("disclosure"))
        .filter(c("disclosure") >= DISCLOSURE).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    )


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, terms) of every row: base spans, and disclosing terms with their strength."""
    scanned = cut_lineage(scan(docs))
    told = cut_lineage(disclosing(docs, scanned))
    none = F.array().cast("array<struct<start:bigint,end:bigint,disclosure:double>>")
    if told.isEmpty():
        return scanned.select("doc_id", "key", "base", none.alias("terms"))
    hits = (
        _places(docs, _bit_map(told)).select("key", F.explode("hits").alias("x")).select("key", "x.*")
        .join(told, "term")
        .groupBy("key", "start", "end").agg(F.max("disclosure").alias("disclosure"))
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
    )
    return scanned.select("doc_id", "key", "base").join(hits, "key", "left").select(
        "doc_id", "key", "base", F.coalesce("terms", none).alias("terms")
    )


def _digest(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(
            ":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"]
        )), ",",
    )


def _of_kind(kind: int):
    return lambda x: x["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """Counts per kind, digest of the base spans, and all spans of every document."""
    extra = F.transform(
        "terms", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end"))
    )
    counts = [
        F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)
    ]
    return find(docs).select(
        "doc_id", *counts, F.sha2(_digest(c("base")), 256).alias("base_sha256"),
        _digest(F.array_sort(F.concat("base", extra))).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """Documents whose text has spans replaced by their kind and the strongest terms removed."""
    found = find(docs).select("key", "base", "terms").dropDuplicates(["key"])
    keyed = docs.select(
        F.struct(*[c(x) for x in docs.columns if x != "text"], F.lit(0).alias("_")).alias("row"),
        c("text").cast("string").alias("text"), F.xxhash64(c("doc_id").cast("long"), "text").alias("key"),
    ).join(found, "key", "left").select("row", "text", "base", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, (base, terms) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                cuts = [(x["start"], x["end"], f"<{KINDS[x['kind']].upper()}>") for x in base or []]
                cuts += [(x["start"], x["end"], "" if x["disclosure"] >= REMOVE else "<TERM>") for x in terms or []]
                last, parts = 0, []
                for start, end, name in sorted(cuts):
                    if start >= last:
                        parts += [texts[i][last:start], name]
                        last = end
                if parts:
                    texts[i] = "".join([*parts, texts[i][last:]])
            yield W.record_batch(row=batch.column(0), text=pa.array(texts, pa.string()))

    made = keyed.mapInArrow(run, keyed.select("row", "text").schema)
    return made.select(*[c("text") if x == "text" else c("row").getField(x).alias(x) for x in docs.columns])
