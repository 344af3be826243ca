"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters (A-Z made small) give n-grams of one to three, hashed to ``BUCKETS``
columns. Training counts them per language in one pass; every task adds into
dense vectors, which are summed by pieces, so that no task receives more than a
piece of one language. The matrix of log probabilities (languages x ``BUCKETS``
x 4 bytes, refused above ``MOST_BYTES``) is broadcast; a batch is scored with
gathers and running sums in numpy.

Null text and text without a letter: ``und``, score 0. Rows whose language is
null teach nothing. Ties go to the first language in code point order. No
training rows: ``und`` for all. A repeated row is scored like its twin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import fold

c = F.col

ORDERS = 3
BITS = 16
BUCKETS = 1 << BITS
PIECE = 1 << 10
SMOOTHING = 0.5
MOST_BYTES = 256 << 20
FOLDS, HELD = 3, 1
UNKNOWN = "und"


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points with A-Z made small, offsets in code points) of a block."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    text = W.LOWER[data].tobytes().decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), heads[at]


def gram_buckets(chars: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at every character, for n = 1, 2, 3."""
    h = chars.astype(np.uint32) * np.uint32(0x9E3779B1)
    out = []
    for n in range(1, ORDERS + 1):
        out.append(((h ^ np.uint32(n * 0x51ED27)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int32))
        if n < ORDERS:
            size = max(len(chars) - n, 0)
            h = h[:size] * np.uint32(0xC2B2AE35) + chars[n : n + size] * np.uint32(0x27D4EB2F)
    return out


def _starts_in(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` characters start an n-gram inside their document."""
    inside = np.ones(size, bool)
    for k in range(1, n):
        tail = at[1:] - k
        inside[tail[(tail >= at[:-1]) & (tail < size)]] = False
    return inside


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, data, at in W.blocks(batch.column(1)):
            chars, at = characters(data, at)
            grams = gram_buckets(chars)
            of = np.array(langs[lo:hi], object)
            for lang in set(of.tolist()):
                mine = np.repeat(of == lang, np.diff(at))
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for n, g in enumerate(grams, 1):
                    use = mine[: len(g)] & _starts_in(at, n, len(chars))[: len(g)]
                    total += np.bincount(g[use], minlength=BUCKETS)
                docs[lang] = docs.get(lang, 0) + int((of == lang).sum())
    for lang, total in sums.items():
        pieces = total.reshape(-1, PIECE)
        yield W.record_batch(
            lang=pa.array([lang] * len(pieces)), piece=np.arange(len(pieces), dtype=np.int32),
            docs=np.full(len(pieces), docs[lang], np.int64),
            counts=pa.array([x.tobytes() for x in pieces], pa.binary()),
        )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, np.ndarray] = {}
    docs: dict[tuple, int] = {}
    for batch in batches:
        for lang, piece, n, counts in zip(*[x.to_pylist() for x in batch.columns]):
            key, more = (lang, piece), np.frombuffer(counts, np.int64)
            sums[key] = sums[key] + more if key in sums else more
            docs[key] = docs.get(key, 0) + n
    if sums:
        yield W.record_batch(
            lang=pa.array([k[0] for k in sums]), piece=np.array([k[1] for k in sums], np.int32),
            docs=np.array([docs[k] for k in sums], np.int64),
            counts=pa.array([x.tobytes() for x in sums.values()], pa.binary()),
        )


COUNTED = "lang string, piece int, docs long, counts binary"


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities by language and bucket)."""
    rows = docs.select(c("lang").cast("string").alias("lang"), c("text").cast("string").alias("text")).filter(
        c("lang").isNotNull() & c("text").isNotNull()
    )
    summed = (
        rows.mapInArrow(_count, COUNTED).repartition("lang", "piece").mapInArrow(_add, COUNTED)
    )
    counts: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for row in summed.toLocalIterator():
        if row.lang not in counts:
            if (len(counts) + 1) * BUCKETS * 4 > MOST_BYTES:
                raise ValueError("more languages than the matrix of log probabilities may hold")
            counts[row.lang] = np.zeros(BUCKETS, np.float64)
        counts[row.lang][row.piece * PIECE : (row.piece + 1) * PIECE] += np.frombuffer(row.counts, np.int64)
        seen[row.lang] = row.docs
    langs = sorted(counts)
    table = np.array([counts[x] for x in langs]).reshape(-1, BUCKETS) + SMOOTHING
    logs = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
    share = np.array([seen[x] for x in langs], float)
    return langs, np.log(share / share.sum()) if langs else share, logs


def score_block(data, at, priors: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log joint probability, document x language."""
    chars, at = characters(data, at)
    grams = gram_buckets(chars)
    inside = [_starts_in(at, n, len(chars))[: len(g)] for n, g in enumerate(grams, 1)]
    out = np.empty((len(at) - 1, len(priors)))
    run = np.zeros(len(chars) + 1)
    for k, row in enumerate(logs):
        total = row[grams[0]]
        for g, use in zip(grams[1:], inside[1:]):
            total[: len(g)] += np.where(use, row[g], 0)
        np.cumsum(total, dtype=np.float64, out=run[1:])
        out[:, k] = run[at[1:]] - run[at[:-1]] + priors[k]
    return out


def predict(docs: DataFrame, langs: list[str], priors: np.ndarray, logs: np.ndarray) -> DataFrame:
    """``lang_pred`` and ``score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, priors, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, priors, logs = shared.value
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(1)):
                said = batch.column(1)[lo:hi].to_pylist()
                known = [bool(names) and x is not None and any(map(str.isalpha, x)) for x in said]
                pred, score = [UNKNOWN] * len(said), np.zeros(len(said))
                if any(known):
                    log = score_block(data, at, priors, logs)
                    best = log.argmax(1)
                    p = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
                    for i in np.flatnonzero(known):
                        pred[i], score[i] = names[best[i]], p[i]
                yield W.record_batch(
                    doc_id=batch.column(0)[lo:hi], lang_pred=pa.array(pred, pa.string()), score=score
                )

    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on all but fold ``HELD`` and predict every document."""
    model = train(docs.filter(fold("doc_id", FOLDS) != HELD))
    return predict(docs, *model).withColumn("held_out", fold("doc_id", FOLDS) == HELD)
