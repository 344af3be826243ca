"""Quality classifier: a factorisation machine over words, structure and size.

Features of a whole text: its words hashed to ``WORD_BUCKETS`` columns (value:
share of the words), structure statistics cut into bands (one column per band,
value 1), and the size of the text as metadata. Every pair of features interacts
through rank-``RANK`` factors; the pair sum is half of (square of the sum minus
sum of the squares) per factor, so scoring is linear in the features present.

The model is fitted on at most ``SAMPLE`` labelled rows outside the held-out
fold (those with the smallest hash of their id) and is of fixed size. Null text
is an empty text; empty texts have the bands of zero and get a score like any
other. Repeated rows get equal scores. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .quality_rules import block_counts
from .tables import fold, label_sample, only_ids

c = F.col

WORD_BUCKETS = 1 << 11
BANDS = 8
RANK = 4
SAMPLE = 6000
ROUNDS = 40
FOLDS, HELD = 5, 0
GOOD_FROM = 0.3

#: Limits of the bands of each statistic.
_LIMITS = {
    "symbols": [0, 0.01, 0.02, 0.04, 0.08, 0.16, 0.3],
    "repeats": [0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8],
    "capitals": [0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8],
    "marks": [0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
    "bars": [0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45],
    "same_lines": [0, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8],
    "word_length": [1.5, 2.5, 3.5, 4.5, 6, 8, 12],
    "line_words": [2, 5, 10, 20, 50, 100, 300],
    "size": [0, 3, 10, 30, 100, 300, 1000],
}
COLUMNS = WORD_BUCKETS + BANDS * len(_LIMITS)


def features(data: np.ndarray, at: np.ndarray):
    """(document, column, value) of a block, sorted by document, each column once."""
    n = block_counts(data, at)
    per = lambda a, b: n[a] / np.maximum(b, 1)
    said = {
        "symbols": per("n_symbols", n["word_chars"]),
        "repeats": per("n_repeat_words", n["n_words"]),
        "capitals": per("n_upper", n["n_upper"] + n["n_small"]),
        "marks": per("n_marks", n["n_words"]),
        "bars": per("n_bars", n["n_words"]),
        "same_lines": per("n_dup_lines", n["n_lines"]),
        "word_length": per("word_chars", n["n_words"]),
        "line_words": per("n_words", n["n_lines"]),
        "size": n["n_words"].astype(float),
    }
    docs = len(at) - 1
    small = W.LOWER[data]
    starts, ends = W.bounds(small, at, W.WHITE)
    owner = W.owners(W.per_document(starts, at))
    column = (W.hashes(small, starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    key, count = np.unique(owner * WORD_BUCKETS + column, return_counts=True)
    doc, col = key // WORD_BUCKETS, key % WORD_BUCKETS
    value = count / np.maximum(n["n_words"], 1)[doc]
    parts = [(doc, col, value)]
    for k, (name, limits) in enumerate(_LIMITS.items()):
        band = np.searchsorted(np.array(limits, float), said[name], "left")
        parts.append((np.arange(docs), WORD_BUCKETS + k * BANDS + band, np.ones(docs)))
    doc, col, value = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(doc, kind="stable")
    return doc[order], col[order], value[order]


def _sums(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(doc, values, docs)


def raw_scores(model: dict, doc, col, value, docs: int) -> np.ndarray:
    """Log odds, in time linear in the features."""
    total = model["bias"] + _sums(model["weight"][col] * value, doc, docs)
    for factor in model["factors"]:
        part = factor[col] * value
        total += 0.5 * (_sums(part, doc, docs) ** 2 - _sums(part * part, doc, docs))
    return total


def fit(samples: list[tuple], labels: np.ndarray, seed: int = 7) -> dict:
    """Adaptive gradient descent on the log loss; ``samples`` are (columns, values) by row."""
    rng = np.random.default_rng(seed)
    model = {
        "bias": 0.0, "weight": np.zeros(COLUMNS),
        "factors": rng.normal(0, 0.05, (RANK, COLUMNS)),
    }
    if not len(labels):
        return {**model, "factors": np.zeros((RANK, COLUMNS))}
    mean = np.clip(labels.mean(), 0.01, 0.99)
    model["bias"] = float(np.log(mean / (1 - mean)))
    past_w, past_v, past_b = np.full(COLUMNS, 1e-3), np.full((RANK, COLUMNS), 1e-3), 1e-3
    for _ in range(ROUNDS):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 200):
            rows = order[lo : lo + 200]
            col = np.concatenate([samples[i][0] for i in rows])
            value = np.concatenate([samples[i][1] for i in rows])
            doc = np.repeat(np.arange(len(rows)), [len(samples[i][0]) for i in rows])
            odds = raw_scores(model, doc, col, value, len(rows))
            slope = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[rows]) / len(rows)
            push = slope[doc] * value
            past_b += slope.sum() ** 2
            model["bias"] -= 0.1 * slope.sum() / np.sqrt(past_b)
            step = np.bincount(col, push, COLUMNS) + 1e-5 * model["weight"]
            past_w += step * step
            model["weight"] -= 0.1 * step / np.sqrt(past_w)
            for f, factor in enumerate(model["factors"]):
                part = factor[col] * value
                whole = _sums(part, doc, len(rows))
                step = np.bincount(col, push * (whole[doc] - part), COLUMNS) + 1e-5 * factor
                past_v[f] += step * step
                factor -= 0.05 * step / np.sqrt(past_v[f])
    return model


def sampled_features(docs: DataFrame, labels: dict[int, int]) -> tuple[list[tuple], np.ndarray]:
    """Features of the sampled rows; at most one row per id and ``COLUMNS`` numbers per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(1)):
                doc, col, value = features(data, at)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                pairs = list(zip(cut[:-1], cut[1:]))
                yield W.record_batch(
                    doc_id=batch.column(0)[lo:hi],
                    cols=pa.array([col[a:b].astype(np.int32).tobytes() for a, b in pairs], pa.binary()),
                    vals=pa.array([value[a:b].astype(np.float32).tobytes() for a, b in pairs], pa.binary()),
                )

    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text"))
    rows = only_ids(rows, list(labels))
    made = rows.mapInArrow(run, "doc_id long, cols binary, vals binary").dropDuplicates(["doc_id"])
    found = sorted(made.collect(), key=lambda r: r.doc_id)
    samples = [(np.frombuffer(r.cols, np.int32), np.frombuffer(r.vals, np.float32).astype(float)) for r in found]
    return samples, np.array([labels[r.doc_id] for r in found], float)


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Model from the labelled sample outside the held-out fold."""
    sample = label_sample(labels, "quality", FOLDS, HELD, SAMPLE)
    return fit(*sampled_features(docs, sample))


def score(docs: DataFrame, model: dict, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of ``columns``) and ``score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(1)):
                doc, col, value = features(data, at)
                odds = raw_scores(shared.value, doc, col, value, hi - lo)
                yield W.record_batch(
                    row=batch.column(0)[lo:hi], score=1 / (1 + np.exp(-np.clip(odds, -50, 50)))
                )

    rows = docs.select(F.struct(*columns).alias("row"), c("text").cast("string").alias("text"))
    schema = rows.select("row", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fold, score and verdict of every document."""
    scored = score(docs.withColumn("doc_id", c("doc_id").cast("long")), train(docs, labels))
    return scored.select("row.doc_id", "score").select(
        "doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score",
        (c("score") >= GOOD_FROM).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    scored = score(docs, train(docs, labels), tuple(docs.columns))
    return scored.filter(c("score") >= GOOD_FROM).select("row.*")
