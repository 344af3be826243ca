"""Toxicity: many voters, a generative label model, and a linear classifier on its posteriors.

1. A lexicon is learned from at most ``SAMPLE`` labelled rows outside the held-out
   fold: words and word beginnings that are far commoner in toxic texts.
2. Voters fire on slices of the lexicon and on patterns (capitals, marks, masked
   letters, several hits). A document's votes are one bit mask; the table of masks
   has at most 2 ** voters rows, whatever the corpus.
3. Expectation-maximisation over that table of all documents estimates how often each
   voter fires on toxic and on other texts. Correlations of voters inside a class
   (beyond what the class explains) discount votes that say the same thing twice.
4. A logistic regression on hashed words, beginnings and voter counts is trained on
   the posterior labels of at most ``STUDENTS`` documents outside the held-out fold,
   and scores every whole text.

Null text is an empty text and gets the score of one. Repeated rows get equal
scores. Without toxic labelled rows the lexicon is empty and scores are the prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W
from .tables import fold, label_sample, only_ids

c = F.col

SAMPLE = 16_000
STUDENTS = 6_000
LEXICON = 600
#: A lexicon entry is in at least so many of the toxic texts, and in this share of them.
LEAST_TOXIC, LEAST_SHARE = 3, 0.01
LEAST_LOG_ODDS = 2.5
BEGINNINGS = (4, 6)
WORD_VOTERS, START_VOTERS = 6, 4
PATTERNS = ("capitals", "marks", "masked", "several", "dense")
VOTERS = WORD_VOTERS + START_VOTERS + len(PATTERNS)
#: Once fitted, a voter that doesn't fire is taken as half an abstention.
SILENCE = 0.5
BITS = 17
COLUMNS = (1 << BITS) + VOTERS
FOLDS, HELD = 5, 0
TOXIC_FROM = 0.5

#: ASCII letters and all bytes of other letters belong to words.
_SEPARATORS = W.byte_table(bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_CAPITAL = W.byte_table(bytes(range(65, 91)))
_SMALL = W.byte_table(bytes(range(97, 123)))
_MARK = W.byte_table(b"!?")
_MASK = W.byte_table(b"*#$%@")


def keys(data: np.ndarray, at: np.ndarray):
    """(document, key) of every distinct word and word beginning of a block."""
    small = W.LOWER[data]
    starts, ends = W.bounds(small, at, _SEPARATORS)
    owner = W.owners(W.per_document(starts, at)).astype(np.uint64)
    found = [(owner, W.hashes(small, starts, ends))]
    for size in BEGINNINGS:
        long = ends - starts > size
        cut = starts[long] + size
        found.append((owner[long], W.mix(W.hashes(small, starts[long], cut) + np.uint64(size))))
    doc = np.concatenate([x[0] for x in found])
    key = np.concatenate([x[1] for x in found])
    kind = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    order = np.lexsort((key, doc))
    doc, key, kind = doc[order].astype(np.int64), key[order], kind[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], key[new], kind[new]


def learn_lexicon(docs: DataFrame, labels: dict[int, int]) -> dict:
    """Keys that mark toxic texts, sorted, with the voter each belongs to."""
    shared = docs.sparkSession.sparkContext.broadcast(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, at in W.blocks(batch.column(1)):
                toxic = np.array([shared.value[x] for x in ids[lo:hi]], np.int64)
                doc, key, kind = keys(data, at)
                known, where, n = np.unique(key, return_inverse=True, return_counts=True)
                bad = np.bincount(where, toxic[doc], len(known)).astype(np.int64)
                of = np.zeros(len(known), np.int64)
                of[where] = kind
                yield W.record_batch(
                    key=known.view(np.int64), kind=of.astype(np.int32), toxic=bad, others=n - bad
                )

    rows = docs.select("doc_id", "text")
    made = only_ids(rows, list(labels)).mapInArrow(run, "key long, kind int, toxic long, others long")
    n_toxic = sum(labels.values())
    n_others = len(labels) - n_toxic
    least = max(LEAST_TOXIC, LEAST_SHARE * n_toxic)
    odds = F.log((c("toxic") + 0.5) / (n_toxic + 1)) - F.log((c("others") + 0.5) / (n_others + 1))
    best = (
        made.groupBy("key", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))
        .filter((c("toxic") >= least) & (odds >= LEAST_LOG_ODDS))
        .orderBy((odds * c("toxic")).desc(), "key").limit(LEXICON).collect()
    )
    seen = {0: 0, 1: 0}
    entries = []
    for row in best:
        kind = min(row.kind, 1)
        size = START_VOTERS if kind else WORD_VOTERS
        entries.append((row.key, kind * WORD_VOTERS + seen[kind] % size))
        seen[kind] += 1
    known = np.array([x[0] for x in entries], np.int64).view(np.uint64)
    order = np.argsort(known)
    return {"keys": known[order], "voter": np.array([x[1] for x in entries], np.int64)[order]}


def block_votes(lexicon: dict, data, at, doc, key) -> np.ndarray:
    """Times each voter fires, document x voter (patterns: 0 or 1)."""
    docs = len(at) - 1
    out = np.zeros((docs, VOTERS))
    if len(lexicon["keys"]) and len(key):
        place = np.minimum(np.searchsorted(lexicon["keys"], key), len(lexicon["keys"]) - 1)
        hit = lexicon["keys"][place] == key
        np.add.at(out, (doc[hit], lexicon["voter"][place[hit]]), 1)
    hits = out[:, : WORD_VOTERS + START_VOTERS].sum(1)
    words = np.maximum(np.bincount(doc, minlength=docs), 1)
    capital, small = W.counted(_CAPITAL[data], at), W.counted(_SMALL[data], at)
    said = {
        "capitals": capital > small,
        "marks": W.counted(_MARK[data], at) * 5 > words,
        "masked": W.counted(_MASK[data], at) * 2 > words,
        "several": hits >= 3,
        "dense": hits * 50 > words,
    }
    for k, name in enumerate(PATTERNS):
        out[:, WORD_VOTERS + START_VOTERS + k] = said[name]
    return out


def vote_masks(docs: DataFrame, lexicon: dict) -> DataFrame:
    """(doc_id, mask) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(1)):
                doc, key, _ = keys(data, at)
                fired = block_votes(shared.value, data, at, doc, key) > 0
                yield W.record_batch(
                    doc_id=batch.column(0)[lo:hi], mask=(fired @ (1 << np.arange(VOTERS))).astype(np.int64)
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, mask long")


def _fired(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(VOTERS) & 1).astype(float)


def _evidence(fired: np.ndarray, weight: np.ndarray, rate: np.ndarray, silence: float) -> np.ndarray:
    """Log likelihood by class; ``silence`` is what it counts that a voter doesn't fire."""
    return (fired * weight) @ np.log(rate.T) + silence * ((1 - fired) * weight) @ np.log1p(-rate.T)


def fit_label_model(masks: np.ndarray, counts: np.ndarray, rounds: int = 200) -> dict:
    """Rates at which voters fire by class, weights after correlations, share of toxic."""
    fired = _fired(masks)
    total = max(counts.sum(), 1.0)
    start = np.repeat([[0.005], [0.3]], VOTERS, 1)
    start[:, WORD_VOTERS + START_VOTERS :] = [[0.05], [0.06]]
    rate, share, weight = start.copy(), 0.1, np.ones(VOTERS)
    lexicon_bits = (1 << (WORD_VOTERS + START_VOTERS)) - 1
    toxic = np.where(masks & lexicon_bits, 0.9, 0.02)
    post = np.stack([1 - toxic, toxic], 1)
    pull = 1e-4 * total + 1
    link = np.zeros((VOTERS, VOTERS))
    for _ in range(rounds):
        weighed = post * counts[:, None]
        size = weighed.sum(0)
        made = (weighed.T @ fired + pull * start) / (size[:, None] + pull)
        share = float((size[1] + 1) / (total + 2))
        moved, rate = np.abs(made - rate).max(), made
        # What two voters share beyond the class: mean of their correlations inside it.
        link = np.zeros((VOTERS, VOTERS))
        for k in (0, 1):
            off = fired - rate[k]
            spread = (off * weighed[:, [k]]).T @ off / max(size[k], 1e-9)
            dev = np.sqrt(np.maximum(np.diag(spread), 1e-12))
            link += 0.5 * np.clip(spread / np.outer(dev, dev), 0, 1)
        np.fill_diagonal(link, 0)
        weight = 1 / (1 + link.sum(1))
        log = np.log([1 - share, share]) + _evidence(fired, weight, rate, 1)
        post = np.exp(log - log.max(1, keepdims=True)) if len(log) else log
        post /= post.sum(1, keepdims=True)
        if moved < 1e-8:
            break
    return {"rate": rate, "share": share, "weight": weight, "correlation": link}


def posterior(model: dict, masks: np.ndarray) -> np.ndarray:
    log = _evidence(_fired(masks), model["weight"], model["rate"], SILENCE)
    share = model["share"]
    return 1 / (1 + np.exp(log[:, 0] - log[:, 1] - np.log(share / (1 - share))))


def features(lexicon: dict, data, at):
    """(document, column, value): hashed keys, then capped voter counts."""
    doc, key, _ = keys(data, at)
    votes = block_votes(lexicon, data, at, doc, key)
    per = np.bincount(doc, minlength=len(at) - 1)
    column = (key >> np.uint64(64 - BITS)).astype(np.int64)
    d, v = np.nonzero(votes)
    doc = np.concatenate([doc, d])
    column = np.concatenate([column, (1 << BITS) + v])
    value = np.concatenate([1 / np.sqrt(np.maximum(per, 1))[doc[: len(doc) - len(d)]], np.minimum(votes[d, v], 3)])
    return doc, column, value


def train_classifier(docs: DataFrame, lexicon: dict, targets: dict[int, float]) -> dict:
    """Logistic regression on soft labels of a bounded sample, by adaptive gradients."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(1)):
                doc, col, value = features(shared.value, data, at)
                order = np.argsort(doc, kind="stable")
                doc, col, value = doc[order], col[order].astype(np.int32), value[order].astype(np.float32)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                pairs = list(zip(cut[:-1], cut[1:]))
                yield W.record_batch(
                    doc_id=batch.column(0)[lo:hi],
                    cols=pa.array([col[a:b].tobytes() for a, b in pairs], pa.binary()),
                    vals=pa.array([value[a:b].tobytes() for a, b in pairs], pa.binary()),
                )

    made = only_ids(docs.select("doc_id", "text"), list(targets)).mapInArrow(
        run, "doc_id long, cols binary, vals binary"
    )
    rows = sorted(made.dropDuplicates(["doc_id"]).collect(), key=lambda r: r.doc_id)
    model = {"bias": -2.0, "weight": np.zeros(COLUMNS)}
    if not rows:
        return model
    cols = [np.frombuffer(r.cols, np.int32) for r in rows]
    vals = [np.frombuffer(r.vals, np.float32).astype(float) for r in rows]
    want = np.array([targets[r.doc_id] for r in rows])
    rng = np.random.default_rng(11)
    past, past_bias = np.full(COLUMNS, 1e-2), 1e-2
    for _ in range(15):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 200):
            part = order[lo : lo + 200]
            col, val = np.concatenate([cols[i] for i in part]), np.concatenate([vals[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(cols[i]) for i in part])
            odds = model["bias"] + np.bincount(doc, model["weight"][col] * val, len(part))
            slope = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - want[part]) / len(part)
            step = np.bincount(col, slope[doc] * val, COLUMNS) + 1e-6 * model["weight"]
            past += step * step
            model["weight"] -= 0.2 * step / np.sqrt(past)
            past_bias += slope.sum() ** 2
            model["bias"] -= 0.2 * slope.sum() / np.sqrt(past_bias)
    return model


def score(docs: DataFrame, lexicon: dict, model: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value
        for batch in batches:
            for lo, hi, data, at in W.blocks(batch.column(1)):
                doc, col, value = features(lexicon, data, at)
                odds = model["bias"] + np.bincount(doc, model["weight"][col] * value, hi - lo)
                yield W.record_batch(
                    doc_id=batch.column(0)[lo:hi], score=1 / (1 + np.exp(-np.clip(odds, -50, 50)))
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fold, score and verdict of every document."""
    docs = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text"))
    lexicon = learn_lexicon(docs, label_sample(labels, "toxic", FOLDS, HELD, SAMPLE))
    masks = cut_lineage(vote_masks(docs, lexicon))
    table = masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()
    label_model = fit_label_model(
        np.array([r["mask"] for r in table], np.int64), np.array([r["n"] for r in table], float)
    )
    chosen = (
        masks.filter(c("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD))
        .groupBy("doc_id").agg(F.max("mask").alias("mask"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(STUDENTS).collect()
    )
    soft = posterior(label_model, np.array([r["mask"] for r in chosen], np.int64))
    model = train_classifier(docs, lexicon, {r.doc_id: float(p) for r, p in zip(chosen, soft)})
    return score(docs, lexicon, model).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score",
        (c("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )
