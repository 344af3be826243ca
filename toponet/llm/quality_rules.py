"""Quality rules that vote; a label model turns the votes into one probability.

Each rule votes 1 (fine), -1 (poor) or 0 (abstain) from counts of the whole text.
Expectation-maximisation over the table of vote patterns (at most 3 to the
number of rules, whatever the corpus) estimates each rule's two error rates (how
often it condemns good documents and passes poor ones) and the share of good
documents. A document's posterior probability replaces the demand that it pass
every rule: a rule that often condemns what all others pass is outvoted.

Null or empty text: all counts 0. A repeated row is scored like its twin. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W

c = F.col

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
#: Where the estimates start, and what a few invented documents say beside the real ones:
#: share of condemning votes among a rule's votes on poor and on good documents.
START = (0.3, 0.01)
#: Weight of those invented documents, as a share of the corpus.
PRIOR_SHARE = 0.002

_SYMBOLS = W.byte_table(b"[#*$%&|<>]"[1:-1])
_UPPER = W.byte_table(bytes(range(65, 91)))
_SMALL = W.byte_table(bytes(range(97, 123)))
_LINE_END = W.byte_table(b"\n")
_BANG = W.byte_table(b"!?")
_FIRST = np.ones(256, bool)
_FIRST[0x80:0xC0] = False

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_small", "n_marks", "n_bars", "n_lines", "n_marked", "n_distinct",
]
SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS)


def rule_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """``block_counts`` with the words that hold a symbol and the different words."""
    starts, ends = W.bounds(data, at, W.WHITE)
    word_at = W.per_document(starts, at)
    owner = W.owners(word_at)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data], dtype=np.int32)])
    h = W.hashes(data, starts, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first = np.unique(h, return_index=True)
    return block_counts(data, at) | {
        "n_marked": W.counted(symbols[ends] > symbols[starts], word_at),
        "n_distinct": np.bincount(owner[first], minlength=len(at) - 1),
    }


def block_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every document of a block."""
    starts, ends = W.bounds(data, at, W.WHITE)
    word_at = W.per_document(starts, at)
    owner = W.owners(word_at)
    h = W.hashes(data, starts, ends)
    grams, first = W.windows(h, owner, 3)
    covered = np.zeros(len(h), bool)
    if len(grams):
        _, inverse, count = np.unique(
            grams + owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15),
            return_inverse=True, return_counts=True,
        )
        again = first[count[inverse] > 1]
        for k in range(3):
            covered[again + k] = True
    twins, lines = [], []
    raw = data.tobytes()
    for lo, hi in zip(at[:-1], at[1:]):
        said = [x for x in raw[lo:hi].split(b"\n") if x.strip()]
        twins.append(len(said) - len(set(said)))
        lines.append(len(said))
    single = (ends - starts == 1) & (data[starts] == 0x7C)
    return {
        "n_words": np.diff(word_at),
        "word_chars": W.counted(~W.WHITE[data] & _FIRST[data], at),
        "n_symbols": W.counted(_SYMBOLS[data], at),
        "n_dup_lines": np.array(twins, np.int64),
        "n_repeat_words": W.counted(covered, word_at),
        "n_upper": W.counted(_UPPER[data], at),
        "n_small": W.counted(_SMALL[data], at),
        "n_marks": W.counted(_BANG[data], at),
        "n_bars": W.counted(single, word_at),
        "n_lines": np.array(lines, np.int64),
    }


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in W.blocks(batch.column(1)):
            made = rule_counts(data, at)
            yield W.record_batch(
                doc_id=batch.column(0)[lo:hi],
                **{k: v.astype(np.int64) for k, v in made.items()},
            )


def text_counts(docs: DataFrame) -> DataFrame:
    """One row of counts per document."""
    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_batches, SCHEMA)


def base_failed() -> Column:
    return (c("n_words") < MIN_WORDS) | (
        100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")
    )


def rules() -> dict[str, Column]:
    """Votes by rule; a rule abstains between its two limits and where it can't tell."""

    def by(ratio: Column, fine: float, poor: float, known: Column) -> Column:
        return (
            F.when(~known, 0).when(ratio >= poor, -1).when(ratio <= fine, 1).otherwise(0)
        )

    spoken, letters = c("n_words") >= 10, c("n_upper") + c("n_small")
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    length = share(c("word_chars"), c("n_words"))
    alike = 1 - share(c("n_distinct"), c("n_words"))
    return {
        "symbols": by(share(c("n_symbols"), c("word_chars")), 0.02, 0.06, spoken),
        "capitals": by(share(c("n_upper"), letters), 0.15, 0.5, spoken & (letters >= 20)),
        "marks": by(share(c("n_marks"), c("n_words")), 0.05, 0.25, spoken),
        "bars": by(share(c("n_bars"), c("n_words")), 0.02, 0.2, spoken),
        "marked_words": by(share(c("n_marked"), c("n_words")), 0.02, 0.2, spoken),
        "same_lines": by(share(c("n_dup_lines"), c("n_lines")), 0.1, 0.4, c("n_lines") >= 3),
        "repeats": by(share(c("n_repeat_words"), c("n_words")), 0.2, 0.45, spoken),
        # The longer a text, the more of its words were there before.
        "same_words": by(alike, 0.4, 0.7, spoken & (c("n_words") <= 1000)),
        "word_length": F.when(~spoken, 0)
        .when((length < 2) | (length > 14), -1)
        .when((length >= 3) & (length <= 10), 1)
        .otherwise(0),
    }


def pattern(votes: dict[str, Column]) -> Column:
    """All votes as one number in base 3."""
    total = F.lit(0)
    for k, vote in enumerate(votes.values()):
        total = total + (vote + 1) * 3**k
    return total.cast("int")


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 300):
    """(log prior odds, log odds by rule and vote) of good over poor.

    ``patterns`` are numbers in base 3 with ``counts`` documents each. An
    abstention says nothing. Both shares of condemning votes are estimated; all that
    is asked of a rule is that it condemns poor documents no less often than good ones,
    which also says which class is which.
    """
    votes = np.array([[p // 3**k % 3 for k in range(n_rules)] for p in patterns], int).reshape(-1, n_rules)
    poor_vote, fine_vote = (votes == 0).astype(float), (votes == 2).astype(float)
    total = max(float(counts.sum()), 1.0)
    start = np.array(START)[:, None]
    strength = PRIOR_SHARE * total + 1
    # Begin with the old rule: whatever fails one of them is poor.
    poor = np.where(poor_vote.any(1), 0.9, 0.02) if len(votes) else np.zeros(0)
    post, condemns, good = np.stack([poor, 1 - poor], 1), np.repeat(start, n_rules, 1), 0.8
    for _ in range(rounds):
        weighed = post * counts[:, None]
        bad, both = weighed.T @ poor_vote, weighed.T @ (poor_vote + fine_vote)
        made = (bad + start * strength) / (both + strength)
        made[1] = np.minimum(made[1], made[0])
        good = float((weighed[:, 1].sum() + 1) / (total + 2))
        moved, condemns = np.abs(made - condemns).max(), made
        if moved < 1e-9:
            break
        log = (
            poor_vote @ np.log(condemns.T) + fine_vote @ np.log1p(-condemns.T)
            + np.log([1 - good, good])
        )
        post = np.exp(log - log.max(1, keepdims=True)) if len(log) else log
        post /= post.sum(1, keepdims=True)
    weights = np.zeros((n_rules, 3))
    weights[:, 0] = np.log(condemns[1] / condemns[0])
    weights[:, 2] = np.log((1 - condemns[1]) / (1 - condemns[0]))
    return float(np.log(good / (1 - good))), weights


def score_quality(docs: DataFrame) -> DataFrame:
    """Counts, posterior ``probability``, ``base_failed`` and ``kept`` per document."""
    votes = rules()
    counts = cut_lineage(text_counts(docs))
    table = counts.groupBy(pattern(votes).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).collect()
    prior, weights = fit_label_model(
        np.array([r.pattern for r in table], int), np.array([r.n for r in table], float), len(votes)
    )
    odds = F.lit(prior)
    for vote, (poor, _, fine) in zip(votes.values(), weights):
        odds = odds + F.when(vote == 1, float(fine)).when(vote == -1, float(poor)).otherwise(0.0)
    return counts.withColumn("probability", 1 / (1 + F.exp(-odds))).withColumn(
        "base_failed", base_failed()
    ).withColumn("kept", ~c("base_failed") & (c("probability") >= KEEP_FROM))
