"""Best-fit packing of tokenised documents with matching of large pieces.

1. Every text becomes token ids and an end id. A document longer than the capacity is
   cut into full pieces; the first may be shorter.
2. Only the counts of pieces by length (as many as the capacity) reach the driver.
   There, pieces above a third of the capacity are matched greedily, the longest with
   the longest partner that fits, so that at most two share a bin; then the smaller
   lengths, longest first, go to the tightest gap. Equal bins are one group with a
   count: work and plan depend on the capacity, not on the number of documents.
3. A piece's rank among those of its length (a count per task plus a running sum over
   tasks) picks its place in the plan.

Null text is empty: its one piece is the end id. Repeated rows are packed each on its
own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import words as W

c = F.col

CAPACITY = 1024
END = 2

#: Words as byte-level vocabularies of this family split them.
SPLIT = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)

_encoders: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_names() -> dict[str, int]:
    """Byte of each character that stands for one in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Encoder:
    """Token ids by the vocabulary file ``path`` of the tokenizers library.

    The file's entries in order of their ids are its merge ranks, so the faster
    encoder below gives the same ids (tests compare them); what it can't take,
    such as endless white space, goes to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        special = {x["content"] for x in told["added_tokens"]}
        names = _byte_names()
        ranks = {
            bytes(names[x] for x in token): k for token, k in told["model"]["vocab"].items() if token not in special
        }
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def ids(self, text: str) -> np.ndarray:
        try:
            made = self.fast.encode_ordinary(text)
        except BaseException as error:  # noqa: BLE001  the encoder's own panic is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            made = self.model.encode(text, add_special_tokens=False).ids
        return np.array([*made, END], "<u4")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Pieces of every document, numbered by length inside their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for lo, hi, _, _ in W.blocks(batch.column(1)):
                ids = batch.column(0)[lo:hi].to_pylist()
                rows: list[tuple] = []
                for doc, text in zip(ids, batch.column(1)[lo:hi].to_pylist()):
                    made = encoder.ids(text or "")
                    at, first = 0, len(made) % capacity or capacity
                    for k in range(-(-len(made) // capacity)):
                        size = capacity if k else first
                        rank = seen.get(size, 0)
                        seen[size] = rank + 1
                        rows.append((doc, k, at, size, zlib.crc32(made[at : at + size].tobytes()), rank))
                        at += size
                doc, piece, start, length, crc, rank = zip(*rows)
                yield W.record_batch(
                    doc_id=pa.array(doc, pa.int64()), piece=pa.array(piece, pa.int32()),
                    start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()),
                    ids_crc32=pa.array(crc, pa.int64()), task=pa.array([task] * len(doc), pa.int64()),
                    rank=pa.array(rank, pa.int64()),
                )

    rows = docs.select(c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Groups of equal bins, (number of bins, lengths in each), that hold all pieces."""
    left = {k: n for k, n in counts.items() if n > 0}
    by_gap: dict[int, list[list]] = {}

    def put(n: int, content: list[int]) -> None:
        by_gap.setdefault(capacity - sum(content), []).append([n, content])

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for size in large:
        for other in large:
            if not left[size]:
                break
            if other > capacity - size or not left[other]:
                continue
            n = left[size] // 2 if other == size else min(left[size], left[other])
            if n:
                left[size] -= n
                left[other] -= n
                put(n, [size, other])
        if left[size]:
            put(left[size], [size])
            left[size] = 0
    for size in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        more = left[size]
        while more:
            gap = min((g for g in by_gap if g >= size), default=None)
            if gap is None:
                per = capacity // size
                if more >= per:
                    put(more // per, [size] * per)
                if more % per:
                    put(1, [size] * (more % per))
                break
            group = by_gap[gap][-1]
            n = min(more, group[0])
            if n == group[0]:
                by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
            else:
                group[0] -= n
            put(n, [*group[1], size])
            more -= n
    return [(n, content) for gap in sorted(by_gap) for n, content in by_gap[gap]]


def placements(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence and offset of every run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for n, content in bins:
        offset = 0
        for size in content:
            runs.setdefault(size, []).append((used.get(size, 0), first, offset))
            used[size] = used.get(size, 0) + n
            offset += size
        first += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and offset."""
    made = cut_lineage(pieces(docs, tokenizer or default_tokenizer(), capacity))
    counts = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(placements(plan_bins(totals, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = made.join(starts, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (c("rank") + c("before")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                mine = length == size
                low, base, place = shared.value[int(size)]
                at = np.searchsorted(low, rank[mine], "right") - 1
                sequence[mine], offset[mine] = base[at] + rank[mine] - low[at], place[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
