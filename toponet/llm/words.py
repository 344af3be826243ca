"""Vectorised words of whole texts, straight from Arrow string buffers.

A batch is walked in blocks of whole documents of at most ``BLOCK`` bytes (one
longer document is a block of its own). Words are found with byte tables, which
is exact for classes that only name ASCII separators, and each gets a 64-bit
hash from one running polynomial, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
#: Bytes hashed with one table of powers; a word longer than this gets larger tables.
SPAN = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def byte_table(chars: bytes) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Separators of ``[^\x20\x09-\x0D]+``.
WHITE = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: ASCII capitals to small letters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(n, SPAN)
    if "up" not in _tables or len(_tables["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents."""
    if not len(column):
        return
    data, at = buffers(column)
    lo, rows = 0, len(column)
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def bounds(data: np.ndarray, at: np.ndarray, separators: np.ndarray):
    """(starts, ends) of the words; none crosses from one document into the next."""
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    head, tail = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
    first[head] = inside[head]
    last[tail] = inside[tail]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + SPAN, "right")))
        stop = int(ends[hi - 1])
        up, down = _powers(stop - base + 1)
        run = np.empty(stop - base + 1, np.uint64)
        run[0] = 0
        np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=run[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (run[e] - run[s]) * down[s]
        lo = hi
    return mix(out)


def per_document(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Position in ``starts`` of each document's first word, and the end."""
    return np.searchsorted(starts, at)


def owners(word_at: np.ndarray) -> np.ndarray:
    """Document number of every word."""
    return np.repeat(np.arange(len(word_at) - 1), np.diff(word_at))


def counted(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each document."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, dtype=np.int64, out=run[1:])
    return run[at[1:]] - run[at[:-1]]


def windows(h: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of ``width`` words inside one document."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k : k + n]
    first = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(out[first]), first


def record_batch(**columns) -> pa.RecordBatch:
    """Record batch of numpy or Arrow columns."""
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns)
    )
