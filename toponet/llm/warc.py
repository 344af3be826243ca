"""WARC archives: deduplicating writer, salvage reader, log of damaged bytes.

Writing: one gzip member per record. Of records with equal payloads of at least
``least`` bytes, the one with the largest page_id is the response, the others are
revisits that name it; smaller payloads are all responses. Only ids and digests are
shuffled to decide that, with partial maxima per task; a payload that a third of all
pages share is spread over ``SALT`` join keys. Files are written by Spark's text
writer: a member is the row, and the separator is an empty gzip member, so a file is
a plain sequence of members in any file system that Spark can write.

Reading: a file is one row of ``binaryFile`` (at most 2 GB each; the writer ends a file
after ``RECORDS`` records). Each record is checked: gzip CRC, version line, length,
digests. After a failed check the reader looks for the next valid gzip member or
version line, goes on there, and logs the bytes between as a gap.

Null html is an empty payload, a null url an empty target. A null page_id is written
as an empty id and read back as null; it is never what others refer to unless no row
of that payload has an id. Repeated rows are records of their own; of equal ids one
row is the response. An empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W

c = F.col

VERSION = b"WARC/1.1"
RECORDS = 5_000
SALT = 16
#: A gzip member of no bytes.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, in four runs of 40 bits."""
    hexed = F.sha1(payload)
    runs = [
        F.translate(
            F.lpad(F.upper(F.conv(F.substring(hexed, k, 10), 16, 32)), 8, "0"),
            "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        )
        for k in (1, 11, 21, 31)
    ]
    return F.concat(*runs)


def plan_records(pages: DataFrame, least: int) -> DataFrame:
    """Pages with payload, digest, record type and what they refer to."""
    base = pages.select(
        c("page_id").cast("long").alias("page_id"), F.coalesce(c("url").cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(c("html").cast("string"), F.lit("")), "utf-8").alias("payload"),
    ).withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", digest(c("payload")))
    key = ["payload_digest", "payload_bytes"]
    several = (
        base.filter(c("payload_bytes") >= least).groupBy(*key)
        .agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).filter(c("n") > 1).drop("n")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    )
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    # A page that is the leader itself stays the response.
    return salted.join(several, [*key, "salt"], "left").select(
        "page_id", "url", "payload", *key,
        F.when(c("leader").isNotNull() & ~c("page_id").eqNullSafe(c("leader")), c("leader")).alias("refers_to"),
    )


def record_bytes(page_id, url: str, payload: bytes, payload_digest: str, refers_to, leader_url: str = "") -> bytes:
    """One record: version line, headers, block, two line ends."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (b"" if revisit else payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)
    head = [
        VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as one gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write the archive files of ``pages`` into ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few rows at a time: payloads are large.
            for lo in range(0, len(batch), 256):
                rows = batch.slice(lo, 256).to_pydict()
                made = [
                    member(record_bytes(*x))
                    for x in zip(*(rows[k] for k in ("page_id", "url", "payload", "payload_digest", "refers_to")))
                ]
                yield W.record_batch(record=pa.array(made, pa.binary()))

    rows = plan_records(pages, least).select("page_id", "url", "payload", "payload_digest", "refers_to")
    (
        rows.mapInArrow(run, "record binary").select(c("record").cast("string").alias("value"))
        .write.mode("overwrite").option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", RECORDS).text(folder)
    )


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, int] | None:
    """(fields, end) of the record at ``at``, or None where a check fails."""
    line = _VERSION_LINE.match(raw, at)
    if not line:
        return None
    head, pos = {}, line.end()
    # Line by line, so that a bad header ends the search where it goes wrong.
    while (stop := raw.find(b"\r\n", pos)) != pos:
        name, colon, value = raw[pos : max(stop, pos)].partition(b":")
        if not colon:
            return None
        head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        pos = stop + 2
    split = pos - 2
    size = head.get(b"content-length", "")
    if not size.isdigit():
        return None
    start, end = split + 4, split + 4 + int(size)
    block = raw[start:end]
    if len(block) < int(size) or raw[end : end + 4] != b"\r\n\r\n":
        return None
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    told = head.get(b"warc-block-digest", "")
    if told.startswith("sha1:") and told[5:].upper() != sha(block):
        return None
    payload = block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else block
    kind = head.get(b"warc-type", "")
    named = head.get(b"warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and named and named.upper() != sha(payload):
        return None
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    length = head.get(b"warc-payload-length", "")
    return {
        "page_id": number(head.get(b"warc-record-id", "")), "url": head.get(b"warc-target-uri"),
        "payload_bytes": int(length) if kind == "revisit" and length.isdigit() else len(payload),
        "payload_digest": named or sha(payload), "record_type": kind,
        "refers_to": number(head.get(b"warc-refers-to", "")), "payload": None if kind == "revisit" else payload,
    }, end + 4


def _inflate(view: memoryview, at: int) -> tuple[bytes, int, bool]:
    """(data, end, whole) of the gzip member at ``at``; of a damaged one what comes before the damage."""
    unpacker, parts, pos, step = zlib.decompressobj(31), [], at, 4096
    while not unpacker.eof and pos < len(view):
        piece = view[pos : pos + step]
        try:
            parts.append(unpacker.decompress(piece))
        except zlib.error:
            return _before_damage(view, at, pos, len(piece))
        pos += len(piece)
        step = min(2 * step, 1 << 20)
    return b"".join(parts), pos - len(unpacker.unused_data), unpacker.eof


def _before_damage(view: memoryview, at: int, pos: int, step: int) -> tuple[bytes, int, bool]:
    """What the member at ``at`` holds before its damage, which is in the ``step`` bytes from ``pos`` on."""
    unpacker = zlib.decompressobj(31)
    parts = [unpacker.decompress(view[at:pos])]
    while step > 1:
        step = (step + 1) // 2
        # A failed call's output is lost, so the state before it is kept.
        before = unpacker.copy()
        try:
            parts.append(unpacker.decompress(view[pos : pos + step]))
            pos += step
        except zlib.error:
            unpacker = before
    return b"".join(parts), pos, False


class _Places:
    """Where a member or a version line may begin, looked for once from front to back."""

    def __init__(self, raw: bytes):
        self._raw, self._next = raw, dict.fromkeys((_MAGIC, b"WARC/1."), -1)

    def after(self, at: int) -> int:
        """The first such place behind ``at``; calls go forward. The end of the bytes where there is none."""
        for needle, hit in self._next.items():
            if hit <= at:
                found = self._raw.find(needle, at + 1)
                self._next[needle] = found if found >= 0 else len(self._raw)
        return min(self._next.values())


_DIGEST_LINE = re.compile(rb"(?i)\r\nwarc-block-digest: *sha1:")


def _members(data: bytes, whole: bool) -> Iterator[tuple[int, int, dict | None]]:
    """(start, end, fields) of the records of inflated bytes and, with None, of the gaps between them.

    Where the member's own check failed, only records with a block digest count, and not one that ends where the
    inflated bytes end.
    """
    at = good = 0
    while at < len(data):
        one = parse_record(data, at)
        if one and (whole or one[1] < len(data) and _DIGEST_LINE.search(data, at, data.find(b"\r\n\r\n", at))):
            if good < at:
                yield good, at, None
            yield at, one[1], one[0]
            at = good = one[1]
            continue
        near = data.find(b"WARC/1.", at + 1)
        at = near if near >= 0 else len(data)
    if good < len(data):
        yield good, len(data), None


def salvage(raw: bytes) -> Iterator[tuple[str, int, int, dict | None]]:
    """("record", start, end, fields) and ("gap", start, end, None) of an archive, in order.

    Members and records that pass all checks are taken; from anything else on, the
    next place where a member or a version line is valid is looked for, in inflated
    bytes too. A gap inside a member has the member's bounds, and in place of None its
    own ones in the inflated bytes as ``inner_start`` and ``inner_end``.
    """
    at = good = 0
    view, places = memoryview(raw), _Places(raw)
    while at < len(raw):
        found, end = [], 0
        if raw.startswith(_MAGIC, at):
            data, stop, whole = _inflate(view, at)
            found = list(_members(data, whole))
            if whole and not data or any(x[2] for x in found):
                # A cut member runs on into the bytes of the next one.
                end = stop if whole else min(stop, places.after(at))
        elif one := parse_record(raw, at):
            found, end = [(at, one[1], one[0])], one[1]
        if end:
            if good < at:
                yield "gap", good, at, None
            for start, stop, fields in found:
                if fields:
                    yield "record", at, end, fields
                else:
                    yield "gap", at, end, {"inner_start": start, "inner_end": stop}
            at = good = end
            continue
        at = places.after(at)
    if good < len(raw):
        yield "gap", good, len(raw), None


READ = (
    "path string, kind string, start long, end long, page_id long, url string, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long, payload binary, inner_start long, inner_end long"
)
_TYPES = [
    ("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ("inner_start", pa.int64()), ("inner_end", pa.int64()),
]


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives of ``folder``; without ``payloads`` that column is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                path, rows, held = batch.column(0)[i].as_py(), [], 0
                for kind, start, end, fields in salvage(batch.column(1)[i].as_py()):
                    row = {"path": path, "kind": kind, "start": start, "end": end, **(fields or {})}
                    held += len(row.get("payload") or b"")
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) == 1000 or held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(_TYPES))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(_TYPES))

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, READ)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` to ``folder`` and return the records that are read back."""
    write(pages, folder)
    found = read(pages.sparkSession, folder, payloads=False).filter(c("kind") == "record")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
