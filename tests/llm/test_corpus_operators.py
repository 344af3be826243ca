"""Operators that compare or lay out documents, against brute force on small fixtures."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from toponet.llm import line_dedup, neardup, packing, warc

ODD = [(901, None), (902, ""), (903, " \n "), (904, "one"), (905, "ONE"), (906, "one two"), (None, "one")]


def near_by_force(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets[i] = grams
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(seed, size, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(words)] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(make, prose, width, percent):
    texts = family(1, 40, 150, 9) + family(2, 30, 12, 1) + family(3, 12, 600, 40) + [prose(k, 60, 50) for k in range(20)]
    common = prose(77, 60)
    texts += [common + " " + prose(300 + k, 40) for k in range(15)] + [texts[0]] * 5
    random.Random(4).shuffle(texts)
    rows = list(enumerate(texts)) + ODD
    want = near_by_force(rows, width, percent)
    got = neardup.report(make(rows), width, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert not r.kept
            continue
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    docs = make(rows)
    left = neardup.drop_near_duplicates(docs, width, percent)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, x) in want.items() if i == x} | {None}


def test_long_lists_lose_no_link(make, monkeypatch):
    """Without leaders everything is paired by the last step, most of it from full sets."""
    monkeypatch.setattr(neardup, "LEADERS", ())
    monkeypatch.setattr(neardup, "SHORT", 4)
    texts = family(11, 50, 90, 7) + family(12, 50, 500, 30) + family(13, 30, 30, 2)
    texts += [" ".join(x.split()[: 300 + 5 * k]) for k, x in enumerate(family(14, 40, 500, 3))]
    rows = list(enumerate(texts)) + ODD
    want = near_by_force(rows, 3, 85)
    got = neardup.report(make(rows)).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {
        i: x for i, (_, x) in want.items() if i is not None
    }


def test_texts_that_share_a_passage_are_no_candidates(make, prose, monkeypatch):
    common = prose(77, 300)
    rows = [(k, common + " " + prose(1000 + k, 150, 10**6)) for k in range(200)]
    made = []
    whole = neardup._size_pairs
    monkeypatch.setattr(neardup, "LEADERS", ())
    monkeypatch.setattr(neardup, "_size_pairs", lambda *x: made.append(whole(*x).count()) or whole(*x))
    got = neardup.report(make(rows)).collect()
    assert all(r.kept for r in got) and made and sum(made) <= len(rows)


def test_no_documents(make):
    assert neardup.report(make([(1, "a")]).limit(0)).count() == 0
    assert line_dedup.report(make([(1, "a")]).limit(0)).count() == 0
    assert packing.pack(make([(1, "a")]).limit(0)).count() == 0


def test_repeated_chunks_go_but_the_first(make, prose):
    passage = " ".join(f"p{k}" for k in range(60))
    block = "\n".join(f"shared line {k} of a block that many pages hold" for k in range(9))
    rows = [(k, f"{prose(k, 48)}\n{passage}\n{prose(50 + k, 24)}") for k in range(12)]
    rows += [(100 + k, f"{prose(100 + k, 36)}\n{block}\n{prose(150 + k, 36)}") for k in range(12)]
    rows += [(200 + k, prose(200 + k, 60)) for k in range(10)] + ODD + [(907, "\u0001a\n\u0002\u0003b"), (200, prose(200, 60))]
    docs = make(rows)
    got = {(r.doc_id, r.key, i): r.text for i, r in enumerate(line_dedup.remove_repeats(docs).collect())}
    assert line_dedup.remove_repeats(docs).columns == docs.columns and len(got) == len(rows)
    text = {k[0]: v for k, v in got.items()}
    assert sum(passage in (x or "") for x in text.values()) == 1 and passage in text[0]
    whole = dict(rows)
    for k in range(1, 12):
        assert text[k] == whole[k].replace("\n" + passage, "")
        assert len(text[100 + k].split("\n")) < len(whole[100 + k].split("\n"))
    for i in [*range(200, 210), 901, 902, 903, 904, 905, 906, 907]:
        assert text[i] == whole[i]


def test_shared_block_of_short_lines_is_wholly_gone(make, prose):
    short = [[f"b{b} word{k} of a short line number {j}" for j in range(12)] for k, b in enumerate(range(8))]
    twenty = ["\n".join(" ".join(f"t{b}l{j}w{k}" for k in range(20)) for j in range(3)) for b in range(20)]
    blocks = ["\n".join(x) for x in short] + twenty + ["c1 " * 35 + "\nc2\n \n\nc3 " + "c4 " * 20]
    rows = [
        (100 * b + k, f"{prose(1000 + 10 * b + k, 36, 10**6)}\n{block}\n{prose(5000 + 10 * b + k, 24, 10**6)}")
        for b, block in enumerate(blocks) for k in range(3)
    ]
    got = {r.doc_id: r for r in line_dedup.report(make(rows)).collect()}
    for i, text in rows:
        block = blocks[i // 100]
        assert got[i].text == (text.replace(block + "\n", "") if i % 100 else text)
        assert got[i].n_removed == (block.count("\n") + 1 if i % 100 else 0)


def test_repeated_headings_and_stock_lines_stay(make, prose):
    stock = ["\n\nHistory\n\n", "\nShare this page\nPrint\nAll rights reserved\n", "\n" + " ".join(f"s{k}" for k in range(20)) + "\n" + "s " * 19 + "\n"]
    rows = [(k, stock[k % 3].join(prose(7000 + 10 * k + j, 24, 10**6) for j in range(6))) for k in range(30)]
    for r in line_dedup.report(make(rows)).collect():
        assert (r.n_removed, r.text) == (0, rows[r.doc_id][1])


def test_repeats_inside_a_document_leave_the_first(make):
    block = "\n".join(f"line {k} says a few words" for k in range(8))
    rows = [(1, f"{block}\nmiddle\n{block}\nend"), (2, "\n".join(["two words"] * 100)), (2, "\n".join(["two words"] * 100))]
    got = {r.doc_id: r.text for r in line_dedup.report(make(rows)).collect()}
    assert got[1] == f"{block}\nmiddle\nend"
    assert got[2] == "\n".join(["two words"] * 20)


def test_lines_of_equal_hashes_go_only_if_their_bytes_are_equal(make, monkeypatch):
    from pyspark.sql import functions as F

    # Hashes that tell lines apart by their length only.
    monkeypatch.setattr(line_dedup, "_hashes", lambda x: (F.xxhash64(F.length(x)), F.xxhash64(F.lit(1), F.length(x))))
    lines = {b: [f"{b}{k} " + "word " * (20 + k) for k in range(3)] for b in "abc"}
    mixed = [lines["a"][0], "\n", lines["b"][1], lines["a"][2]]
    rows = [(k, "\n".join(lines[b])) for k, b in enumerate("abc")] + [(3, "\n".join(lines["a"])), (4, "\n".join(mixed))]
    got = {r.doc_id: r for r in line_dedup.report(make(rows)).collect()}
    assert [got[k].text for k in range(3)] == [t for _, t in rows[:3]]
    assert (got[3].n_removed, got[3].text) == (3, "")
    assert lines["b"][1] in got[4].text and lines["a"][0] not in got[4].text


def test_line_dedup_equals_brute_force(make, monkeypatch):
    differ, unequal = [], line_dedup._unequal
    monkeypatch.setattr(line_dedup, "_unequal", lambda lines: differ.append(unequal(lines)) or differ[-1])
    rng = random.Random(31)
    stock = [" ".join(f"s{k}w{j}" for j in range(rng.choice([3, 9, 15, 45]))) for k in range(14)] + ["", " \t"]
    rows = [(k, "\n".join(rng.choice(stock) if rng.random() < 0.8 else f"own{k} {j}" for j in range(rng.randrange(1, 14))))
            for k in range(80)]
    split = {i: t.split("\n") for i, t in rows}
    runs = {}
    for i in sorted(split):
        said = [(p, x, len(x.split()), len(x.encode())) for p, x in enumerate(split[i]) if x.strip()]
        seen = set()
        for step in (1, -1):
            for k in range(len(said)):
                words = size = 0
                for e in range(k, len(said) if step > 0 else -1, step):
                    words, size = words + said[e][2], size + said[e][3]
                    if words >= line_dedup.LONG_WORDS or size >= line_dedup.LONG_BYTES:
                        seen.add((min(k, e), max(k, e)))
                        break
        for lo, hi in sorted(seen):
            runs.setdefault(tuple(x[1] for x in said[lo : hi + 1]), []).append((i, said[lo][0], said[hi][0]))
    gone = {i: set() for i in split}
    for places in runs.values():
        first = min(places)
        for i, lo, hi in places:
            if i != first[0] or lo > first[2]:
                gone[i].update(range(lo, hi + 1))
    got = {r.doc_id: r for r in line_dedup.report(make(rows)).collect()}
    assert sum(map(len, gone.values())) > 50 and differ[0].isEmpty()
    for i, lines in split.items():
        assert got[i].n_removed == len(gone[i])
        assert got[i].text == "\n".join(x for p, x in enumerate(lines) if p not in gone[i])


def test_very_long_text_of_lines(make):
    import time

    text = "\n".join(f"line {k} of a long text" for k in range(16_000))
    start = time.monotonic()
    got = {r.doc_id: r for r in line_dedup.report(make([(1, text), (2, text), (3, None), (4, "")])).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].text, got[3].text, got[4].text) == (0, 16_000, "", None, "")
    assert time.monotonic() - start < 60


def test_chunks_join_to_the_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", " ", "\n", "\u0001", "\u0002", "\u0003", "word " * 50]) for _ in range(20)) for _ in range(100)]
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(x,) for x in texts], "text string")
    assert [r.t for r in made.select(F.array_join(line_dedup.split_chunks(F.col("text")), "\n").alias("t")).collect()] == texts


def test_packing(make):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = [(k, "".join(rng.choice(["word", " ", "é", "\n", "don't", "123", "  ", "漢字", "<|endoftext|>"]) for _ in range(rng.randrange(400)))) for k in range(60)]
    rows += [(100, "long text " * 3000), (101, None), (102, ""), (103, " " * 5000), (103, " " * 5000)]
    model = Tokenizer.from_file(packing.default_tokenizer())
    model.encode_special_tokens = True
    want = set()
    for i, text in rows:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at, size, piece = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want.add((i, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())))
            at, size, piece = at + size, 1024, piece + 1
    got = packing.pack(make(rows)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want) + 5
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_large_pieces_pair_and_bins_are_few():
    rng = random.Random(2)
    counts = {k: rng.randrange(50) for k in range(1, 1025)}
    bins = packing.plan_bins(counts, 1024)
    held: dict[int, int] = {}
    for n, content in bins:
        assert sum(content) <= 1024 and sum(3 * x > 1024 for x in content) <= 2
        for x in content:
            held[x] = held.get(x, 0) + n
    assert held == {k: n for k, n in counts.items() if n}
    total = sum(k * n for k, n in counts.items())
    assert sum(n for n, _ in bins) <= 1.02 * total / 1024 + 1


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b", "<p>é</p>"), (2, "u", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "alone\r\n\r\nWARC/1.1\r\n"), (5, "u", "two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(warc.round_trip(pages, str(tmp_path / "a")).collect())
    assert [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got] == [
        (1, 9, "revisit", 2), (2, 9, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None),
        (5, 3, "response", None), (5, 19, "response", None),
    ]
    import base64
    import hashlib

    assert got[0].payload_digest == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    full = warc.read(spark, str(tmp_path / "a")).filter("kind = 'gap'")
    assert full.count() == 0
    assert warc.round_trip(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_salvage_finds_what_is_whole():
    records = [warc.record_bytes(k, "u", b"payload %d WARC/1.1 \x1f\x8b\x08" % k, "", None) for k in range(6)]
    for form in (lambda x: x, warc.member):
        parts = [form(x.replace(b"WARC-Payload-Digest: sha1:\r\n", b"")) for x in records]
        whole = b"".join(parts)
        assert [x[3]["page_id"] for x in warc.salvage(whole) if x[0] == "record"] == list(range(6))
        starts = np.cumsum([0, *map(len, parts)])
        # Bytes lost in record 1, noise before record 3, a changed byte in 4, the end cut off.
        broken = (
            parts[0] + parts[1][:-30] + parts[2] + b"noise" + parts[3]
            + parts[4][:-20] + bytes([parts[4][-20] ^ 255]) + parts[4][-19:] + parts[5][:-9]
        )
        seen = list(warc.salvage(broken))
        assert [x[3]["page_id"] for x in seen if x[0] == "record"] == [0, 2, 3]
        spans = [(a, b) for _, a, b, _ in seen]
        assert spans[0][0] == 0 and spans[-1][1] == len(broken) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert starts[-1] == len(whole)


def test_salvage_inside_a_member():
    rng = random.Random(5)
    records = [
        warc.record_bytes(k, "u", b"%d " % k + rng.randbytes(300), "", None).replace(b"WARC-Payload-Digest: sha1:\r\n", b"") for k in range(6)
    ]
    bad = records[2][:-50] + bytes([records[2][-50] ^ 255]) + records[2][-49:]
    parts = [*records[:2], bad, *records[3:]]
    whole = warc.member(b"".join(parts))
    seen = list(warc.salvage(whole))
    assert [x[3]["page_id"] for x in seen if x[0] == "record"] == [0, 1, 3, 4, 5]
    first = len(parts[0]) + len(parts[1])
    assert [x[1:] for x in seen if x[0] == "gap"] == [(0, len(whole), {"inner_start": first, "inner_end": first + len(bad)})]
    other = warc.member(records[5])
    cut = warc.member(b"".join(records[:5]))[:-200]
    for tail, more in ((b"", []), (other, [5])):
        got = [x[3]["page_id"] for x in warc.salvage(cut + tail) if x[0] == "record"]
        assert got == [0, 1, 2, 3, *more]


class Searched(bytes):
    """Bytes that count how far ``find`` looked."""

    looked = 0

    def find(self, needle, start=0, *end):
        hit = super().find(needle, start, *end)
        Searched.looked += (hit if hit >= 0 else len(self)) - start
        return hit


def _archive(count, damage):
    parts = []
    for k in range(count):
        payload = random.Random(k).randbytes(300).hex().encode()
        one = bytearray(warc.member(warc.record_bytes(k, f"http://x/{k}", payload, sha1_base32(payload), None)))
        if damage and k % 10 == 3:
            one[len(one) // 2] ^= 0xFF
        parts.append(bytes(one))
    return Searched(b"".join(parts))


def sha1_base32(payload):
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_salvage_looks_at_every_byte_a_few_times_only():
    for damage in (False, True):
        for count in (200, 400):
            raw = _archive(count, damage)
            Searched.looked = 0
            seen = list(warc.salvage(raw))
            good = [k for k in range(count) if not damage or k % 10 != 3]
            assert [x[3]["page_id"] for x in seen if x[0] == "record"] == good
            assert Searched.looked == 0 if not damage else Searched.looked <= 3 * len(raw)
            # Records and gaps cover the archive without overlap.
            spans = [x[1:3] for x in seen]
            assert spans[0][0] == 0 and spans[-1][1] == len(raw)
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_what_comes_before_damage_is_whole():
    rng = random.Random(8)
    data = bytes(rng.choice(b"abcdefgh") for _ in range(200_000))
    whole = warc.member(data)
    for at in (20, 1000, 5000, len(whole) // 2, len(whole) - 5):
        broken = bytearray(whole)
        broken[at:at + 4] = b"\x00\xff\x00\xff"
        got, end, fine = warc._inflate(memoryview(bytes(broken)), 0)
        step, slow = 1, b""
        unpacker = warc.zlib.decompressobj(31)
        try:
            for k in range(len(broken)):
                slow += unpacker.decompress(broken[k:k + step])
        except warc.zlib.error:
            pass
        assert not fine and got == slow and end <= len(broken)


def test_archive_of_odd_pages(spark, tmp_path):
    """A null id among equal payloads, a very large payload, clashing column names."""
    from pyspark.sql import functions as F

    large = "é" * 3_000_000
    rows = [(None, "u", "same"), (4, "u", "same"), (9, None, "same"), (None, None, "alone"), (7, "x", large), (8, "y", large)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("payload", "leader", "salt", "refers_to", "kind", "path"):
        pages = pages.withColumn(name, F.lit("z"))
    got = {(r.page_id, r.payload_bytes): r for r in warc.round_trip(pages, str(tmp_path / "odd")).collect()}
    assert len(got) == 6
    assert got[9, 4].record_type == "response" and got[4, 4].refers_to == 9 and got[None, 4].refers_to == 9
    assert got[None, 5].record_type == "response" and got[7, 6_000_000].refers_to == 8
    assert got[8, 6_000_000].payload_digest == sha1_base32(large.encode())
