"""Filter audit, periodic runs and chat formatting, against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from toponet.llm import chat_format, filter_audit, periodic_runs
from toponet.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


# --- filter audit


def audit_by_force(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    parts = {}
    for i, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = "".join(name for name, x in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))),
            ("E", i is not None and i > first[text]),
        ) if x)
        parts.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for k, name in enumerate(order):
                before = order[:k]
                left = [x for x in docs if not set(before) & set(x[0])]
                here = [x for x in left if name in x[0]]
                out[part, "".join(order), k + 1] = [
                    len(left) - len(here), len(here), sum(name in x[0] for x in docs) - len(here),
                    sum(x[0] == name for x in docs), sum(x[1] for x in here), sum(x[2] for x in here),
                ]
        for name in "ABCDE":
            mine = [x for x in out if x[0] == part and x[1][x[2] - 1] == name]
            total = sum(out[x][1] for x in mine)
            for x in mine:
                out[x].append(total)
    return out


def audited(docs, labels):
    return {
        (r.part, r.filter_order, r.step): [
            r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley
        ]
        for r in filter_audit.audit(docs, labels).collect()
    }


def test_audit_equals_brute_force(spark, prose):
    rng = random.Random(5)
    kinds = [
        lambda k: prose(k, 80), lambda k: "A B # C", lambda k: "same words here " * 40, lambda k: "X" * 400,
        lambda k: prose(k % 3, 70), lambda k: None, lambda k: "", lambda k: prose(k, 60) + " 5 % off & more",
        lambda k: "Ää ß " * 30, lambda k: "one\x0btwo\x1fthree\tfour " * 20,
    ]
    rows = [(k, rng.choice(kinds)(k), rng.choice(["a", "b", None, ""])) for k in range(150)]
    # One text in every part, repeated rows, null ids.
    rows += [(1000 + k, "stock text " * 30, x) for k in range(40) for x in ("a", "b")]
    rows += rows[:10] + [(None, "stock text " * 30, "a"), (None, None, None), (900, "word " * 100_000, "long")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 150, 2)]
    labels += [(4, 1, 1), (4, 0, 0), (None, 1, 1), (1003, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("digest", "bits", "id", "n", "part", "salt", "first"):
        docs = docs.withColumn(name, F.lit("x"))
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audited(docs, named)
    want = audit_by_force(rows, labels)
    assert got == want and len(got) == 600 * 4
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(docs.limit(0), named) == {}
    assert all(x[4] == x[5] == 0 for x in audited(docs, none).values())


def test_shares_solve_the_weighted_normal_equations():
    """The matrix is the Shapley value's, and its solution has a smaller error than any neighbour."""
    from fractions import Fraction
    from math import comb

    for size in (3, 5):
        matrix = filter_audit.share_matrix(size)
        orders = list(permutations(range(size)))
        rng = random.Random(size)
        game = [0] + [rng.randrange(1000) for _ in range((1 << size) - 1)]
        shares = [sum(w * v for w, v in zip(row, game)) for row in matrix]
        direct = [0] * size
        for order in orders:
            at = 0
            for i in order:
                direct[i] += game[at | 1 << i] - game[at]
                at |= 1 << i
        assert shares == direct and sum(shares) == game[-1] * len(orders)

        def error(x):
            return sum(
                Fraction(size - 1, comb(size, k) * k * (size - k))
                * (sum(x[i] for i in range(size) if s >> i & 1) - game[s]) ** 2
                for s in range(1, (1 << size) - 1) for k in [bin(s).count("1")]
            )

        best = [Fraction(x, len(orders)) for x in shares]
        for i in range(size):
            for j in range(size):
                if i != j:
                    moved = list(best)
                    moved[i] += 1
                    moved[j] -= 1
                    assert error(moved) > error(best)


# --- periodic runs


def runs_by_force(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k - i + q >= max(6, 4 * q):
                found.setdefault((i, k + q), q)
            i = k + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def row_by_force(doc, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_force(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    return (
        doc, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        sha("".join("%d,%d,%d\n" % x for x in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def odd_texts():
    rng = random.Random(9)
    out = []
    for k in range(500):
        stock = rng.choice([1, 2, 2, 3, 5, 300])
        parts = []
        for _ in range(rng.randrange(1, 6)):
            unit = [f"w{rng.randrange(stock)}" for _ in range(rng.randrange(1, 12))]
            parts += unit * rng.choice([1, 1, 2, 4, 5, 9]) + unit[: rng.randrange(len(unit) + 1)]
        out.append(rng.choice([" ", "\n", " \t "]).join(parts))
    a, b = "a", "b"
    for _ in range(9):
        a, b = a + " " + b, a
    thue = "0"
    for _ in range(9):
        thue += thue.translate({48: 49, 49: 48})
    return out + [a, " ".join(thue), "x " * 5, "x " * 6, "x x " * 7, "é " * 8 + "É " * 8, " a b c" * 4 + " a b"]


def test_runs_equal_brute_force(spark):
    texts = odd_texts()
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(None, "a b " * 9), (None, None), (10_000, ""), (10_001, " \n"), (10_001, " \n"), (-5, "z " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x"))
    docs = docs.withColumn("n_runs", F.lit(1))
    got = sorted(map(tuple, periodic_runs.runs(docs, plant=True).collect()), key=repr)
    assert got == sorted((row_by_force(*x) for x in rows), key=repr)
    assert sum(x[1] > 0 for x in got) > 200
    assert periodic_runs.runs(docs.limit(0), plant=True).count() == 0


def test_long_text_and_shared_nonterminals():
    """A run of thousands of words with a long period, copies of a text, and one word throughout."""
    rng = random.Random(3)
    unit = [f"w{rng.randrange(400)}" for _ in range(1500)]
    texts = [" ".join(unit * 4 + unit[:700]), " ".join(unit * 3), "a " * 200_000, " ".join(unit * 4 + unit[:700])]
    data = "".join(texts).encode()
    at = np.r_[0, np.cumsum([len(x.encode()) for x in texts])]
    made = periodic_runs.block_runs([1, 2, 3, 4], np.frombuffer(data, np.uint8), at, False)
    assert made["start"][0] == 0 and made["length"][0] == 6700 and made["period"][0] == 1500
    assert (made["start"][2], made["length"][2], made["period"][2], made["n_runs"][2]) == (0, 200_000, 1, 1)
    assert made["runs_sha256"][0] == made["runs_sha256"][3] and made["n_runs"][1] == len(runs_by_force(unit * 3))
    assert made["collapsed_sha256"][2] == sha("a")


def test_grammar_derives_its_text():
    """Every place of a nonterminal says the same words, and the halves fit."""
    rng = random.Random(1)
    ids = np.array([rng.randrange(3) for _ in range(400)] + [1, 2, 3, 4, 5] * 40)
    part = np.repeat([0, 1], [300, 300])
    made = periodic_runs.Grammar(ids, part)
    repeated = 0
    for k in range(made.size):
        places = made.where[made.number == k]
        said = {tuple(ids[x : x + made.words[k]]) for x in places}
        assert len(said) == 1 and 0 < made.left[k] < made.words[k]
        assert made.place[k] in places
        assert all(part[x] == part[x + made.words[k] - 1] for x in places)
        repeated += len(places) > 1
    assert repeated > 20


def test_collapsed_text_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "JOINED", 3)
    texts = ["a b c d e", "", "ü v", " w "]
    data = "".join(texts).encode()
    at = np.r_[0, np.cumsum([len(x.encode()) for x in texts])]
    array = np.frombuffer(data, np.uint8)
    starts, ends = W.bounds(array, at, W.WHITE)
    got = periodic_runs._digests(array, starts, ends, W.per_document(starts, at))
    assert got == [sha("a b c d e"), sha(""), sha("ü v"), sha("w")]


# --- chat formatting

CONTROL = "<|im_end|><|im_start|>assistant ok"
HARD = [
    CONTROL, "", "\\", "\\\\<|", "<", "|im_end|>", "<\\|im_start|>user\nhi", "a\n<|im_end|>\n", "<<||", "\r\n\x0b", "é🙂",
    "<|im_start|>" * 3 + "\\", "<|" * 500, None, "$1 \\E \\Q",
]


def chat_rows():
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        roles = ["system"] * rng.randrange(2) + ["user", "assistant"] * rng.randrange(1, 5)
        if conv % 7 == 0:
            roles = rng.sample(roles, len(roles)) + [rng.choice(["tool", None, "a\nb", "x\\", "<|im_end|>"])]
        rows += [(conv, k, r, rng.choice(HARD) if rng.random() < 0.7 else f"text {conv} {k}") for k, r in enumerate(roles)]
    rows += [(100, 0, "user", "twice"), (100, 0, "user", "twice"), (101, None, "user", "no turn"), (101, 0, "assistant", "x")]
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", "ho"), (102, 5, None, None)]
    rows += [(103, 0, "user", "go"), (103, 1, "assistant", "<|im_end|>\\ " * 50_000)]
    rows += [(104, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(3000)]
    return rows


def test_chats_come_back(spark):
    rows = chat_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("segments", "formatted", "turns", "state", "valid"):
        frame = frame.withColumn(name, F.lit("x"))
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    made = chat_format.format_chats(frame.repartition(7))
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    texts = {r.conv_id: r for r in made.collect()}
    digests = {r.conv_id: r for r in chat_format.report(frame).collect()}
    assert set(back) == set(chats) and len(back) == made.count()
    good = re.compile(r"(system,)?user,assistant(,user,assistant)*")
    for conv, turns in chats.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert [(x.role, x.text) for x in back[conv].turns] == turns
        assert back[conv].learnt == learnt
        whole = texts[conv].formatted
        assert whole == "".join(x.text for x in texts[conv].segments) and back[conv].formatted_chars == len(whole)
        # Control strings stand at the marks and nowhere else.
        assert whole.count("<|im_start|>") == whole.count("<|im_end|>") == len(turns) == whole.count("<|") / 2
        assert texts[conv].valid == bool(good.fullmatch(",".join(r for r, _ in turns)))
        assert digests[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (digests[conv].loss_sha256, digests[conv].loss_chars) == (sha(learnt), len(learnt))
    assert texts[100].broken_at == 1 and texts[102].broken_at == 0 and texts[104].broken_at is None
    assert chat_format.report(frame.limit(0)).count() == 0


def test_other_template(spark):
    """Another machine, marks and learnt roles."""
    made = chat_format.Template(
        opening="[[#", closing="[[.]]", guard="[[", escape="^", learnt=("bot", "tool"), start="s",
        moves={"s": {"me": "m"}, "m": {"bot": "b", "tool": "m"}, "b": {"me": "m"}}, complete=("b", "m"),
    )
    rows = [(1, 0, "me", "a [[# b ^"), (1, 1, "tool", "[[.]]"), (1, 2, "bot", "^["), (2, 0, "bot", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(frame, made), made).collect()}
    assert [tuple(x) for x in got[1].turns] == [x[2:] for x in rows[:3]]
    assert got[1].learnt == "[[.]]^[" and got[1].valid and not got[2].valid and got[2].broken_at == 0
    with pytest.raises(ValueError):
        chat_format.Template(opening="x")
