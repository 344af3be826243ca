"""Operators that read one text at a time, against plain Python on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from toponet.llm import decontaminate, language_id, personal_data, quality_fm, quality_rules, toxicity, words

ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "é"), (5, "one"), (5, "one"), (6, "a b a b a b a b"),
    (7, "x" * 300_000), (8, "line one\nline one\n\n \nline one"), (9, "    ñ,ñ\x00ñ"), (None, "no id here"),
    (10, "#*$%&|<> " * 60), (11, ("the same words again " * 40).strip()),
]


def plain_counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(found, found[1:], found[2:]))
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def test_hashes_agree_with_words_and_blocks():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    seen = {}
    for lo, hi, data, at in words.blocks(pa.array(texts)):
        starts, ends = words.bounds(data, at, words.WHITE)
        cut = words.per_document(starts, at)
        h = words.hashes(data, starts, ends)
        for d in range(lo, hi):
            got = [data[a:b].tobytes() for a, b in zip(starts[cut[d] : cut[d + 1]], ends[cut[d] : cut[d + 1]])]
            assert got == texts[d].encode().split()
            for w, x in zip(got, h[cut[d] : cut[d + 1]]):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_quality_rules(make, prose):
    rows = ODD + [(100 + k, prose(k, 90)) for k in range(30)]
    rows += [(200 + k, "".join(f"w{k}q{j}### " for j in range(80))) for k in range(4)]
    got = quality_rules.score_quality(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        want = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        said = (text or "").translate(str.maketrans("\t\n\r\f\v", "     ")).split(" ")
        assert r.n_marked == sum(any(x in "#*$%&|<>" for x in w) for w in said)
        assert r.n_distinct == len({w for w in said if w})
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[100 + k] for k in range(30)) and not any(kept[200 + k] for k in range(4))
    assert quality_rules.score_quality(make([(1, "a")]).limit(0)).count() == 0


def generated_votes(alarm, catch, good, n=20_000):
    """(good?, pattern) of documents whose rules vote independently with known rates; a tenth abstains."""
    rng = np.random.default_rng(11)
    fine, pattern = rng.random(n) < good, np.zeros(n, int)
    for k, (a, b) in enumerate(zip(alarm, catch)):
        vote = np.where(rng.random(n) < np.where(fine, a, b), 0, 2)
        pattern += np.where(rng.random(n) < 0.1, 1, vote) * 3**k
    return fine, pattern


@pytest.mark.parametrize("alarm, catch, good", [
    ([0.02, 0.05, 0.03, 0.01, 0.3, 0.04, 0.02], [0.6, 0.7, 0.5, 0.8, 0.45, 0.6, 0.7], 0.75),
    ([0.01] * 6 + [0.25], [0.3, 0.4, 0.5, 0.3, 0.4, 0.5, 0.3], 0.85),
])
def test_label_model_recovers_known_rates_and_outvotes_a_noisy_rule(alarm, catch, good):
    fine, pattern = generated_votes(alarm, catch, good)
    kinds, at, counts = np.unique(pattern, return_inverse=True, return_counts=True)
    prior, weights = quality_rules.fit_label_model(kinds, counts.astype(float), 7)
    assert abs(1 / (1 + np.exp(-prior)) - good) < 0.02
    # Odds of a condemning and of a passing vote give both rates back.
    down, up = np.exp(weights[:, 0]), np.exp(weights[:, 2])
    caught = (up - 1) / (up - down)
    assert np.abs(caught - catch).max() < 0.05 and np.abs(down * caught - alarm).max() < 0.05
    votes = np.array([[p // 3**k % 3 for k in range(7)] for p in kinds])
    odds = prior + sum(weights[k][votes[:, k]] for k in range(7))
    noisy = int(np.argmax(alarm))
    alone = (votes == 2).sum(1) + (votes[:, noisy] == 0) == 7
    assert alone.any() and (odds[alone] > 0).all()
    by_all = ~(votes == 0).any(1)
    assert ((odds > 0)[at] == fine).mean() > 0.95 > 0.8 > (by_all[at] == fine).mean()


def test_label_model_without_documents():
    prior, weights = quality_rules.fit_label_model(np.zeros(0, int), np.zeros(0), 3)
    assert np.isfinite(prior) and np.isfinite(weights).all()


def plain_hits(text, items, window=10):
    def norm(x):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))

    said, hit, names = norm(text), set(), set()
    for item, body in items:
        body = norm(body)
        size = min(len(body), window)
        if item is None or not size:
            continue
        for k in range(len(body) - size + 1):
            for p in range(len(said) - size + 1):
                if said[p : p + size] == body[k : k + size]:
                    hit.update(range(p, p + size))
                    names.add(str(item))
    return len(said), len(hit), sorted(names)


@pytest.mark.parametrize("block", [100_000, 25])
def test_decontamination_equals_brute_force(spark, make, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(5)
    word = lambda: rng.choice("Aa b cé dd E".split())
    items = [(k, " ".join(word() for _ in range(rng.randrange(0, 30)))) for k in range(12)]
    items += [(None, "a b"), (50, None), (51, "a, B!"), (52, "a, B!"), (3, "dd dd dd")]
    rows = [(1000 + k, ". ".join(word() for _ in range(rng.randrange(0, 120)))) for k in range(40)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(make(rows), bench).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, names = plain_hits(next(t for i, t in rows if i == r.doc_id), items)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(names), digest)
        assert r.contaminated == (hit > 0)
    assert all(r.n_hit == 0 for r in decontaminate.report(make(rows), bench.limit(0)).collect())


def test_spans_are_removed_and_columns_stay(spark, make, prose):
    item = " ".join(f"secret{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, prose(1, 60) + " " + item.upper() + "! " + prose(2, 40)), (2, item), (3, prose(3, 50)), (4, None)]
    docs = make(rows)
    got = {r.doc_id: r for r in decontaminate.remove_spans(docs, bench).collect()}
    assert set(got) == {1, 3, 4} and got[3].text == rows[2][1] and got[4].text is None or got[4].text == ""
    assert "SECRET" not in got[1].text and got[1].text.startswith(rows[0][1][:50]) and got[1].key == "key"


def test_language(make):
    stock = {"aa": "the and of to in".split(), "bb": "der und die das ist".split()}
    rng = random.Random(1)
    rows = []
    for k in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((k, " ".join(rng.choice(stock[lang]) for _ in range(rng.randrange(1, 30))), lang))
    rows += [(200, None, "aa"), (201, "123 !?", "bb"), (202, "", None), (203, "der und", None)]
    got = {r.doc_id: r for r in language_id.identify(make(rows)).collect()}
    import zlib

    for i, text, lang in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
        if not re.search("[a-z]", text or ""):
            assert r.lang_pred == "und"
        elif lang:
            assert r.lang_pred == lang
    assert got[203].lang_pred == "bb"
    none = language_id.identify(make([(1, "text")]).limit(0))
    assert none.count() == 0
    assert language_id.identify(make([(1, "text", None)])).first().lang_pred == "und"


def plain_spans(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end()) for m in email.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) < 256 for x in m[0].split("."))]
    out += [
        (m.start(), 2, m.end()) for m in card.finditer(text)
        if 14 <= len(digits(m[0])) <= 19 and personal_data.luhn(digits(m[0]))
    ]
    out += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data_base_equals_the_patterns(make):
    rng = random.Random(9)
    alphabet = ["a@b.co", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (499) 555-6503", " ", "-", "+", "7", "é", "x.y-z%"]
    rows = [(1000 + k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25)))) for k in range(400)] + ODD
    got = personal_data.report(make(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        want = plain_spans(text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert [x for x in r.spans.split(",") if not x.startswith("term")] == want.split(",")
        assert r.n_email == want.count("email")


def said_terms(got, docs):
    return {i: [docs[i][int(x[1]) : int(x[2])] for x in (y.split(":") for y in r.spans.split(",")) if x[0] == "term"] for i, r in got.items()}


def test_terms_of_values_that_occur_once_are_found(make, prose):
    rows = [(k, f"{prose(k, 20)} ask Zorblax today {prose(90 + k, 9)} at boss{k}@corp.org {prose(50 + k, 20)}") for k in range(6)]
    rows += [(20 + k, f"{prose(k, 20)} call “grumble” {prose(80 + k, 9)} on +1 499 555 {6000 + k} {prose(60 + k, 20)}") for k in range(6)]
    rows += [(40, "ask nobody@else.example of hapax"), (41, "call +7 999 111 22 33 of hapax")]
    rows += [(100 + k, prose(200 + k, 60) + " today ask call") for k in range(60)]
    docs = dict(rows)
    got = said_terms({r.doc_id: r for r in personal_data.report(make(rows)).collect()}, docs)
    for k in range(6):
        assert got[k] == ["Zorblax"] and got[20 + k] == ["grumble"]
    assert not any(got[k] for k in (40, 41, *range(100, 160)))


def test_disclosing_terms(make, prose):
    rows = [(k, f"{prose(k, 20)} ask zorblax today {prose(90 + k, 9)} at boss@corp.org {prose(50 + k, 20)}") for k in range(6)]
    rows += [(100 + k, prose(200 + k, 60) + " today") for k in range(60)]
    got = {r.doc_id: r for r in personal_data.report(make(rows)).collect()}
    docs = dict((i, t) for i, t in rows)
    for k in range(6):
        terms = [x.split(":") for x in got[k].spans.split(",") if x.startswith("term")]
        said = {docs[k][int(a) : int(b)] for _, a, b in terms}
        assert said <= {"zorblax", "ask"}
    clean = {r.doc_id: r.text for r in personal_data.sanitise(make(rows)).collect()}
    assert "boss@" not in clean[0] and "<EMAIL>" in clean[0] and clean[100] == docs[100]


def test_terms_go_wherever_they_stand(make, prose):
    rows = [(k, f"zorblax é {prose(k, 60)} boss@corp.org {prose(50 + k, 60)} zorblax") for k in range(20)]
    rows += [(30, f"{prose(31, 30)} — of zorblax and others"), (31, "zorblaxes")]
    rows += [(100 + k, prose(200 + k, 60)) for k in range(300)]
    docs = dict(rows)
    got = said_terms({r.doc_id: r for r in personal_data.report(make(rows)).collect()}, docs)
    for k in range(20):
        assert got[k] == ["zorblax", "zorblax"]
    assert got[30] == ["zorblax"] and got[31] == []
    clean = {r.doc_id: r.text for r in personal_data.sanitise(make(rows)).collect()}
    assert not any("zorblax" in clean[k] for k in (*range(20), 30)) and clean[31] == docs[31] and clean[100] == docs[100]


def learnable(prose):
    rows, quality, toxic = [], [], []
    for k in range(400):
        text = prose(k, 60)
        poor, bad = k % 4 == 0, k % 5 == 1
        if poor:
            text = " ".join(f"{w}###" for w in text.split())
        if bad:
            text += " you grumblefoo snarkle"
        rows.append((k, text))
        if k % 3:
            quality.append((k, int(not poor), int(bad)))
    return rows, quality


def test_quality_classifier(spark, make, prose):
    rows, labels = learnable(prose)
    labelled = spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_fm.classify(make(rows + [(900, None), (901, "")]), labelled).collect()}
    assert sum(got[k].predicted == int(k % 4 != 0) for k in range(400)) >= 396
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    kept = quality_fm.keep_good(make(rows), labelled)
    assert kept.columns == make(rows).columns and 290 <= kept.count() <= 310
    assert quality_fm.classify(make(rows).limit(0), labelled.limit(0)).count() == 0


def test_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = {"bias": 0.3, "weight": rng.normal(size=quality_fm.COLUMNS), "factors": rng.normal(size=(4, quality_fm.COLUMNS))}
    col, value = np.array([3, 8, 11, 500]), np.array([0.5, 1, 0.2, 2])
    got = quality_fm.raw_scores(model, np.zeros(4, int), col, value, 1)[0]
    want = 0.3 + (model["weight"][col] * value).sum() + sum(
        model["factors"][:, col[i]] @ model["factors"][:, col[j]] * value[i] * value[j] for i in range(4) for j in range(i)
    )
    assert abs(got - want) < 1e-9


def test_toxicity(spark, make, prose):
    rows, labels = learnable(prose)
    labelled = spark.createDataFrame(labels + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(make(rows + [(900, None), (901, "")]), labelled).collect()}
    assert sum(got[k].predicted == int(k % 5 == 1) for k in range(400)) >= 396
    assert got[900].score == got[901].score and got[900].predicted == 0
    assert toxicity.classify(make(rows).limit(0), labelled.limit(0)).count() == 0
