"""Personal data: base spans against plain patterns, votes against plain counting, and planted cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from assaytrail.llm import personal, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda m: [int(c) for c in m.group() if c in "0123456789"]

    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return out


def valid_card(rng, prefix="4"):
    body = prefix + "".join(rng.choice("0123456789") for _ in range(15 - len(prefix)))
    return next(body + c for c in "0123456789" if personal.luhn(body + c))


@pytest.mark.parametrize("alphabet", ["0123456789", "01. ", "a.@-1", "+1 ().-23", "aé@.4 -+()\n", "12.[]@x "])
def test_base_spans_equal_plain_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert sorted(personal.base_spans(text)) == sorted(plain_base(text)), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a@" * 150_000, "a." * 100_000 + "@", "+1" + "(" * 300_000, "1 " * 150_000, "[at]" * 80_000, "1-" * 100_000):
        assert isinstance(personal.candidates(text), list)
    assert personal.candidates("0" * 5000 + "1.2.3.4")[0][:4] == (personal.IP, 0, 5007, True)


def test_reliabilities_equal_plain_counting():
    rng = np.random.default_rng(2)
    votes = personal.vote_table()
    truth = rng.random(3000) < 0.4
    right = [0.95, 0.9, 0.8, 0.7, 0.85, 0.6]
    rows = [[(2 if t else 0) if rng.random() < r else (1 if rng.random() < 0.5 else (0 if t else 2)) for r in right] for t in truth]
    codes = [sum(v * 3 ** (5 - k) for k, v in enumerate(row)) for row in rows]
    counts = np.bincount(codes, minlength=len(votes)).astype(float)
    share, theta, posterior = personal.reliabilities(counts, rounds=30)
    p = [1 / (1 + math.exp(-sum(v - 1 for v in row))) for row in rows]        # the same over single rows, in plain loops
    for _ in range(30):
        s = (sum(p) + 1) / (len(p) + 2)
        table = [[[personal.PRIOR[y][v] + sum((q if y else 1 - q) for q, row in zip(p, rows) if row[k] == v) for v in range(3)] for y in (0, 1)] for k in range(6)]
        table = [[[x / sum(c) for x in c] for c in k] for k in table]
        p = [1 / (1 + math.exp(-(math.log(s / (1 - s)) + sum(math.log(table[k][1][v] / table[k][0][v]) for k, v in enumerate(row))))) for row in rows]
    assert np.allclose([posterior[c] for c in codes], p, atol=1e-8) and np.allclose(theta, table, atol=1e-8)
    assert np.mean((np.array(p) > 0.5) == truth) > 0.95 and abs(share - truth.mean()) < 0.05


def test_classifier_equals_plain_descent():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 1 << len(personal.FEATURES), 40)
    n, positive = rng.integers(1, 50, 40).astype(float), np.zeros(40)
    positive[:] = n * rng.random(40)
    w = personal.fit_classifier(bits, n, positive)
    x = np.array([[1, *((b >> k) & 1 for k in range(len(personal.FEATURES)))] for b in bits], float)
    plain, pull = np.zeros(x.shape[1]), np.r_[0.01, np.ones(len(personal.FEATURES))]
    for _ in range(20000):
        p = 1 / (1 + np.exp(-x @ plain))
        plain -= 0.002 * (x.T @ (n * p - positive) + pull * plain)
    assert np.allclose(w, plain, atol=1e-4)


def documents(seed=6):
    """Texts with clean spans for the estimates, spans that the base patterns miss, and numbers that are no personal data."""
    rng = random.Random(seed)
    rows, missed, clean = [], {}, set()
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}"
    ip = lambda: ".".join(str(rng.randint(1, 223)) for _ in range(4))
    for i in range(400):
        parts = [f"write to ann.{i}@mail{i % 9}.example.com today", f"call {phone()} now", f"from {ip()} at", f"card {valid_card(rng)} paid"]
        rows.append((i, " some words ".join(rng.sample(parts, rng.randint(1, 4)))))
    for i in range(400, 460):
        a, b, c = phone(), valid_card(rng, str(rng.randint(1, 9))), ip()
        text = rng.choice([f"call {a} {b} and so on", f"words {b} {c} more", f"x {a} {c} y"])
        rows.append((i, text))
        missed[i] = [(k, text.index(x), text.index(x) + len(x)) for k, x in (("phone", a), ("card", b), ("ip", c)) if x in text]
    for i in range(460, 520):
        rows.append((i, rng.choice(["the token 5d190bd7c06284de91015a36974748794293dd8a stays", f"order {rng.randint(10**9, 10**10)} of 12 parts",
                                    "version 3 of 2024-01-05 and 10:30:45", "pages 12-14, 100 000 people", "meet me at noon. Then go."])))
        clean.add(i)
    return rows, missed, clean


def test_missed_spans_are_added_and_clean_texts_left_alone(spark):
    rows, missed, clean = documents()
    found = {r.doc_id: [tuple(x) for x in r._found] for r in personal.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, spans in found.items():
        assert sorted((personal.KINDS.index(k), s, e) for k, s, e, base in spans if base) == sorted(plain_base(texts[i]))
        assert [(s, personal.KINDS.index(k)) for k, s, _, _ in spans] == sorted((s, personal.KINDS.index(k)) for k, s, _, _ in spans)
    caught = [span in [x[:3] for x in found[i]] for i, spans in missed.items() for span in spans]
    assert np.mean(caught) > 0.97
    assert sum(any(not x[3] for x in found[i]) for i in clean) == 0


def test_edge_cases(spark, odd, empty):
    out = personal.find_personal_data(odd).collect()
    assert len(out) == odd.count() and all(r._found == [] for r in out)
    assert personal.find_personal_data(empty).count() == 0
    rows = [(None, "mail é.23@mail1.example.com"), (1, "mail é.23@mail1.example.com"), (1, "mail é.23@mail1.example.com"), (2, "a [at] b [dot] com"), (3, None)]
    found = personal.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, [tuple(x)[:3] for x in r._found if x.base]) for r in found)
    assert got == [(0, [("email", 6, 27)]), (1, [("email", 6, 27)]), (1, [("email", 6, 27)]), (2, []), (3, [])]


def test_query_columns(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_weak_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = sorted((s, k, e) for k, s, e in plain_base(texts[r.doc_id]))
        named = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(filter(None, named.split(","))) <= set(filter(None, r.spans.split(",")))
