"""The skip-chain field: exact marginals, similar mentions, recall of planted copies in other writings."""

import itertools
import random

import numpy as np
import pytest

from tallyforge.llm import op07_pii as op07

FACTORS = op07.tables(op07._counts(op07._examples()))


def brute_beliefs(t, factors):
    """Marginals by summing over all labellings."""
    n, total = len(t.span), np.zeros((len(t.span), op07.LABELS))
    for y in itertools.product(range(op07.LABELS), repeat=n):
        if any(t.label[i] and t.label[i] != y[i] for i in range(n)):
            continue
        p = sum(factors[0][t.shape[i], y[i]] for i in range(n) if not t.label[i])
        p += sum(f[y[i], y[j]] for f, edges in zip(factors[1:], (t.chain, t.same, t.near), strict=True) for i, j in edges)
        for i in range(n):
            total[i, y[i]] += np.exp(p)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize(("text", "close"), [
    ("pay 4111 1111 1111 1111, " + "x" * 80 + " 4111.1111.1111.1111 and 555-123-4567", 1e-5),
    ("on 2024-01-05 12, id 12345678" + " y" * 50 + " 55-55-55-55-55", 1e-5),
    ("call +1 555 123 4567 or 555-123-4567 " + "z" * 90 + " 555.123.4567 " + "z" * 90 + " 555-123-4567", 0.05),
])
def test_beliefs_equal_the_marginals(text, close):
    t = op07.Mentions(text, op07.base_spans(text))
    rng = np.random.default_rng(1)
    for factors in (FACTORS, tuple(f + 0.5 * (r := rng.normal(size=f.shape)) + (0.5 * r.T if f.shape[0] == f.shape[1] else 0) for f in FACTORS)):
        assert np.abs(op07.beliefs(t, factors, rounds=500, close=1e-12) - brute_beliefs(t, factors)).max() < close or close > 0.01 and (op07.beliefs(t, factors).argmax(1) == brute_beliefs(t, factors).argmax(1)).all()


@pytest.mark.parametrize(("text", "added"), [
    ("4111 1111 1111 1111 or 4111.1111.1111.1111", [("4111.1111.1111.1111", "card")]),
    ("+1 555 123 4567 or 555-123-4567", [("555-123-4567", "phone")]),
    ("bob@example.com or bob(at)example.com", [("bob(at)example.com", "email")]),
    ("10.20.30.40 or 10[.]20[.]30[.]40", [("10[.]20[.]30[.]40", "ip")]),
    ("4111 1111 1111 1111 or 4111.1111.1111.1112, 5111.1111.1111.1119", [("4111.1111.1111.1112", "card")]),
    ("4111.1111.1111.1111 and 4111.1111.1111.1111 and 4111/1111/1111/1111", []),
    ("555-123-4567 " * 40, []),
    ("look at example dot com", []),
])
def test_similar_mentions_take_labels(text, added):
    assert [(text[a:b], k) for a, b, k in op07.added_spans(text, op07.base_spans(text), FACTORS)] == added


def test_recall_of_planted_copies(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aehinorst") for _ in range(rng.randrange(2, 9)))
    gap = lambda: word() + " " + " ".join(word() if rng.random() < 0.93 else str(rng.randrange(10 ** rng.randrange(1, 12))) for _ in range(rng.randrange(5, 60))) + " " + word()
    rows, planted = [], {}
    for i, text in enumerate(op07._examples(300, seed=99)):
        spans = op07.base_spans(text)
        parts, at = [gap()], len(spans)
        for a, b, kind in spans[: at if i % 2 else 0]:
            core = text[a:b]
            digits = "".join(c for c in core if c.isdigit())
            copy = {"email": core.replace("@", " (at) "), "ip": core.replace(".", "[.]"), "card": "_".join(digits[x : x + 4] for x in range(0, 16, 4)), "phone": f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"}[kind]
            parts += [core, gap(), f"{copy},", gap()]
            planted.setdefault(i, []).append((copy, kind))
        if not i % 2:
            parts += [x for n in (7, 10, 16) for x in ("-".join("".join(rng.choice("123456789") for _ in range(4)) for _ in range(n // 4 + 1)), gap())]
        rows.append((i, " ".join(parts)))
    found = {r.doc_id: r for r in op07.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts, hit, extra = dict(rows), 0, 0
    for i, r in found.items():
        base = {(a, b) for a, b, _ in op07.base_spans(texts[i])}
        new = [(texts[i][int(a) : int(b)], k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if (int(a), int(b)) not in base]
        hit += sum(p in new for p in planted.get(i, []))
        extra += sum(n not in planted.get(i, []) for n in new)
    total = sum(map(len, planted.values()))
    assert total == 600 and hit >= 0.97 * total and extra <= 0.01 * total, (hit, extra, total)
