"""Raking under limits, and topics."""

import random
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import op02_mixing as op02


def _margins(x):
    return [x.sum(axis=tuple(a for a in range(x.ndim) if a != k)) for k in range(x.ndim)]


@pytest.mark.parametrize("seed", range(6))
def test_raking_under_limits_is_the_projection(seed):
    """Margins hold, limits hold, and all cells below their limit are their amount times a factor for each category: this
    is what makes the answer the nearest (in relative entropy) that there is."""
    rng = np.random.default_rng(seed)
    amounts = rng.integers(0, 100, (4, 3, 3)).astype(float)
    inner = amounts * rng.uniform(0.2, 0.8, amounts.shape)
    targets = [m / inner.sum() for m in _margins(inner)]
    got = op02.rake(amounts, targets, inner.sum() / amounts.sum())
    most = amounts / inner.sum()
    assert (got <= most + 1e-9).all()
    for a, b in zip(_margins(got), targets, strict=True):
        assert np.allclose(a, b, atol=1e-7)
    free = (amounts > 0) & (got < most - 1e-7)
    at = np.argwhere(free)
    design = np.zeros((len(at), sum(amounts.shape)))
    for row, cell in enumerate(at):
        for k, i in enumerate(cell):
            design[row, sum(amounts.shape[:k]) + i] = 1
    ratio = np.log(got[free] / amounts[free])
    fitted = design @ np.linalg.lstsq(design, ratio, rcond=None)[0]
    assert np.abs(fitted - ratio).max() < 1e-4


def test_what_a_category_lacks_goes_to_the_others():
    amounts = np.array([[10.0, 10.0], [450.0, 530.0]])
    got = op02.rake(amounts, [np.array([0.5, 0.5]), np.array([0.3, 0.7])], 0.5)
    assert np.allclose(got.sum(1), [0.04, 0.96]) and np.allclose(got.sum(0), [0.3, 0.7])


def test_margins_of_the_sample_hold(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"word{rng.randrange(500)}" for _ in range(40)), rng.choice(["en"] * 6 + ["de", "fr", "es"]), f"src{min(rng.randrange(30), 19)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for r in op02.reached(docs, op02.TARGETS, 0.3).collect():
        assert abs(r.reached - r.target) < 0.01 * r.target, r
    kept = op02.weigh(docs, op02.TARGETS, 0.3).where("kept").groupBy("lang").sum("n_words").collect()
    total = sum(r[1] for r in kept)
    assert all(abs(r[1] / total - op02.TARGETS["lang"][r[0]]) < 0.06 for r in kept)


def test_topics_are_the_planted_ones(spark):
    rng = random.Random(5)
    pools = {(lang, k): [f"{lang}{k}{''.join(rng.choice('abcdefgh') for _ in range(5))}" for _ in range(60)] for lang in ("en", "de") for k in range(3)}
    common = [f"common{k}" for k in range(30)]
    rows = []
    for i in range(1200):
        lang, k = ("en", "de")[i % 2], i // 2 % 3
        rows.append((i, " ".join(rng.choice(pools[lang, k] + common) for _ in range(60)), lang, f"t{k}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = op02.weigh(docs, {"source": {}, "lang": {"en": 1.0, "de": 1.0}, "topic": 1.0}, 0.5, topics=6).select("lang", "source", "topic").collect()
    pure = Counter((r.lang, r.topic, r.source) for r in found)
    largest = sum(max(n for (a, b, _), n in pure.items() if (a, b) == key) for key in {(a, b) for a, b, _ in pure})
    assert largest >= 0.95 * len(found), pure


def test_margins_that_contradict_each_other_still_fill_the_budget():
    rng = np.random.default_rng(4)
    amounts = rng.integers(1, 5, (6, 4, 3)).astype(float)
    amounts[0] = 0
    amounts[0, 0, 0] = 400  # one category's words are all in one cell
    targets = [np.array([0.02, *[0.196] * 5]), np.array([0.9, 0.04, 0.03, 0.03]), np.full(3, 1 / 3)]
    got = op02.rake(amounts, targets, 0.5)
    assert abs(got.sum() - 1) < 1e-9 and (got <= amounts / amounts.sum() / 0.5 + 1e-9).all()
