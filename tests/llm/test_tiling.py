"""Tiling of random and of repetitive sequences."""

import random
import time

import numpy as np
import pytest

from tallyforge.llm import op10_decontaminate as op10
from test_operators import brute_coverage


@pytest.mark.parametrize("pairs", [1 << 20, 3])
def test_tiling_is_greedy(monkeypatch, pairs):
    monkeypatch.setattr(op10, "_PAIRS", pairs)
    rng = random.Random(pairs)
    for _ in range(300):
        item, text = ([rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        tiles = op10.tile(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert all(item[p : p + k] == text[t : t + k] and k >= 3 for p, t, k in tiles)
        assert sum(k for *_, k in tiles) == brute_coverage(item, text, 3)


def test_repetitive_texts_take_no_square():
    start = time.process_time()
    assert sum(k for *_, k in op10.tile(np.ones(300, np.uint64), np.ones(300_000, np.uint64), 5)) == 300
    assert time.process_time() - start < 30
