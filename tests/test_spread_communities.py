"""Communities over tables: planted groups, the single task's answer, quality on random graphs."""

import random

import numpy as np
import pytest

from tallyforge.operators import graph
from tallyforge.storage import Scratch


def _planted(groups, size, seed, inner=0.9, bridge=1.0):
    rng, edges = random.Random(seed), set()
    for g in range(groups):
        own = range(g * size, (g + 1) * size)
        edges |= {(i, j) for i in own for j in own if i < j and rng.random() < inner}
        edges |= {(i, i + 1) for i in own if i + 1 in own}
        edges.add(tuple(sorted((rng.choice(own), ((g + 1) * size + rng.randrange(size)) % (groups * size)))))
    return [(a, b, 1.0 if a // size == b // size else bridge) for a, b in sorted(edges)]


@pytest.mark.parametrize("method", ["leiden", "louvain", "label_propagation"])
def test_one_large_component_gives_the_single_tasks_answer(spark, method):
    edges = spark.createDataFrame(_planted(12, 8, 3, bridge=0.1 if method == "label_propagation" else 1.0), "a long, b long, weight double")
    one, many = ({(r.node, r.component) for r in graph.communities(Scratch(spark, "t"), edges, f"c{most}", 1.0, method, most_nodes=most).collect()} for most in (10**6, 10))
    assert one == many == {(i, i // 8 * 8) for i in range(96)}


def test_quality_on_a_random_graph(spark):
    rng = random.Random(9)
    pairs = {tuple(sorted(rng.sample(range(150), 2))) for _ in range(450)} | {(i, i + 1) for i in range(149)}
    edges = spark.createDataFrame([(a, b, rng.random()) for a, b in sorted(pairs)], "a long, b long, weight double")
    scores = []
    for most in (10**6, 10):
        parts = graph.communities(Scratch(spark, "t"), edges, f"q{most}", 1.0, most_nodes=most)
        assert parts.select("node").distinct().count() == parts.count() == 150
        scores.append(graph.modularity(edges, parts).first().modularity)
    assert scores[1] > 0.85 * scores[0] > 0.2, scores


def test_louvain_differs_from_leiden_only_by_refinement():
    a, b, w = (np.array(x) for x in zip(*_planted(6, 5, 1), strict=True))
    found = [graph.leiden(30, a, b, w, 1.0, 2 * w.sum(), refine).tolist() for refine in (True, False)]
    assert found[0] == found[1] or len(set(found[0])) >= len(set(found[1]))
