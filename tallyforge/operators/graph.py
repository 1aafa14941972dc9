"""Graphs of products: components, communities and their quality."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.storage import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of undirected ``edges`` (a, b); a component is named by its smallest node.

    Alternating large-star and small-star (Kiveris et al., 2014), a round of three shuffles each; rounds are written,
    and the loop ends when all edges are stars. A star's rows pass one sorted window, which spills and gathers nothing.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = lambda: F.min("b").over(Window.partitionBy("a"))
    for k in range(rounds):
        now = scratch.keep(now, f"{name}-{k}")
        if k:
            scratch.drop(f"{name}-{k - 1}")
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("low")).union(now.select(F.col("b").alias("v"), F.lit(0).alias("low")))
        ends = ends.groupBy("v").agg(F.sum("low").alias("n"), F.count("*").alias("c"))
        if not ends.where("n > 1 or n = 1 and c > 1").take(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        large = now.union(now.select("b", "a")).withColumn("m", F.least(least(), F.col("a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.withColumn("m", least())
        now = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
    raise RuntimeError(f"{name}: components need more than {rounds} rounds")


def with_singletons(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Components of all ``nodes`` (node): those without edges are their own."""
    return nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def positive_edges(edges: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(a, b, weight) of undirected edges: the largest weight of each pair, and edges of weight 1 from each node to the
    smallest node of its previous family. ``edges``: a, b, weight; ``previous``: node, family."""
    rows = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight"))
    if previous is not None:
        root = F.min("node").over(Window.partitionBy("family"))
        rows = rows.union(previous.where("family is not null and family <> ''").withColumn("a", root).where("a <> node").select("a", F.col("node").alias("b"), F.lit(1.0).alias("weight")))
    return rows.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def _adjacency(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> list[dict[int, float]]:
    out: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        out[i][j] = out[i].get(j, 0.0) + x
        if i != j:
            out[j][i] = out[j].get(i, 0.0) + x
    return out


def _moved(links: list[dict[int, float]], degree: np.ndarray, start: np.ndarray, gamma: float, two_m: float, bound: np.ndarray | None = None) -> np.ndarray:
    """Fast local moving: nodes go to the neighbouring community of the best gain until none gains. With ``bound``, only
    into communities of the same bound, and only nodes that are alone."""
    part = start.copy()
    total = np.bincount(part, degree, len(links))
    size = np.bincount(part, minlength=len(links))
    queue, waiting = deque(range(len(links))), np.ones(len(links), bool)
    while queue:
        i = queue.popleft()
        waiting[i] = False
        if bound is not None and size[part[i]] > 1:
            continue
        own = part[i]
        weight: dict[int, float] = {own: 0.0}
        for j, w in links[i].items():
            if j != i and (bound is None or bound[j] == bound[i]):
                weight[part[j]] = weight.get(part[j], 0.0) + w
        total[own] -= degree[i]
        size[own] -= 1
        best, gain = own, weight[own] - gamma * degree[i] * total[own] / two_m
        for c in sorted(weight):
            g = weight[c] - gamma * degree[i] * total[c] / two_m
            if g > gain + 1e-12:
                best, gain = c, g
        part[i] = best
        total[best] += degree[i]
        size[best] += 1
        if best != own:
            for j in sorted(links[i]):
                if part[j] != best and not waiting[j]:
                    queue.append(j)
                    waiting[j] = True
    return part


def leiden(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, gamma: float, two_m: float, refine: bool = True) -> np.ndarray:
    """Communities of a weighted graph by the Leiden method for modularity with resolution ``gamma``; ``two_m`` is twice
    the weight of the whole graph that this is a part of. Deterministic: nodes in order, ties to the smallest. Without
    ``refine`` whole communities become the next level's nodes, which is the Louvain method."""
    links = _adjacency(n, a, b, w)
    degree = np.array([sum(x for j, x in l.items() if j != i) + 2 * l.get(i, 0.0) for i, l in enumerate(links)])
    member = np.arange(n)
    part = np.arange(n)
    while True:
        part = _moved(links, degree, part, gamma, two_m)
        refined = _moved(links, degree, np.arange(len(links)), gamma, two_m, bound=part) if refine else part
        names, place = np.unique(refined, return_inverse=True)
        if len(names) == len(links) or len(np.unique(part)) == len(links):
            return part[member]
        member = place[member]
        outer = part[names]
        links_next: list[dict[int, float]] = [{} for _ in names]
        for i, l in enumerate(links):
            for j, x in l.items():
                if i <= j:
                    p, r = int(place[i]), int(place[j])
                    p, r = min(p, r), max(p, r)
                    links_next[p][r] = links_next[p].get(r, 0.0) + x
                    if p != r:
                        links_next[r][p] = links_next[p][r]
        degree = np.bincount(place, degree, len(names))
        first = {c: k for k, c in reversed(list(enumerate(outer.tolist())))}
        part = np.array([first[c] for c in outer.tolist()])
        links = links_next


def label_propagation(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Labels by the heaviest of the neighbours', ties to the smallest; in order, until none changes."""
    links, label = _adjacency(n, a, b, w), np.arange(n)
    for _ in range(rounds):
        changed = False
        for i in range(n):
            votes: dict[int, float] = {}
            for j, x in links[i].items():
                votes[int(label[j])] = votes.get(int(label[j]), 0.0) + x
            if votes:
                best = min(votes, key=lambda c: (-votes[c], c))
                if best != label[i]:
                    label[i], changed = best, True
        if not changed:
            break
    return label


def _local_moves(scratch: Scratch, edges: DataFrame, degrees: DataFrame, gamma: float, two_m: float, name: str, rounds: int) -> DataFrame:
    """(node, component) by local moving over tables. ``edges``: (a, b, weight) in both directions, no loops; ``degrees``:
    (node, k). In a round about half of the nodes, dealt by hash, may go to the neighbouring community of the best gain
    (ties to the smallest), so neighbours seldom swap; a single node doesn't join a single one of a larger name. With a ``gamma`` of 0 this
    is label propagation."""
    now, quiet = scratch.keep(degrees.select("node", "k", F.col("node").alias("c")), f"{name}-0"), 0
    for r in range(1, rounds + 1):
        total = now.groupBy("c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
        own = now.join(total, "c").select(F.col("node").alias("a"), "k", F.col("c").alias("own"), F.col("total").alias("own_total"), F.col("size").alias("own_size"))
        links = edges.join(now.select(F.col("node").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("weight").alias("w"))
        tried = links.join(total, "c").join(own, "a")
        inside = F.col("c") == F.col("own")
        tried = tried.withColumn("gain", F.col("w") - gamma * F.col("k") * (F.col("total") - F.when(inside, F.col("k")).otherwise(0.0)) / two_m)
        stay = F.coalesce(F.max(F.when(inside, F.col("gain"))), F.max(-gamma * F.col("k") * (F.col("own_total") - F.col("k")) / two_m))
        open_to = (F.col("own_size") > 1) | (F.col("size") > 1) | (F.col("c") < F.col("own"))
        best = tried.groupBy("a").agg(stay.alias("stay"), F.min(F.when(~inside, F.struct((-F.col("gain")).alias("g"), F.col("c").alias("c"), open_to.alias("open")))).alias("m"))
        moves = best.where(F.col("m.open") & (-F.col("m.g") > F.col("stay") + 1e-12) & (F.pmod(F.xxhash64("a", F.lit(r)), F.lit(2)) == 0)).select(F.col("a").alias("node"), F.col("m.c").alias("to"))
        after = scratch.keep(now.join(moves, "node", "left").select("node", "k", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")), f"{name}-{r}")
        scratch.drop(f"{name}-{r - 1}")
        quiet = 0 if after.where("moved").take(1) else quiet + 1
        now = after.drop("moved")
        if quiet == 3:
            break
    return now.select("node", F.col("c").alias("component"))


def spread_communities(scratch: Scratch, edges: DataFrame, name: str, gamma: float, two_m: float, method: str = "leiden", levels: int = 12, rounds: int = 40) -> DataFrame:
    """(node, component) of a graph of any size, for undirected ``edges`` (a, b, weight), each once: local moving, then
    the same on the graph of communities, until none joins another. No task holds more than its share of edges. For the
    Leiden method a community that has come apart is split into its connected parts on each level."""
    both = edges.where("a <> b").select("a", "b", "weight").union(edges.where("a <> b").select("b", "a", "weight"))
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("k"))
    both, degrees = scratch.keep(both, f"{name}-both"), scratch.keep(degrees, f"{name}-k")
    if method == "label_propagation":
        return _named_by_least(_local_moves(scratch, both, degrees, 0.0, 1.0, f"{name}-moves", rounds))
    member = degrees.select("node", F.col("node").alias("component"))
    for level in range(levels):
        part = scratch.keep(_local_moves(scratch, both, degrees, gamma, two_m, f"{name}-moves-{level}", rounds), f"{name}-part-{level}")
        if method == "leiden":
            left, right = part.toDF("a", "ca"), part.toDF("b", "cb")
            inner = both.where("a < b").join(left, "a").join(right, "b").where("ca = cb").select("a", "b")
            part = scratch.keep(with_singletons(components(scratch, inner, f"{name}-whole-{level}"), part.select("node")), f"{name}-split-{level}")
        if not part.where("node <> component").take(1):
            break
        member = scratch.keep(member.join(part.toDF("component", "next"), "component").select("node", F.col("next").alias("component")), f"{name}-member-{level}")
        left, right = part.toDF("a", "ca"), part.toDF("b", "cb")
        both = both.join(left, "a").join(right, "b").where("ca <> cb").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("weight").alias("weight"))
        degrees = degrees.join(part, "node").groupBy(F.col("component").alias("node")).agg(F.sum("k").alias("k"))
        both, degrees = scratch.keep(both, f"{name}-both-{level}"), scratch.keep(degrees, f"{name}-k-{level}")
    return _named_by_least(member)


def _named_by_least(parts: DataFrame) -> DataFrame:
    least = parts.groupBy("component").agg(F.min("node").alias("least"))
    return parts.join(least, "component").select("node", F.col("least").alias("component"))


def communities(scratch: Scratch, edges: DataFrame, name: str, gamma: float = 0.1, method: str = "leiden", most_nodes: int = 200_000) -> DataFrame:
    """(node, component) by communities inside each connected component; a community is named by its smallest node.

    Communities never cross components, so each component is a group of its own; the null model's total weight is that
    of the whole graph. A task groups a component of up to ``most_nodes`` nodes in its memory; larger ones are grouped
    by the same moves over tables, in rounds instead of node by node.
    """
    if method not in ("leiden", "louvain", "label_propagation"):
        raise ValueError(f"no method is called {method!r}")
    edges = scratch.keep(positive_edges(edges), f"{name}-edges")
    two_m = 2 * float(edges.agg(F.sum(F.col("weight"))).first()[0] or 0.0)
    parts = components(scratch, edges, name)
    large = scratch.keep(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 > most_nodes).select("component"), f"{name}-large")
    rows = edges.join(parts.union(parts.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "a"), "a")
    several = bool(large.take(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate((pdf["a"].to_numpy(), pdf["b"].to_numpy())))
        order = np.lexsort((pdf["b"].to_numpy(), pdf["a"].to_numpy()))
        a, b, w = (np.searchsorted(names, pdf[c].to_numpy()[order]) if c != "weight" else pdf[c].to_numpy()[order] for c in ("a", "b", "weight"))
        found = label_propagation(len(names), a, b, w) if method == "label_propagation" else leiden(len(names), a, b, w, gamma, two_m, method == "leiden")
        first = {c: names[i] for i, c in reversed(list(enumerate(found.tolist())))}
        return pd.DataFrame({"node": names, "component": [first[c] for c in found.tolist()]})

    kind = dict(edges.dtypes)["a"]
    small = rows.join(large, "component", "left_anti") if several else rows
    out = small.groupBy("component").applyInPandas(run, f"node {kind}, component {kind}")
    return out.union(spread_communities(scratch, rows.join(large, "component", "left_semi"), f"{name}-spread", gamma, two_m, method)) if several else out


def modularity(edges: DataFrame, parts: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: the modularity of a partition (node, component) of a weighted graph."""
    left, right = parts.toDF("a", "ca"), parts.toDF("b", "cb")
    both = edges.join(left, "a").join(right, "b")
    inner = both.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inside"))
    ends = both.select(F.col("ca").alias("c"), "weight").union(both.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    total = edges.agg(F.sum("weight").alias("m"))
    rows = ends.join(inner, "c", "left").crossJoin(total)
    return rows.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - gamma * F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("modularity"))


def sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
