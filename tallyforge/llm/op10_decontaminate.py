"""Benchmark decontamination by greedy string tiling.

A benchmark item and a document are sequences of words (maximal runs of characters other than ASCII punctuation and
white space, case-folded). An item that shares a run of ``min_match`` words with a document is a seed; on seeded pairs,
greedy string tiling marks tiles: again and again the longest matches that no tile overlaps yet, found by running
Karp-Rabin hashes of the current search length, until matches are shorter than ``min_match``. Reordered passages are
tiles in any order. A document is contaminated by an item when tiles cover at least ``least`` of the item's words.

Documents stream past the benchmark, which is taken in blocks of at most ``block_words`` words, so what is broadcast at a
time has a fixed bound. Of several blocks each one's pairs are written, and its broadcast freed, before the next.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyforge.llm import textkit as tk
from tallyforge.llm.shared import Scratch


def tile(pattern: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (pattern position, text position, length) of each tile.

    The search length starts at the longest possible and halves when all its matches are dealt with; a match longer than
    twice the search length restarts the search there. Matches are marked longest first, ties by position; what a tile
    leaves of a match that it cuts is a match again, so each tile is the longest match that is free at its time.
    """
    marked_p, marked_t = np.zeros(len(pattern), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    search = max(min_match, min(len(pattern), len(text)) // 2)
    while True:
        found = _matches(pattern, text, marked_p, marked_t, search)
        if found and -found[0][0] > 2 * search:
            search = -found[0][0]
            continue
        while found:
            length, p, t = heapq.heappop(found)
            length = -length
            #: Tiles of this search are no shorter, so one that overlaps holds an end of the match.
            if not (marked_p[p] or marked_t[t] or marked_p[p + length - 1] or marked_t[t + length - 1]):
                marked_p[p : p + length] = marked_t[t : t + length] = True
                tiles.append((p, t, length))
                continue
            taken = np.concatenate(([True], marked_p[p : p + length] | marked_t[t : t + length], [True]))
            edges = np.flatnonzero(taken)
            for i in np.flatnonzero(np.diff(edges) > search).tolist():
                heapq.heappush(found, (int(edges[i] + 1 - edges[i + 1]), p + int(edges[i]), t + int(edges[i])))
        if search == min_match:
            return tiles
        search = max(min_match, search // 2)


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Whether a run of n unmarked words starts at a position."""
    if len(marked) < n:
        return np.zeros(0, bool)
    sums = np.concatenate(([0], np.cumsum(marked)))
    return sums[n:] == sums[:-n]


_PAIRS = 1 << 20


def _matches(pattern, text, marked_p, marked_t, n):
    """A heap of (-length, pattern position, text position) of the maximal matches of at least n unmarked words.

    Runs of n words that agree are pairs of positions; on a diagonal, neighbouring pairs are one match, of which only
    the first and the last pair are kept. Pairs are looked at ``_PAIRS`` or one text position's at a time.
    """
    free_p, free_t = _free(marked_p, n), _free(marked_t, n)
    if not free_p.any() or not free_t.any():
        return []
    hash_p, hash_t = tk.grams(pattern, n), tk.grams(text, n)
    at_p, at_t = np.flatnonzero(free_p), np.flatnonzero(free_t)
    at_p = at_p[np.argsort(hash_p[at_p], kind="stable")]
    known = hash_p[at_p]
    low, high = np.searchsorted(known, hash_t[at_t]), np.searchsorted(known, hash_t[at_t], "right")
    at_t, low, count = at_t[high > low], low[high > low], (high - low)[high > low]
    if not len(at_t):
        return []

    def agree(p, t):
        inside = (p >= 0) & (t >= 0) & (p < len(hash_p)) & (t < len(hash_t))
        p, t = np.where(inside, p, 0), np.where(inside, t, 0)
        return inside & free_p[p] & free_t[t] & (hash_p[p] == hash_t[t])

    first, last, sums, a = [], [], np.concatenate(([0], np.cumsum(count))), 0
    while a < len(at_t):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + _PAIRS, "right")) - 1)
        k = count[a:b]
        t = np.repeat(at_t[a:b], k)
        p = at_p[np.repeat(low[a:b] - (sums[a:b] - sums[a]), k) + np.arange(sums[b] - sums[a])]
        for out, step in ((first, -1), (last, 1)):
            edge = ~agree(p + step, t + step)
            out.append(np.stack((t[edge] - p[edge], t[edge])))
        a = b
    first, last = (np.concatenate(x, 1) for x in (first, last))
    first, last = (x[:, np.lexsort((x[1], x[0]))] for x in (first, last))
    length = last[1] - first[1] + n
    out = list(zip((-length).tolist(), (first[1] - first[0]).tolist(), first[1].tolist(), strict=True))
    heapq.heapify(out)
    return out


def _words(batch: pa.RecordBatch):
    for i, j, data, offsets in tk.batches(batch, "text", lower_unicode=True):
        yield i, j, tk.words(data, offsets, tk.PUNCTUATION, lower=False)


def item_blocks(items: DataFrame, block_words: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The benchmark's word hashes in blocks of at most ``block_words`` words (an item longer than that is alone), one
    block at a time on the driver."""
    def run(it):
        for batch in it:
            for i, j, w in _words(batch):
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(i, j - i), tk.list_column([w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)])], ["item_id", "words"])

    rows = items.where("item_id is not null").select("item_id", "text").mapInArrow(run, "item_id long, words array<long>").where("size(words) > 0")
    rows = rows.dropDuplicates().orderBy("item_id", "words")
    ids, words, held = [], [], 0
    for row in rows.toLocalIterator():
        if ids and held + len(row.words) > block_words:
            yield ids, words
            ids, words, held = [], [], 0
        ids.append(row.item_id)
        words.append(np.array(row.words, np.int64).view(np.uint64))
        held += len(row.words)
    if ids:
        yield ids, words


def _seeds(words: list[np.ndarray], min_match: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the items' runs of ``min_match`` words, and the item of each. A shorter item is one run."""
    h, owner = [], []
    for k, w in enumerate(words):
        g = tk.grams(w, min(min_match, len(w)))
        h.append(g)
        owner.append(np.full(len(g), k))
    h, owner = np.concatenate(h), np.concatenate(owner)
    order = np.lexsort((owner, h))
    return h[order], owner[order]


def coverage(docs: DataFrame, items: DataFrame, min_match: int = 5, least: float = 0.5, block_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, covered (words in tiles), item_words, share of each pair of a document and an item with at least
    ``least`` of the item covered.

    Null, empty or blank texts and items match nothing, nor does a null item_id. An item of fewer than ``min_match``
    words must occur whole. Rows that repeat a doc_id or an item are each compared; equal results are one row. Two texts
    under one item_id are two items with that id; the larger share counts. Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, covered long, item_words long, share double"
    out = None

    def scan(sent):
        def run(it):
            ids, words, seeds, owner = sent.value
            sizes = sorted({min(min_match, len(w)) for w in words})
            for batch in it:
                for i, _, w in _words(batch):
                    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
                    pairs = []
                    for n in sizes:
                        g = tk.grams(w.hash, n)
                        if not len(g):
                            continue
                        lo = np.searchsorted(seeds, g)
                        hit = np.flatnonzero((lo < len(seeds)) & (seeds[np.minimum(lo, len(seeds) - 1)] == g))
                        hit = hit[text[hit] == text[hit + n - 1]]
                        hi = np.searchsorted(seeds, g[hit], "right")
                        count = hi - lo[hit]
                        at = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(count.sum())
                        pairs.append(np.stack((np.repeat(text[hit], count), owner[at])))
                    pairs = np.unique(np.concatenate(pairs, 1), axis=1) if pairs else np.zeros((2, 0), np.int64)
                    rows = []
                    for t, k in pairs.T.tolist():
                        item = words[k]
                        covered = sum(x[2] for x in tile(item, w.hash[w.first[t] : w.first[t + 1]], min(min_match, len(item))))
                        if covered >= least * len(item):
                            rows.append((i + t, ids[k], covered, len(item), covered / len(item)))
                    if rows:
                        at, *rest = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *(pa.array(x) for x in rest)], ["doc_id", "item_id", "covered", "item_words", "share"])

        return run

    scratch, blocks = Scratch(spark, "decontamination"), item_blocks(items, block_words)
    block, k = next(blocks, None), 0
    while block is not None:
        part = docs.select("doc_id", "text").mapInArrow(scan(scratch.send((*block, *_seeds(block[1], min_match)))), schema)
        block, k = next(blocks, None), k + 1
        if block is not None or k > 1:
            part = scratch.keep(part, f"block-{k}")
            scratch.release()
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("share"), F.desc("item_words"))
    return out.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def decontaminate(docs: DataFrame, items: DataFrame, min_match: int = 5, least: float = 0.5) -> DataFrame:
    """``docs`` without the contaminated; columns stay. A row with a null doc_id stays."""
    hit = coverage(docs, items, min_match, least).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``: a row for each contaminated pair."""
    return coverage(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
