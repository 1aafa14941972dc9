"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic), with their words. Raking scales the cells' weights to the
target shares of each margin in turn until all margins hold, where no cell may give more words than it has: a category's
factor is the one that brings its cells, each cut at its limit, to the target. A document is then kept with the
probability of its cell, so that the expected words of each margin follow the targets and their sum is the budget.

Topics are clusters of the documents' words: hashed vectors of long words, from which the mean of the document's language
is taken so that no topic is a language, grouped by spherical k-means over all documents.

Targets name their categories; all other categories of a margin, nulls included, are one category that keeps its natural
share unless the target names ``OTHER``. So the number of cells is bounded by the targets, and the raking itself runs on
that small table on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tallyforge.llm import textkit as tk
from tallyforge.llm.shared import Scratch, fresh

OTHER = "(other)"
TOPICS = 8
MARGINS = ("source", "lang", "topic")


DIMENSIONS = 64


def _vectors(text: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(words, unit vector of the words of five bytes and more) of each text; zeros for a text without such words."""
    count, rows = [np.zeros(0, np.int64)], [np.zeros((0, DIMENSIONS), np.float32)]
    for i, j, data, offsets in tk.batches(text, "text", lower_unicode=True):
        w = tk.words(data, offsets, tk.PUNCTUATION, lower=False)
        long = w.end - w.start >= 5
        doc, h = np.repeat(np.arange(j - i), np.diff(w.first))[long], w.hash[long]
        sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(float)
        v = np.bincount(doc * DIMENSIONS + (h % np.uint64(DIMENSIONS)).astype(np.int64), sign, (j - i) * DIMENSIONS).reshape(-1, DIMENSIONS)
        v = np.sign(v) * np.sqrt(np.abs(v))
        rows.append((v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)).astype(np.float32))
        count.append(np.diff(w.first))
    return np.concatenate(count), np.concatenate(rows)


def _assigned(vectors: np.ndarray, langs: list, means: dict[str, np.ndarray], centres: np.ndarray) -> np.ndarray:
    """The centre of the greatest inner product with each vector, less its language's mean; ties: the first."""
    names = sorted(means)
    at = np.array([names.index(x) for x in langs], np.int64)
    left = vectors - np.stack([means[n] for n in names])[at] if names else vectors
    left[~vectors.any(1)] = 0
    return np.einsum("ij,kj->ik", left.astype(np.float64), centres).argmax(1) if len(centres) else np.zeros(len(vectors), np.int64)


def _sums(rows: DataFrame, group) -> dict[str, np.ndarray]:
    """Count and sum of the vectors by group (a string for each row of a batch): (1 + DIMENSIONS) numbers a group."""

    def run(it):
        found: dict[str, np.ndarray] = {}
        for batch in it:
            v = batch.column("vector").flatten().to_numpy().reshape(-1, DIMENSIONS).astype(np.float64)
            names = np.array(group(batch, v), object)
            for name in set(names.tolist()):
                part = v[names == name]
                found[name] = found.get(name, 0) + np.concatenate(([len(part)], part.sum(0)))
        for name, s in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(s), pa.string()), pa.array(range(len(s)), pa.int32()), pa.array(s)], ["name", "at", "s"])

    out: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(run, "name string, at int, s double").groupBy("name", "at").agg(F.sum("s").alias("s")).collect():
        out.setdefault(r.name, np.zeros(1 + DIMENSIONS))[r.at] = r.s
    return out


def _topics(rows: DataFrame, lang: str, topics: int, rounds: int, first: int = 2_000) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(mean vector of each language, centres) by k-means over all rows. The first centres are far from each other among
    the ``first`` rows of the smallest hashes."""
    means = {k: s[1:] / s[0] for k, s in _sums(rows, lambda batch, _: batch.column(lang).to_pylist()).items()}
    some = rows.select(lang, "vector").orderBy(F.xxhash64("vector"), lang).limit(first).collect()
    if not some:
        return means, np.zeros((0, DIMENSIONS))
    v = np.array([np.array(r.vector) - means[r[0]] for r in some])
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    chosen = [0]
    while len(chosen) < topics:
        chosen.append(int((v @ v[chosen].T).max(1).argmin()))
    centres = v[chosen]
    for _ in range(rounds):
        now = centres

        def group(batch, x, now=now):
            return _assigned(x, batch.column(lang).to_pylist(), means, now).astype(str)

        found = _sums_centred(rows, lang, means, group)
        centres = np.stack([s[1:] / n if (s := found.get(str(k))) is not None and (n := np.linalg.norm(s[1:])) > 0 else now[k] for k in range(topics)])
        if np.abs(centres - now).max() < 1e-3:
            break
    return means, centres


def _sums_centred(rows: DataFrame, lang: str, means: dict[str, np.ndarray], group) -> dict[str, np.ndarray]:
    """Sums by group of the vectors less their languages' means."""
    by = _sums(rows, lambda batch, v: [f"{g} {x}" for g, x in zip(group(batch, v), batch.column(lang).to_pylist(), strict=True)])
    out: dict[str, np.ndarray] = {}
    for name, s in by.items():
        k, x = name.split(" ", 1)
        out[k] = out.get(k, 0) + np.concatenate((s[:1], s[1:] - s[0] * means[x]))
    return out


def _feasible(wanted: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Shares of a margin cut at what its categories can give; what is over goes to the others in proportion."""
    wanted = wanted.copy()
    for _ in range(len(wanted)):
        over = wanted > most
        rest = ~over & (wanted > 0) & (wanted < most)
        spare = (wanted - most)[over].sum()
        wanted[over] = most[over]
        if spare <= 1e-15 or not rest.any():
            break
        wanted[rest] *= 1 + spare / wanted[rest].sum()
    return np.minimum(wanted, most)


def _factor(x: np.ndarray, most: np.ndarray, wanted: float) -> float:
    """f with sum(min(most, f * x)) = wanted; if even the limits don't reach it, one that takes all of them."""
    there = x > 0
    x, most = x[there], most[there]
    if not len(x) or wanted <= 0:
        return 0.0
    at = most / x
    order = np.argsort(at)
    at, x, most = at[order], x[order], most[order]
    full = np.concatenate(([0.0], np.cumsum(most)))
    open_ = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))  # never 0 before the last
    reached = np.append(full[:-1] + at * open_[:-1], np.inf)
    k = int(np.searchsorted(reached, wanted))
    if k == len(x):
        return float(at[-1])
    return (wanted - full[k]) / open_[k]


def _raked(base: np.ndarray, wanted: list[np.ndarray], most: np.ndarray | None, rounds: int, close: float) -> tuple[np.ndarray, float]:
    """(table, largest miss of a margin) of scaling ``base`` to margins, no cell over ``most``; ends when it gets no closer."""
    table, axes = base.copy(), range(base.ndim)
    along = lambda x, k: x.sum(axis=tuple(a for a in axes if a != k))
    cut = (lambda x: x) if most is None else (lambda x: np.minimum(x, most))
    best, since = np.inf, 0
    for _ in range(rounds):
        worst = 0.0
        for k in axes:
            worst = max(worst, float(np.abs(wanted[k] - along(cut(table), k)).max(initial=0.0)))
            for i, t in enumerate(wanted[k]):
                cells = tuple(i if a == k else slice(None) for a in axes)
                part = table[cells]
                if most is None:
                    table[cells] *= t / s if (s := part.sum()) > 0 else 0.0
                else:
                    table[cells] *= _factor(part.ravel(), most[cells].ravel(), t)
        if most is not None:
            table = np.clip(table, base * 1e-100, 1e100)  # margins that contradict each other drive cells ever further
        best, since = (worst, 0) if worst < 0.99 * best else (best, since + 1)
        if worst < close or most is not None and since > 40:
            break
    return cut(table), float(np.max([np.abs(wanted[k] - along(cut(table), k)).max(initial=0.0) for k in axes]))


def rake(amounts: np.ndarray, targets: list[np.ndarray], keep: float | None = None, rounds: int = 2_000, close: float = 1e-10, near: float = 1e-4) -> np.ndarray:
    """Shares of the sample by cell: a table of amounts scaled until its margins have the target shares (each sums to 1).
    With ``keep``, the share of all amounts that is sampled, no cell exceeds its amount. A category without amounts, or
    without enough, can't be raised so far: what it lacks goes to the others of its margin in proportion. Empty tables
    stay empty. Where margins contradict each other under the limits, all targets move towards the natural shares, by
    the smallest common step (of 1/256) at which they can hold within ``near``; at the natural shares they always can."""
    if not amounts.sum() > 0:
        return amounts.astype(float)
    base, axes = amounts / amounts.sum(), range(amounts.ndim)
    along = lambda x, k: x.sum(axis=tuple(a for a in axes if a != k))
    most = base / keep if keep else None
    wanted = []
    for k in axes:
        t = np.where(along(amounts, k) > 0, targets[k], 0.0)
        t = t / t.sum() if t.sum() > 0 else t
        wanted.append(t if most is None else _feasible(t, along(most, k)))
    table, worst = _raked(base, wanted, most, rounds, close)
    if most is None or worst < near:
        return table
    moved = lambda step: [(1 - step / 256) * w + step / 256 * along(base, k) for k, w in enumerate(wanted)]
    low, high, table = 0, 256, base
    while high - low > 1:
        middle = (low + high) // 2
        tried, worst = _raked(base, moved(middle), most, 300, near / 10)
        low, high, table = (low, middle, tried) if worst < near else (middle, high, table)
    return table


Target = Mapping[str, float] | float


def _shares(target: Target, natural: Mapping[str, float]) -> tuple[list[str], np.ndarray]:
    """Categories (the named ones in order, then OTHER) and their shares. A number instead of names tempers: shares in
    proportion to the natural ones to that power."""
    if not isinstance(target, Mapping):
        names = [n for n in sorted(natural) if n != OTHER] + [OTHER]
        share = np.array([natural.get(n, 0.0) for n in names], float) ** target
        share[[natural.get(n, 0.0) <= 0 for n in names]] = 0
        return names, share / share.sum() if share.sum() > 0 else share
    names = [n for n in sorted(target) if n != OTHER] + [OTHER]
    total = sum(natural.values()) or 1.0
    other = target.get(OTHER, sum(v for k, v in natural.items() if k not in target) / total)
    named = np.array([target[n] for n in names[:-1]], float)
    named = named / named.sum() * (1 - other) if named.sum() > 0 else named
    return names, np.append(named, other)


def margins(cells: Mapping[tuple[str, ...], int], found: Mapping[tuple[str, ...], tuple[float, float]], targets: Mapping[str, Target]) -> list[tuple[str, str, float, float, float]]:
    """(margin, category, natural share, target share, share of the expected sample) of each category that occurs."""
    out, total = [], sum(cells.values())
    sample = sum(n * found[c][1] for c, n in cells.items())
    for k, m in enumerate(MARGINS):
        natural, reached = {}, {}
        for c, n in cells.items():
            natural[c[k]] = natural.get(c[k], 0) + n
            reached[c[k]] = reached.get(c[k], 0) + n * found[c][1]
        for name, share in zip(*_shares(targets[m], natural), strict=True):
            if natural.get(name):
                out.append((m, name, natural[name] / total, float(share), reached[name] / sample if sample else 0.0))
    return out


def probabilities(cells: Mapping[tuple[str, ...], int], targets: Mapping[str, Target], keep: float, margins: tuple[str, ...] = MARGINS) -> dict[tuple[str, ...], tuple[float, float]]:
    """(share of the sample, probability) of each cell, for cells of (margin values) to words. The budget is ``keep`` of
    all words; a cell can't give more than it has."""
    names, shares = [], []
    for k, m in enumerate(margins):
        natural: dict[str, float] = {}
        for c, n in cells.items():
            natural[c[k]] = natural.get(c[k], 0) + n
        a, b = _shares(targets[m], natural)
        names.append(a)
        shares.append(b)
    amounts = np.zeros([len(n) for n in names])
    for c, n in cells.items():
        amounts[tuple(names[k].index(c[k]) for k in range(len(margins)))] += n
    raked = rake(amounts, shares, keep)
    p = np.divide(raked * keep * amounts.sum(), amounts, out=np.zeros_like(raked), where=amounts > 0)
    place = {c: tuple(names[k].index(c[k]) for k in range(len(margins))) for c in cells}
    return {c: (float(raked[at]), float(min(1.0, p[at]))) for c, at in place.items()}


def _named(c: str, target: Target, topics: int) -> Column:
    """The target's category of a row; a tempered margin knows the topics by name."""
    known = [n for n in target if n != OTHER] if isinstance(target, Mapping) else [f"topic{k}" for k in range(topics)]
    return F.when(F.col(c).isin(known), F.col(c)).otherwise(F.lit(OTHER)) if known else F.lit(OTHER)


def _counted(docs: DataFrame, targets: Mapping[str, Target], topics: int, rounds: int) -> tuple[dict[tuple[str, ...], int], dict[str, np.ndarray], np.ndarray]:
    """(words by cell, language means, topic centres): one pass over the texts, whose vectors are written."""
    scratch = Scratch(docs.sparkSession, "mixing")
    cut = docs.select(_named("source", targets["source"], topics).alias("source"), _named("lang", targets["lang"], topics).alias("lang"), "text")

    def run(it):
        for batch in it:
            n, v = _vectors(batch.select(["text"]))
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("lang"), pa.array(n), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), DIMENSIONS).cast(pa.list_(pa.float32()))], ["source", "lang", "n", "vector"])

    rows = scratch.keep(cut.mapInArrow(run, "source string, lang string, n long, vector array<float>"), "vectors")
    means, centres = _topics(rows, "lang", topics, rounds)

    def place(it):
        for batch in it:
            v = batch.column("vector").flatten().to_numpy().reshape(-1, DIMENSIONS).astype(np.float64)
            k = _assigned(v, batch.column("lang").to_pylist(), means, centres)
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("lang"), pa.array([f"topic{x}" for x in k.tolist()], pa.string()), batch.column("n")], ["source", "lang", "topic", "n"])

    placed = rows.mapInArrow(place, "source string, lang string, topic string, n long")
    #: One row a cell, at most the product of the targets' lengths.
    cells = placed.groupBy("source", "lang", _named("topic", targets["topic"], topics).alias("topic")).agg(F.sum("n").alias("n")).collect()
    scratch.drop("vectors")
    return {tuple(r[:-1]): r["n"] for r in cells}, means, centres


def _read(docs: DataFrame, n_words: str, topic: str, lang: str, means: dict[str, np.ndarray], centres: np.ndarray) -> DataFrame:
    """``docs`` with its number of words and its topic; a text without long words is of topic0. ``lang``: the column of
    the language's category."""
    columns = docs.columns

    def run(it):
        for batch in it:
            n, v = _vectors(pa.RecordBatch.from_arrays([batch.column(columns.index("text"))], ["text"]))
            k = _assigned(v, batch.column(columns.index(lang)).to_pylist(), means, centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array([f"topic{x}" for x in k.tolist()], pa.string())], [*columns, n_words, topic])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(n_words, LongType()), StructField(topic, StringType())]))


def _weighed(docs: DataFrame, targets: Mapping[str, Target], keep: float, seed: int, topics: int, names: Mapping[str, str], rounds: int) -> DataFrame:
    """``docs`` and, under the given names, its n_words, topic, weight, probability and draw ``kept``."""
    spark, n_words, topic = docs.sparkSession, names["n_words"], names["topic"]
    cells, means, centres = _counted(docs.select("source", "lang", "text"), targets, topics, rounds)
    cell = {m: fresh(docs, f"cell_{m}") for m in MARGINS}
    read = docs.withColumns({cell[m]: _named(m, targets[m], topics) for m in ("source", "lang")})
    read = _read(read, n_words, topic, cell["lang"], means, centres).withColumn(cell["topic"], _named(topic, targets["topic"], topics))
    total = sum(cells.values())
    rows = [(*c, s / (cells[c] / total) if cells[c] else 0.0, p) for c, (s, p) in probabilities(cells, targets, keep).items()]
    table = spark.createDataFrame(rows, StructType([*(StructField(cell[m], StringType()) for m in MARGINS), StructField(names["weight"], DoubleType()), StructField(names["probability"], DoubleType())]))
    out = read.join(F.broadcast(table), list(cell.values()), "left")
    draw = F.expr(f"pmod(xxhash64(coalesce(doc_id, -1L), {seed}), 1000000007) / 1000000007.0d")
    out = out.withColumn(names["kept"], draw < F.coalesce(F.col(names["probability"]), F.lit(0.0)))
    return out.select(*(f"`{c}`" for c in docs.columns), n_words, topic, names["weight"], names["probability"], names["kept"])


_NAMES = ("n_words", "topic", "weight", "probability", "kept")


def weigh(docs: DataFrame, targets: Mapping[str, Target], keep: float, seed: int = 11, topics: int = TOPICS, rounds: int = 6) -> DataFrame:
    """doc_id, source, lang, n_words, topic, weight (share of the sample over natural share of the cell), probability,
    kept.

    A document's draw is a hash of its doc_id and the seed, so a rerun keeps the same documents; equal doc_ids in one
    cell share their fate, and a null doc_id draws as the value -1. A null or empty text has no words: it adds nothing
    to its cell but is drawn like the rest of it. In a cell without any words nothing is kept. Other columns are
    ignored. An empty table gives an empty result. ``rounds``: passes of k-means over the documents' vectors.
    """
    return _weighed(docs.select("doc_id", "source", "lang", "text"), targets, keep, seed, topics, {n: n for n in _NAMES}, rounds).drop("text")


def reached(docs: DataFrame, targets: Mapping[str, Target], keep: float, topics: int = TOPICS, rounds: int = 6) -> DataFrame:
    """margin, category, natural, target, reached: the shares of words before, asked for, and expected of the sample. A
    target isn't reached where its category, or the cells that other margins leave it, hold too few words."""
    cells, _, _ = _counted(docs.select("source", "lang", "text"), targets, topics, rounds)
    rows = margins(cells, probabilities(cells, targets, keep), targets)
    return docs.sparkSession.createDataFrame(rows, "margin string, category string, natural double, target double, reached double")


#: Target shares of the production mix; topics by the square root of their natural shares.
TARGETS: Mapping[str, Target] = {
    "source": {f"src{i}": 1.0 for i in range(20)},
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
    "topic": 0.5,
}
KEEP = 0.5


def sample(docs: DataFrame, targets: Mapping[str, Target] = TARGETS, keep: float = KEEP, seed: int = 11, topics: int = TOPICS, rounds: int = 6) -> DataFrame:
    """The drawn documents: ``docs`` with its columns and, last, the probability that they were drawn by."""
    names = {n: fresh(docs, n) for n in _NAMES} | ({"probability": "probability"} if "probability" not in docs.columns else {})
    return _weighed(docs, targets, keep, seed, topics, names, rounds).where(names["kept"]).drop(*(names[n] for n in ("n_words", "topic", "weight", "kept")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its cell, weight, probability and draw."""
    return weigh(spark.read.parquet(f"{sf_dir}/documents.parquet"), TARGETS, KEEP)
