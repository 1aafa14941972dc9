"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document is the set of its hashed text features: words, word beginnings of four to six bytes, and the last bytes of
its white-space tokens. One weight a feature is shared by all grades: with score s and rising thresholds t,
``P(grade <= k) = sigmoid(t[k] - s)``. The model gives an expected grade and a tail probability, by which documents are
selected.

The model is trained here, on at most ``sample`` labelled documents (those of the smallest hashed ids) and at most
``most_features`` of their features; labels may be any number of rows. One executor task fits it and sends the driver
its non-zero weights alone. Everything else reads all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import textkit as tk
from tallyforge.llm.shared import fresh

U64 = np.uint64
BITS = 20
_BEGIN = (4, 5, 6)


@dataclass
class OrdinalModel:
    """The features of non-zero weight and their weights; thresholds between neighbouring grades."""

    used: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.used] = self.weights
        return out

    def grade(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of the highest grade)."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))
        return above.sum(1), above[:, -1]


def features(batch: pa.RecordBatch):
    """(i, j, list of sorted distinct feature numbers for rows i..j) by block."""
    import pyarrow.compute as pc

    raw = batch.column("text")
    low = batch.set_column(batch.schema.get_field_index("text"), "text", pc.utf8_lower(raw))
    for i, j, data, offsets in tk.batches(low, "text"):
        w = tk.words(data, offsets, tk.PUNCTUATION, lower=False)
        parts, counts = [w.hash], [np.diff(w.first)]
        length = w.end - w.start
        for k in _BEGIN:
            long = length > k
            parts.append(w.hash_of(w.start[long], w.start[long] + k) ^ U64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            counts.append(np.diff(np.concatenate(([0], np.cumsum(long)))[w.first]))
        data, offsets = tk.text_bytes(raw.slice(i, j - i))
        w = tk.words(data, offsets, tk.SPACES, lower=False)
        parts.append(w.hash_of(np.maximum(w.start, w.end - 2), w.end) ^ U64(77))
        counts.append(np.diff(w.first))
        parts = [(p & U64((1 << BITS) - 1)).astype(np.int32) for p in parts]
        ends = [np.concatenate(([0], np.cumsum(c))) for c in counts]
        out = []
        for d in range(j - i):
            s = np.concatenate([p[e[d] : e[d + 1]] for p, e in zip(parts, ends, strict=True)])
            s.sort()
            out.append(tk.distinct(s))
        yield i, j, out


def fit(flat: np.ndarray, ends: np.ndarray, grades: np.ndarray, top: int, epochs: int = 25, batch: int = 128, rate: float = 0.15, shrink: float = 3e-3, least: int = 3, seed: int = 7) -> OrdinalModel:
    """Minimise the mean negative log-likelihood with AdaGrad and a truncated L1 penalty. Row i has the features
    ``flat[ends[i] : ends[i + 1]]``; those of fewer than ``least`` rows are left out. ``top`` is the highest grade."""
    n = len(grades)
    seen = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(flat), 1 << 20):
        seen += np.bincount(flat[a : a + (1 << 20)], minlength=1 << BITS)
    used = np.flatnonzero(seen >= least)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    rows = [(r := place[flat[a:b]])[r >= 0] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    w, g = np.zeros(len(used)), np.full(len(used), 1e-2)
    share = np.clip([(grades <= k).mean() for k in range(top)], 1e-3, 1 - 1e-3) if n else np.full(top, 0.5)
    cut = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(top))
    gc = np.full(top, 1e-2)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs if n else 0):
        order = rng.permutation(n)
        for a in range(0, n, batch):
            pick = order[a : a + batch]
            at = np.concatenate([rows[i] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            s, y = np.bincount(owner, w[at], len(pick)), grades[pick]
            edges = np.concatenate(([-np.inf], cut, [np.inf]))
            hi, lo = sigmoid(edges[y + 1] - s), sigmoid(edges[y] - s)
            hi[y == top], lo[y == 0] = 1, 0
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            ds = (dhi - dlo) / len(pick)
            grad = np.bincount(at, ds[owner], len(w))
            g += grad * grad
            step = rate / np.sqrt(g)
            w -= step * grad
            w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
            dc = (np.bincount(y, -dhi, top + 1)[:top] + np.bincount(y, dlo, top + 1)[1:]) / len(pick)
            gc += dc * dc
            cut = np.maximum.accumulate(cut - rate / np.sqrt(gc) * dc)
    kept = np.flatnonzero(w)
    return OrdinalModel(used[kept].astype(np.int32), w[kept].astype(np.float32), cut)


def train(docs: DataFrame, labels: DataFrame, grade: str, top: int, sample: int = 16_000, most_features: int = 40_000_000) -> OrdinalModel | None:
    """A model of ``grade`` (SQL over ``labels``, 0 to ``top``), from at most ``sample`` labelled documents. A document
    with several labels takes the lowest; null grades, ids and labels of unknown documents are left out. None if no
    labelled document is left. The task that fits holds at most ``most_features`` numbers of 4 bytes and one document's
    more; documents beyond them, by hashed id, are left out."""
    rated = labels.where("doc_id is not null").select("doc_id", F.expr(f"cast({grade} as int)").alias("grade")).where(f"grade between 0 and {top}")
    rated = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    #: At most ``sample`` rows of two numbers: the bound makes the broadcast safe.
    rows = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id")

    def read(it):
        for batch in it:
            for i, j, sets in features(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("grade").slice(i, j - i), tk.list_column(sets, np.int32)], ["doc_id", "grade", "f"])

    def learn(it):
        parts, sizes, grades, held = [], [], [], 0
        for batch in it:
            if held >= most_features:
                continue
            values, ends = tk.list_values(batch.column("f"))
            enough = int(np.searchsorted(held + ends[1:], most_features)) + 1
            parts.append(values[: ends[min(enough, len(ends) - 1)]].copy())
            sizes.append(np.diff(ends)[:enough])
            grades.append(batch.column("grade").to_numpy()[:enough])
            held += len(parts[-1])
        if grades:
            flat = np.concatenate(parts)
            parts.clear()
            model = fit(flat, np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.concatenate(grades), top)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.used, model.weights, model.thresholds)], ["used", "weights", "thresholds"])

    table = rows.mapInArrow(read, "doc_id long, grade int, f array<int>").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "grade", "f")
    #: One row: at most as many weights as there are features.
    found = table.mapInArrow(learn, "used binary, weights binary, thresholds binary").collect()
    return OrdinalModel(*(np.frombuffer(x, t) for x, t in zip(found[0], (np.int32, np.float32, np.float64), strict=True))) if found else None


def score(docs: DataFrame, model: OrdinalModel | None, expected: str = "expected_grade", tail: str = "tail_probability") -> DataFrame:
    """``docs`` with the expected grade and the probability of the highest grade; both null without a model. A null or
    empty text has no features and gets what the thresholds alone give. Works row by row: repeated rows get equal
    scores."""
    if model is None:
        return docs.withColumns({expected: F.lit(None).cast("double"), tail: F.lit(None).cast("double")})
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(it):
        weights = sent.value.dense()
        for batch in it:
            found = []
            text = pa.RecordBatch.from_arrays([batch.column(columns.index("text"))], ["text"])
            for _, _, sets in features(text):
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                sums = np.concatenate(([0.0], np.cumsum(weights[np.concatenate(sets)], dtype=np.float64)))
                found.append(sums[ends[1:]] - sums[ends[:-1]])
            mean, high = sent.value.grade(np.concatenate([*found, np.zeros(0)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean), pa.array(high)], [*columns, expected, tail])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(expected, DoubleType()), StructField(tail, DoubleType())]))


#: The rating of a label: one point for quality, one for text that isn't toxic.
GRADE, TOP, LEAST_TAIL = "coalesce(quality, 0) + 1 - coalesce(toxic, 0)", 2, 0.5


def _selected(tail: str, least_tail: float):
    return F.coalesce(F.col(tail) >= least_tail, F.lit(True))


def select(docs: DataFrame, labels: DataFrame, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The documents of ``docs`` whose probability of the highest grade is at least ``least_tail``; columns stay.
    Without a labelled document nothing tells good from bad, and all documents stay."""
    model = train(docs, labels, GRADE, TOP)
    mean, tail = fresh(docs, "expected"), fresh(docs, "tail")
    return score(docs, model, mean, tail).where(_selected(tail, least_tail)).drop(mean, tail)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_probability and selected, for every row of ``documents``. Without labels the two
    numbers are null and all documents are selected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), GRADE, TOP)
    return score(docs, model).drop("text").withColumn("selected", _selected("tail_probability", LEAST_TAIL))
