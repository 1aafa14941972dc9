"""Document fingerprints by order MinHash.

The k-mers of a text are its runs of k code points, each numbered by its occurrence so that a repeated k-mer counts as
often as it occurs. Each of ``tuples`` permutations selects the ``width`` least of them; these, in the order in which
they stand in the text, are hashed to one entry of the signature. Entries of two texts agree when the same k-mers were
selected in the same order, so the share of equal entries falls with edit distance and with moved passages alike.
"""

from __future__ import annotations

import copy
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.textkit import mix

U64, U32 = np.uint64, np.uint32
_BLOCK = 1 << 13


def _multipliers(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(977)).integers(0, 1 << 32, n, dtype=np.uint32) | U32(1)


def numbered_kmers(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of the k-mers of a text with their occurrence numbers, in text order. A text of fewer than k code
    points, but of some, is one k-mer."""
    if not len(points):
        return np.zeros(0, U32)
    k = min(k, len(points))
    h = points.astype(U64)[: len(points) - k + 1].copy()
    for j in range(1, k):
        h = h * U64(0x9E3779B97F4A7C15) + points[j : len(points) - k + 1 + j]
    h = mix(h + U64(k))
    s = np.sort(h)
    again = s[1:][s[1:] == s[:-1]]
    if len(again):
        again = again[np.concatenate(([True], again[1:] != again[:-1]))]
        at = np.searchsorted(again, h)
        at[at == len(again)] = 0
        place = np.flatnonzero(again[at] == h)
        order = place[np.argsort(h[place], kind="stable")]
        same = h[order]
        start = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
        number = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        order, number = order[number > 0], number[number > 0]  # a first occurrence keeps its hash, whatever follows
        h[order] = mix(h[order] + number.astype(U64) * U64(0xD6E8FEB86659FD93))
    return (h >> U64(32)).astype(U32)


def least_of(h: np.ndarray, multipliers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, positions) of the ``width`` least of each permutation of h, least first; ties: the earlier position.
    Where h has fewer, the rest is the greatest value at position -1. Long texts go block by block."""
    m = len(multipliers)
    value = np.full((m, width), 0xFFFFFFFF, U32)
    place = np.full((m, width), -1, np.int64)
    rows = np.arange(m)
    for a in range(0, len(h), _BLOCK):
        v = multipliers[:, None] * h[None, a : a + _BLOCK]
        got_v, got_p = np.full((m, width), 0xFFFFFFFF, U32), np.full((m, width), -1, np.int64)
        for j in range(min(width, v.shape[1])):
            at = v.argmin(1)
            got_v[:, j], got_p[:, j] = v[rows, at], at + a
            v[rows, at] = 0xFFFFFFFF
        value, place = merge(value, place, got_v, got_p, width)
    return value, place


def merge(value, place, other_value, other_place, width: int):
    """The ``width`` least of two selections of disjoint ranges, the first range the earlier."""
    v, p = np.concatenate((value, other_value), 1), np.concatenate((place, other_place), 1)
    order = np.argsort(np.where(p < 0, 1 << 40, v.astype(np.int64)), 1, kind="stable")[:, :width]
    return np.take_along_axis(v, order, 1), np.take_along_axis(p, order, 1)


def entries(h: np.ndarray, multipliers: np.ndarray, width: int) -> np.ndarray:
    """The signature: a 32-bit hash of each permutation's selected k-mers in text order."""
    return _entries(h, *least_of(h, multipliers, width))


def _entries(h: np.ndarray, value: np.ndarray, place: np.ndarray) -> np.ndarray:
    order = np.sort(place, 1)
    out = np.zeros(len(place), U64)
    for j in range(place.shape[1]):
        p = order[:, j]
        word = np.where(p >= 0, h[np.maximum(p, 0)].astype(U64), U64(1) << U64(40)) if len(h) else np.full(len(p), U64(1) << U64(40))
        out = mix(out * U64(0x9E3779B97F4A7C15) + word + U64(1))
    return (out >> U64(32)).astype(U32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(e: np.ndarray) -> str:
    return e.astype(">u4").tobytes().hex()


def _cuts(keyed: DataFrame, ranges: int, rows: int) -> list[tuple[int | None, int]]:
    """At most ``ranges - 1`` bounds of about equal ranges of (doc_id, h), from a sample by hash of about 64 rows a range."""
    if ranges < 2:
        return []
    few = keyed.where(F.expr(f"pmod(xxhash64(doc_id, h, 3), 1000000007) < {min(1.0, 64 * ranges / max(rows, 1)) * 1000000007}"))
    found = sorted(((r.doc_id is not None, r.doc_id or 0, r.h) for r in few.select("doc_id", "h").collect()))
    picked = {found[i * len(found) // ranges] for i in range(1, ranges)} if found else set()
    return [(i if there else None, h) for there, i, h in sorted(picked)]


def _placed(keyed: DataFrame, cuts: list[tuple[int | None, int]], fanout: int = 64) -> DataFrame:
    """``keyed`` with part: the number of bounds up to (doc_id, h), found in a tree of slices of the sorted bounds."""
    bound = lambda c: F.struct(F.lit(c[0]).cast("long").alias("doc_id"), F.lit(c[1]).cast("long").alias("h"))
    levels = [cuts]
    while len(levels[-1]) > fanout:
        levels.append(levels[-1][::fanout])
    out, own = keyed.withColumn("part", F.lit(0).cast("long")), F.struct("doc_id", "h")
    for k, level in enumerate(reversed(levels)):
        if not level:
            continue
        every = F.array(*map(bound, level))
        if k == 0:
            out = out.withColumn("part", F.size(F.filter(every, lambda c: c <= own)).cast("long"))
            continue
        some = F.slice(every, ((F.greatest("part", F.lit(1)) - 1) * fanout + 1).cast("int"), F.lit(fanout))
        below = F.size(F.filter(some, lambda c: c <= own))
        out = out.withColumn("part", F.when(F.col("part") == 0, F.lit(0).cast("long")).otherwise((F.col("part") - 1) * fanout + below))
    return out


def fingerprints(docs: DataFrame, k: int = 9, tuples: int = 64, width: int = 2, rows_per_range: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's, in ascending doc_id; after the last comes the first. A null text is empty; null doc_ids come first; rows
    of one doc_id follow each other in the order of a hash of their texts, then of the texts, so those of equal texts are
    neighbours. A sole document is its own next. Other columns are ignored, an empty table gives an empty result. An
    empty text's signature is a constant of its own.

    Texts are shuffled once, into ranges of (doc_id, hash of text), so that a doc_id of very many texts is dealt out too.
    There are as many ranges as ``spark.sql.shuffle.partitions``, or one for each ``rows_per_range`` rows; the driver
    gathers a sample of about 64 keys a range. The first row of a range is also sent, as its last row's next, to the
    range before. Tasks stream their sorted rows.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = docs.count()
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions")) if rows_per_range is None else max(1, -(-rows // rows_per_range))
    placed = _placed(keyed, _cuts(keyed, min(ranges, max(rows, 1)), rows))
    #: One row a range.
    firsts = sorted((r.part, r.m.doc_id, r.m.h) for r in placed.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("m")).collect())
    before = [(i, h, firsts[k - 1][0]) for k, (_, i, h) in enumerate(firsts)]
    table = F.broadcast(spark.createDataFrame(before, "i long, first long, before long"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))
    tail = F.struct(F.col("before").alias("part"), F.lit(1).alias("tail"))
    found = placed.join(table, (F.col("h") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    found = found.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, tail))))
    found = found.select("doc_id", "h", "text", "to.part", "to.tail").repartitionById(max(1, firsts[-1][0] + 1 if firsts else 1), F.col("part").cast("int"))
    return found.sortWithinPartitions("part", "tail", "doc_id", "h", "text").mapInArrow(
        _stream(k, tuples, width), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _stream(k: int, tuples: int, width: int):
    def run(it):
        multipliers = _multipliers(tuples)
        part, held, done = None, None, False
        for batch in it:
            out = []
            for doc_id, text, p, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "tail")), strict=True):
                if p != part:
                    part, held, done = p, None, False
                if done:
                    continue
                if held is not None and held.text == text:
                    held.sign(multipliers, width)
                    now = held.again(doc_id)
                else:
                    now = _Text(doc_id, text, k)
                if held is not None:
                    out.append(_row(held, now, k, multipliers, width))
                    done = tail == 1
                held = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


class _Text:
    """A text of the stream. What the permutations select from its first three quarters is kept apart: the edited text
    shares it, since numbers of occurrence count from the start of the text."""

    def __init__(self, doc_id, text: str, k: int):
        self.doc_id, self.text, self.k = doc_id, text, k
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.quarter = len(self.points) // 4
        self.same = max(0, len(self.points) - self.quarter - k + 1)
        self.signature = None

    def again(self, doc_id) -> _Text:
        """The same text of another row: its signature is shared."""
        other = copy.copy(self)
        other.doc_id = doc_id
        return other

    def sign(self, multipliers: np.ndarray, width: int) -> np.ndarray:
        if self.signature is None:
            h = numbered_kmers(self.points, self.k)
            self.start = least_of(h[: self.same], multipliers, width)
            self.signature = self.joined(h, multipliers, width)
        return self.signature

    def joined(self, h: np.ndarray, multipliers: np.ndarray, width: int) -> np.ndarray:
        value, place = least_of(h[self.same :], multipliers, width)
        return _entries(h, *merge(*self.start, value, np.where(place < 0, -1, place + self.same), width))


def _row(held: _Text, after: _Text, k: int, multipliers: np.ndarray, width: int) -> tuple:
    edited = np.concatenate((held.points[: len(held.points) - held.quarter], after.points[: held.quarter]))
    mine = held.sign(multipliers, width)
    if not held.quarter:
        other = mine
    elif len(edited) < k:
        other = entries(numbered_kmers(edited, k), multipliers, width)
    else:
        other = held.joined(numbered_kmers(edited, k), multipliers, width)
    text = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    following = after.sign(multipliers, width)
    return held.doc_id, len(held.points), hashlib.sha256(text).hexdigest(), _hex(mine), _hex(other), likeness(mine, other), likeness(mine, following)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's fingerprints of every row of ``documents``."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
