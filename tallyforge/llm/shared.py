"""What the operators share: written intermediate tables, fixed-size sketches and connected components.

Intermediate results are written to the shared folder that the cluster names in ``spark.checkpoint.dir``, so lineage is
cut and a lost executor costs only its running tasks. Sketches have a size fixed by a parameter, whatever the input, and
are all that the driver ever gathers or broadcasts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyforge.operators.graph import components
from tallyforge.storage import Scratch, shared_folder

__all__ = ["CHUNK", "Scratch", "bloom", "bloom_hashes", "bucket_counts", "components", "fresh", "in_bloom", "mix_keys", "shared_folder"]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in taken:
        name += "_"
    return name


CHUNK = 1 << 14


def bucket_counts(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], buckets: int = 1 << 20) -> np.ndarray:
    """How often each bucket of hashes occurs in all rows: a frequency table of fixed size (4 bytes a bucket).

    A task sends its table compressed and in chunks; the driver gets ``buckets / CHUNK`` summed chunks.
    """

    def count(it):
        table = np.zeros(buckets, np.uint32)
        for batch in it:
            for h in hashes(batch):
                np.add.at(table, (h & np.uint64(buckets - 1)).astype(np.int64), np.uint32(1))
        parts = table.reshape(-1, CHUNK)
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["chunk", "counts"])

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(counts), np.uint32)
                sums[chunk] = sums.get(chunk, 0) + got.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(np.minimum(s, np.iinfo(np.uint32).max).astype(np.uint32).tobytes(), 1) for s in sums.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    out = np.zeros((buckets // CHUNK, CHUNK), np.uint32)
    for row in df.mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect():
        out[row.chunk] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return out.reshape(-1)


def mix_keys(*columns: np.ndarray) -> np.ndarray:
    from tallyforge.llm.textkit import mix

    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.int64).view(np.uint64) + np.uint64(1))
    return h


def bloom_hashes(df: DataFrame, column: str, bits: int = 1 << 25) -> np.ndarray:
    """A Bloom filter of a column that holds 64-bit hashes already."""
    return bloom(df, [column], bits, lambda c: c.view(np.uint64))


def bloom(df: DataFrame, columns: list[str], bits: int = 1 << 25, keys: Callable[..., np.ndarray] = mix_keys) -> np.ndarray:
    """A Bloom filter (two probes, ``bits / 8`` bytes) of the keys in ``columns``, gathered in compressed chunks.

    It never misses a key. Beyond about ``bits / 10`` keys it lets more and more others pass, which costs time alone:
    an equi-join behind it decides.
    """
    size = bits // 8 // CHUNK

    def fill(it):
        table = np.zeros(bits // 8, np.uint8)
        for batch in it:
            for probe in probes(keys(*(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)), bits):
                np.bitwise_or.at(table, probe >> 3, (1 << (probe & 7)).astype(np.uint8))
        for chunk, part in enumerate(table.reshape(size, CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    def unite(it):
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) | np.frombuffer(zlib.decompress(part), np.uint8)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    out = np.zeros((size, CHUNK), np.uint8)
    for row in df.select(*columns).mapInArrow(fill, schema).repartition("chunk").mapInArrow(unite, schema).collect():
        out[row.chunk] = np.frombuffer(zlib.decompress(row.counts), np.uint8)
    return out.reshape(-1)


def probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys & np.uint64(bits - 1)).astype(np.int64), ((keys >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def in_bloom(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for probe in probes(keys, len(table) * 8):
        found &= (table[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1 == 1
    return found
