"""Line dedup by an exact set-similarity join of lines.

A line is the set of its distinct words (white space apart, A-Z folded). A line of at least ``min_words`` distinct words
is removed if any earlier line, in the order of (doc_id, line number), has a word set of Jaccard ``percent`` or more.

1. One pass counts words in a table of fixed size and gives lines of equal words one signature; only the first line of
   a signature takes part in the join, the others are removed.
2. Tokens of a line are ordered by rarity, and the line is posted under its prefix, the ``n - ceil(percent * n / 100) +
   1`` rarest. Two lines that match share a prefix token.
3. Postings are packed by shards of tokens, so that a row of the shuffle holds thousands of them. In its shard a line
   meets the earlier lines of a token, the earliest first, until it has ``first_tries`` candidates that pass the length
   filter, the positional filter and a 128-bit bitmap bound, which never rejects a match. So a line with thousands of
   near copies gives a few pairs, not thousands. A token that the count table calls frequent is split: its lines are
   dealt to segments, and each pair of segments is a list of its own.
4. Candidates are verified on full token sets. Lines that found none but had more candidates try all of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import textkit as tk
from tallyforge.llm.shared import CHUNK, Scratch, bloom, bloom_hashes, fresh, in_bloom, mix_keys

U64 = np.uint64


def _ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first byte, end, text, line number) of every line, in order; each text has one line more than newlines."""
    ends = np.flatnonzero(data == 10)
    begin, end = np.concatenate((offsets[:-1], ends + 1)), np.concatenate((ends, offsets[1:]))
    begin.sort()
    end.sort()
    n = np.diff(np.searchsorted(ends, offsets)) + 1
    text = np.repeat(np.arange(len(n)), n)
    return begin, end, text, np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)


def _lines(w: tk.Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, line number) of each line that has words."""
    begin, _, text, number = _ranges(w.data, offsets)
    at = np.searchsorted(w.start, begin)
    some = np.flatnonzero(np.diff(np.append(at, len(w.start))))
    return at[some], text[some], number[some]


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def _distinct_counts(h: np.ndarray, at: np.ndarray, min_words: int) -> np.ndarray:
    """Which lines have at least ``min_words`` distinct words. Lines of many words are sure to unless they repeat a few;
    only the others, and those whose words' hashes mod 64 are few, are counted in full."""
    seen = np.bitwise_count(np.bitwise_or.reduceat(U64(1) << (h & U64(63)), at))
    enough = seen >= min_words
    n = np.diff(np.append(at, len(h)))
    for k in np.flatnonzero(~enough & (n >= min_words)).tolist():
        enough[k] = len(np.unique(h[at[k] : at[k] + n[k]])) >= min_words
    return enough


def _first_pass(docs: DataFrame, buckets: int, min_words: int) -> DataFrame:
    """Rows of two kinds: chunks of word counts; and doc_id, line, signature of each line of enough distinct words."""

    def run(it):
        table = np.zeros(buckets, np.uint32)
        for batch in it:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tk.batches(batch, "text"):
                w = tk.words(data, offsets)
                if not len(w.hash):
                    continue
                np.add.at(table, (w.hash & U64(buckets - 1)).astype(np.int64), np.uint32(1))
                at, text, number = _lines(w, offsets)
                sig = np.add.reduceat(w.hash, at) ^ tk.mix(np.bitwise_xor.reduceat(w.hash * U64(0xD6E8FEB86659FD93), at))
                enough = _distinct_counts(w.hash, at, min_words)
                sig, text, number = sig[enough], text[enough], number[enough]
                k = len(sig)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(ids[i:j][text]), pa.array(number, pa.int32()), pa.array(sig.view(np.int64))],
                    ["chunk", "counts", "doc_id", "line", "sig"],
                )
        parts = table.reshape(-1, CHUNK)
        if table.any():
            k = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(k), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())],
                ["chunk", "counts", "doc_id", "line", "sig"],
            )

    return docs.mapInArrow(run, "chunk int, counts binary, doc_id long, line int, sig long")


def _table(chunks: DataFrame, buckets: int) -> np.ndarray:
    """The summed count table; the driver gets ``buckets / CHUNK`` chunks."""

    def add(it):
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(np.minimum(s, np.iinfo(np.uint32).max).astype(np.uint32).tobytes(), 1) for s in sums.values()])], ["chunk", "counts"])

    out = np.zeros((buckets // CHUNK, CHUNK), np.uint32)
    for row in chunks.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[row.chunk] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return out.reshape(-1)


def _token_order(key: np.ndarray, rare: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by (line, rarity, hash). One 64-bit key does it unless two tokens of a line agree in 24 hash bits."""
    rare = np.minimum(rare, (1 << 23) - 1).astype(U64)
    if len(key) and key[-1] < 1 << 16:
        packed = (key.astype(U64) << U64(47)) | (rare << U64(24)) | (h >> U64(40))
        order = np.argsort(packed)
        s, t = packed[order], h[order]
        if not ((s[1:] == s[:-1]) & (t[1:] != t[:-1])).any():
            return order
    return np.lexsort((h, rare, key))


def _token_sets(h: np.ndarray, first: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens by line, rarest first, of lines whose words begin at ``first``: (hash, line start positions,
    sizes)."""
    if not len(h):
        return h, first, first
    key = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    h = h[_token_order(key, table[(h & U64(len(table) - 1)).astype(np.int64)], h)]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[first] = True
    n = np.add.reduceat(new, first, dtype=np.int64)
    return h[new], np.cumsum(n) - n, n


def _some_lines(h: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and where lines begin in them, of the lines ``keep``."""
    n = np.diff(np.append(at, len(h)))
    if not keep.all():
        h, n = h[np.repeat(keep, n)], n[keep]
    return h, np.cumsum(n) - n


_FIELDS = (("token", np.uint64), ("doc_id", np.int64), ("line", np.int32), ("n", np.int32), ("pos", np.int32), ("x1", np.uint64), ("x2", np.uint64))


def _segments(posted: dict[str, np.ndarray], table: np.ndarray, hot: int) -> dict[str, np.ndarray]:
    """Postings of tokens that occur over ``hot`` times once for each pair of segments that their line is in."""
    count = table[(posted["token"] & U64(len(table) - 1)).astype(np.int64)]
    if not (count > hot).any():
        return posted
    parts = -(-count.astype(np.int64) // hot)
    split = np.flatnonzero(parts > 1)
    k = parts[split]
    mine = (mix_keys(posted["doc_id"][split], posted["line"][split]) % k.astype(U64)).astype(np.int64)
    row = np.repeat(np.arange(len(split)), k)
    other = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(k)))[:-1], k)
    keep = other != mine[row]
    row, other = row[keep], other[keep]
    low, high = np.minimum(mine[row], other), np.maximum(mine[row], other)
    more = {c: posted[c][split[row]] for c, _ in _FIELDS}
    more["token"] = mix_keys(more["token"].view(np.int64), low, high)
    rest = parts <= 1
    return {c: np.concatenate((posted[c][rest], more[c])) for c, _ in _FIELDS}


def _postings(docs: DataFrame, counts, copies, spared, percent: int, min_words: int, shards: int, hot: int, only=None) -> DataFrame:
    """Packed postings of each line's prefix: shard, and the bytes of one array for each of ``_FIELDS``.

    Later copies of lines (the Bloom filter ``copies``) are left out, but for lines in ``spared``, which are those that
    ``copies`` names wrongly. ``only``: a Bloom filter of tokens to which postings are limited.
    """

    def run(it):
        table = counts.value
        for batch in it:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            found = []
            for i, j, data, offsets in tk.batches(batch, "text"):
                w = tk.words(data, offsets)
                if not len(w.hash):
                    continue

                at, text, number = _lines(w, offsets)
                keys = mix_keys(ids[i:j][text], number)
                keep = ~in_bloom(copies.value, keys) | in_bloom(spared.value, keys)
                if only is not None:
                    keep &= np.logical_or.reduceat(in_bloom(only.value, w.hash), at)
                doc, number = ids[i:j][text[keep]], number[keep]
                h, at, n = _token_sets(*_some_lines(w.hash, at, keep), table)
                if not len(h):
                    continue
                bit = U64(1) << (h & U64(63))
                x2 = np.bitwise_xor.reduceat(bit, at)
                bit *= (h >> U64(6)) & U64(1)
                x1 = np.bitwise_xor.reduceat(bit, at)
                x2 ^= x1
                size = np.where(n >= min_words, n - -(-percent * n // 100) + 1, 0)
                of = np.repeat(np.arange(len(at)), size)
                pos = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                token = h[at[of] + pos]
                #: A token that occurs once in all texts, by the count table, meets no other line.
                take = table[(token & U64(len(table) - 1)).astype(np.int64)] > 1
                if only is not None:
                    take &= in_bloom(only.value, token)
                of = of[take]
                found.append({"token": token[take], "doc_id": doc[of], "line": number[of], "n": n[of], "pos": pos[take], "x1": x1[of], "x2": x2[of]})
            if not found:
                continue
            posted = {c: np.concatenate([f[c] for f in found]).astype(t, copy=False) for c, t in _FIELDS}
            posted = _segments(posted, table, hot)
            shard = (tk.mix(posted["token"]) % U64(shards)).astype(np.int64)
            order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")  # 16 bits: radix sort
            shard = shard[order]
            at = _starts(shard)
            ends = np.append(at, len(order)).tolist()
            columns = [pa.array(shard[at])]
            for c, _ in _FIELDS:
                values = posted[c][order]
                columns.append(pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["shard", *(c for c, _ in _FIELDS)])

    return docs.mapInArrow(run, "shard long, " + ", ".join(f"{c} binary" for c, _ in _FIELDS))


def _passes(u: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of postings (i, j) may reach the threshold: each filter sees what the one before let pass."""
    n, m = u["n"][i].astype(np.int64), u["n"][j].astype(np.int64)
    at = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    x, y, n, m = i[at], j[at], n[at], m[at]
    least = -(-percent * (n + m) // (100 + percent))
    ok = np.minimum(n - u["pos"][x], m - u["pos"][y]) >= least
    ok &= (u["doc_id"][x] != u["doc_id"][y]) | (u["line"][x] != u["line"][y])  # a repeated row isn't earlier than itself
    at, x, y, both, least = at[ok], x[ok], y[ok], (n + m)[ok], least[ok]
    apart = np.bitwise_count(u["x1"][x] ^ u["x1"][y]).astype(np.int64) + np.bitwise_count(u["x2"][x] ^ u["x2"][y])
    out = np.zeros(len(i), bool)
    out[at[(both - apart) // 2 >= least]] = True
    return out


def _by_token(token: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The order by (token, doc_id, line) of the postings whose token others have too."""
    t = np.argsort(token)
    s = token[t]
    first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    several = np.bincount(group)[group] > 1
    t, group = t[several], group[several]
    if len(token) >= 1 << 31 or len(t) and (line[t].max() >= 1 << 20 or np.abs(doc[t]).max() >= 1 << 42):
        return t[np.lexsort((line[t], doc[t], group))]
    place = np.argsort((doc[t] << 20) | line[t])  # one 64-bit key sorts much faster than three
    rank = np.empty(len(t), np.int64)
    rank[place] = np.arange(len(t))
    return t[np.argsort((group << 31) | rank)]


def _candidates(percent: int, tries: int, asked=None):
    """For a shard: each line's first ``tries`` possible matches by token among earlier lines, and whether there were
    more. ``asked``: a Bloom filter of the lines that ask."""

    def run(key, table):
        u = {c: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in _FIELDS}
        order = _by_token(u["token"], u["doc_id"], u["line"])
        u = {c: v[order] for c, v in u.items()}
        first = _starts(u["token"])
        count = np.diff(np.append(first, len(order)))
        several = np.repeat(count > 1, count)
        first = np.repeat(first, count)
        got = np.zeros(len(order), np.int64)
        active = np.flatnonzero(several & (first < np.arange(len(order))))
        if asked is not None:
            active = active[in_bloom(asked.value, mix_keys(u["doc_id"][active], u["line"][active]))]
        found_i, found_j, step = [active[:0]], [active[:0]], 0
        while len(active):
            j = first[active] + step
            ok = _passes(u, active, j, percent)
            hit = active[ok]
            got[hit] += 1
            keep = got[hit] <= tries
            found_i.append(hit[keep])
            found_j.append(j[ok][keep])
            step += 1
            active = active[(j + 1 < active) & (got[active] <= tries)]
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        out = pa.table({"doc_id": u["doc_id"][i], "line": u["line"][i], "to_doc": u["doc_id"][j], "to_line": u["line"][j], "more": got[i] > tries})
        #: The same pair meets at each token that both prefixes have.
        return out.group_by(["doc_id", "line", "to_doc", "to_line"]).aggregate([("more", "max")]).rename_columns(["doc_id", "line", "to_doc", "to_line", "more"])

    return run


def _token_arrays(docs: DataFrame, table, wanted_docs, wanted_lines) -> DataFrame:
    """doc_id, line, tokens (rarest first) of the lines that may be in the Bloom filters."""

    def run(it):
        for batch in it:
            hit = in_bloom(wanted_docs.value, mix_keys(batch.column("doc_id").to_numpy(zero_copy_only=False)))
            batch = batch.filter(pa.array(hit))
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tk.batches(batch, "text"):
                begin, end, text, number = _ranges(data, offsets)
                wanted = np.flatnonzero(in_bloom(wanted_lines.value, mix_keys(ids[i:j][text], number)))
                begin, end, doc, number = begin[wanted], end[wanted], ids[i:j][text[wanted]], number[wanted]
                #: Only the wanted lines are cut into words, each as a text.
                data = np.concatenate([data[:0], *(data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))])
                w = tk.words(data, np.concatenate(([0], np.cumsum(end - begin))))
                some = np.diff(w.first) > 0
                h, at, _ = _token_sets(w.hash, w.first[:-1][some], table.value)
                if len(h):
                    tokens = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(number[some], pa.int32()), tokens], ["doc_id", "line", "tokens"])

    return docs.mapInArrow(run, "doc_id long, line int, tokens array<long>")


def _wrongly_named(lines: DataFrame, copies, later: DataFrame) -> DataFrame:
    """Lines that the Bloom filter ``copies`` names though they aren't in ``later``."""

    def run(it):
        for batch in it:
            keys = mix_keys(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "line")))
            batch = batch.filter(pa.array(in_bloom(copies.value, keys)))
            if batch.num_rows:
                yield batch

    return lines.select("doc_id", "line").mapInArrow(run, "doc_id long, line int").join(later, ["doc_id", "line"], "left_anti")


def matched_lines(docs: DataFrame, percent: int = 80, min_words: int = 5, first_tries: int = 3, buckets: int = 1 << 20, hot: int = 1 << 18, shard_postings: int = 200_000) -> DataFrame:
    """(doc_id, line) of every line that has an earlier match; null doc_ids aren't allowed. See the module."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    send = scratch.send
    docs = docs.select("doc_id", "text")
    first = scratch.keep(_first_pass(docs, buckets, min_words), "first")
    table = _table(first.where("chunk is not null").select("chunk", "counts"), buckets)
    counts = send(table)
    #: About so many postings a shard: prefixes are (100 - percent) percent of all words and one a line.
    shards = max(16, int(table.sum(dtype=np.int64)) * (110 - percent) // 100 // shard_postings)
    lines = first.where("chunk is null").select("sig", "doc_id", "line")
    #: The first of each signature comes from partial minima; copies are the rest, by their own keys, so that a line
    #: with any number of copies is never one task's work.
    firsts = lines.groupBy("sig").agg(F.min(F.struct("doc_id", "line")).alias("m")).select("m.doc_id", "m.line")
    later = scratch.keep(lines.select("doc_id", "line").join(firsts, ["doc_id", "line"], "left_anti"), "later")
    copies = send(bloom(later, ["doc_id", "line"]))
    spared = send(bloom(_wrongly_named(lines, copies, later), ["doc_id", "line"], 1 << 22))
    schema = "doc_id long, line int, to_doc long, to_line int, more boolean"

    def candidates(name: str, tries: int, only=None, asked=None) -> DataFrame:
        posted = _postings(docs, counts, copies, spared, percent, min_words, shards, hot, only)
        return scratch.keep(posted.groupBy("shard").applyInArrow(_candidates(percent, tries, asked), schema), name)

    def verified(pairs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        links = pairs.select("doc_id", "line", "to_doc", "to_line").distinct()
        ends = pairs.select("doc_id", "line").union(pairs.select("to_doc", "to_line"))
        arrays = scratch.keep(_token_arrays(docs, counts, send(bloom(ends, ["doc_id"])), send(bloom(ends, ["doc_id", "line"]))), f"arrays-{k}")
        other = arrays.toDF("to_doc", "to_line", "other")
        both = links.join(arrays, ["doc_id", "line"]).join(other, ["to_doc", "to_line"])
        same = both.withColumn("o", F.size(F.array_intersect("tokens", "other"))).where(f"100 * o >= {percent} * (size(tokens) + size(other) - o)")
        return scratch.keep(same.select("doc_id", "line").distinct(), f"same-{k}"), arrays

    pairs = candidates("pairs-1", first_tries)
    same, arrays = verified(pairs, 1)
    left = scratch.keep(pairs.where("more").select("doc_id", "line").distinct().join(same, ["doc_id", "line"], "left_anti"), "left")
    if left.take(1):
        prefix = arrays.join(left, ["doc_id", "line"], "left_semi").select(F.explode(F.expr(f"slice(tokens, 1, cast(size(tokens) - ceil({percent} * size(tokens) / 100) + 1 as int))")).alias("token"))
        rest = candidates("pairs-2", 1 << 60, send(bloom_hashes(prefix, "token")), send(bloom(left, ["doc_id", "line"])))
        same = same.union(verified(rest, 2)[0])
    out = scratch.keep(later.union(same).distinct(), "gone")
    scratch.drop("first", "later", "pairs-1", "pairs-2", "arrays-1", "arrays-2", "same-1", "same-2", "left")
    scratch.release()
    return out


def _cut(docs: DataFrame, percent: int, min_words: int) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns: the numbers of the lines to remove (null: none) and the text without them."""
    gone, cut = fresh(docs, "gone"), fresh(docs, "cut")
    known = docs.where("doc_id is not null")
    lists = matched_lines(known, percent, min_words).groupBy("doc_id").agg(F.collect_set("line").alias(gone))
    left = f"array_join(filter(transform(split(text, '\\n', -1), (x, i) -> if(array_contains({gone}, i), null, x)), x -> x is not null), '\n')"
    out = known.join(lists, "doc_id", "left").select(*docs.columns, gone)
    out = out.withColumn(cut, F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.expr(left)))
    rest = docs.where("doc_id is null").select(*docs.columns, F.lit(None).cast("array<int>").alias(gone), F.col("text").alias(cut))
    return out.union(rest), gone, cut


def dedup_lines(docs: DataFrame, percent: int = 80, min_words: int = 5) -> DataFrame:
    """``docs`` with matched lines cut from ``text``; other columns stay, n_chars (if there) is counted again.

    A null or empty text stays as it is; lines of fewer than ``min_words`` distinct words are never cut. A document that
    loses lines and has no words left is dropped. A row with a null doc_id stays whole and takes no part. Rows that
    repeat a doc_id all lose the lines that are found for it. Ties can't occur: lines are ordered by (doc_id, line).
    """
    out, gone, cut = _cut(docs, percent, min_words)
    out = out.where(f"{gone} is null or {cut} rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    n_chars = [F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(cut).cast(docs.schema["n_chars"].dataType)).alias("n_chars")] if "n_chars" in docs.columns else []
    swap = {"text": F.col(cut).alias("text")} | ({"n_chars": n_chars[0]} if n_chars else {})
    return out.select(*(swap.get(c, F.col(f"`{c}`")) for c in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed (long) and the text that is left, over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, gone, cut = _cut(docs, 80, 5)
    n_lines = F.expr("cast(size(split(coalesce(text, ''), '\\n', -1)) as long)")
    return out.select("doc_id", n_lines.alias("n_lines"), F.expr(f"if({gone} is null, 0L, cast(size({gone}) as long))").alias("n_removed"), F.col(cut).alias("text"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
w AS (SELECT doc_id, line, list_distinct(list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS s FROM l),
b AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, line, s, len(s) AS n FROM w WHERE len(s) >= 5),
t AS (SELECT id, n, unnest(s) AS tok FROM b),
f AS (SELECT tok, count(*) AS c FROM t GROUP BY tok),
r AS (SELECT id, n, t.tok, row_number() OVER (PARTITION BY id ORDER BY c, t.tok) AS k FROM t JOIN f ON f.tok = t.tok),
p AS (SELECT id, n, tok FROM r WHERE k <= n - ceil(80 * n / 100.0) + 1),
c AS (SELECT DISTINCT u.id AS u, v.id AS v FROM p u JOIN p v ON u.tok = v.tok AND v.id < u.id WHERE 100 * least(u.n, v.n) >= 80 * greatest(u.n, v.n)),
g AS (SELECT DISTINCT x.doc_id, x.line FROM c JOIN b x ON x.id = c.u JOIN b y ON y.id = c.v
      WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed, string_agg(l.x, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL) AS t
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
SELECT k.doc_id, k.n_lines, k.n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.t, '') END AS text FROM k JOIN documents d ON d.doc_id = k.doc_id
"""
