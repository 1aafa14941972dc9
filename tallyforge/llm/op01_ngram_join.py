"""N-gram Jaccard self-join by a token-group matrix.

A document is the set of its distinct word shingles. Documents of equal sets form a class, and classes link when
``100 * intersection >= percent * union``. The join is exact and runs on classes:

1. A fixed-size table of shingle frequencies orders shingles by rarity. The *prefix* of a set of n shingles is its
   ``n - ceil(percent * n / 100) + k`` rarest; two linked sets share k prefix shingles (for the smaller k of the two).
   k is half of what the prefix would be for k = 1, so chance meetings don't count. Sets with fewer shared prefix
   shingles are done.
2. Similar classes, those whose prefixes have the same most often shared shingle, are partitioned into groups of about ``group_size`` or
   ``group_tokens`` shingles at most.
   Each group is linked within itself, and with the smallest class of its shingle.
3. The token-group matrix has a row for each prefix shingle and group. Groups are ranked by the size of their component,
   and a class is a query against the groups that rank above its own, share a row, allow its size, and aren't in its
   component already. So the members of the largest component of a shingle ask nothing by it, and leave the matrix's
   join before it. A group's token union bounds the overlap with the query; only a group that can reach the threshold
   is opened and compared member by member. A first round tries each query on one group of each component; the second
   covers all that are still apart.

No pair inside a component is needed twice, so thousands of near copies cost about as many comparisons, not their
square. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import textkit as tk
from tallyforge.llm.shared import Scratch, bloom, bucket_counts, components, in_bloom, mix_keys


def needed_overlap(n, percent: int):
    """The least overlap of a set of n shingles with any set that it links with."""
    return -(-percent * n // 100)


def shared_shingles(n, percent: int):
    """k: a set of n shingles shares at least k prefix shingles with any set of no fewer shingles that it links with."""
    return max(1, (n - needed_overlap(n, percent) + 1) // 2)


def _sets(batch: pa.RecordBatch, n: int):
    for i, j, data, offsets in tk.batches(batch, "text"):
        yield i, j, list(tk.shingle_sets(tk.words(data, offsets), n))


def _records(docs: DataFrame, n: int, percent: int, counts) -> DataFrame:
    """doc_id, n_shingles, set signature, prefix (rarest first) of every document."""

    def run(it):
        table = counts.value
        bucket = np.uint64(len(table) - 1)
        for batch in it:
            for i, j, sets in _sets(batch, n):
                prefixes, signatures = [], []
                for s in sets:
                    k = len(s) - needed_overlap(len(s), percent) + shared_shingles(len(s), percent) if len(s) else 0
                    if k < len(s):
                        rare = table[(s & bucket).astype(np.int64)]
                        cut = np.partition(rare, k - 1)[k - 1]
                        near = np.flatnonzero(rare <= cut)
                        s_k = s[near[np.lexsort((s[near], rare[near]))[:k]]]
                    else:
                        s_k = s[np.lexsort((s, table[(s & bucket).astype(np.int64)]))]
                    prefixes.append(s_k)
                    signatures.append(_signature(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(signatures, pa.binary()), tk.list_column(prefixes)],
                    ["doc_id", "n", "sig", "prefix"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, prefix array<long>")


def _full_sets(docs: DataFrame, n: int, wanted) -> DataFrame:
    """doc_id, sig, tokens of the documents whose ids may be in the Bloom filter ``wanted``."""

    def run(it):
        for batch in it:
            hit = in_bloom(wanted.value, mix_keys(batch.column("doc_id").to_numpy(zero_copy_only=False)))
            batch = batch.filter(pa.array(hit))
            if batch.num_rows:
                for i, j, sets in _sets(batch, n):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([_signature(s) for s in sets], pa.binary()), tk.list_column(sets)], ["doc_id", "sig", "tokens"])

    return docs.mapInArrow(run, "doc_id long, sig binary, tokens array<long>")


def _signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles of every document."""

    def run(it):
        for batch in it:
            for i, j, sets in _sets(batch, n):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "n_shingles"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long")


def _possibly(scratch: Scratch, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose node is in ``nodes``, and a few others: less for the join that follows to shuffle."""
    wanted = scratch.send(bloom(nodes, ["node"]))

    def run(it):
        for batch in it:
            batch = batch.filter(pa.array(in_bloom(wanted.value, mix_keys(batch.column("node").to_numpy(zero_copy_only=False)))))
            if batch.num_rows:
                yield batch

    return sets.mapInArrow(run, sets.schema)


def _meets(percent: int) -> str:
    """SQL: c shared prefix shingles are enough for a query of n shingles and some member of at least ``least``."""
    low = f"greatest(ceil({percent} * n / 100), least)"
    low = f"least(n, {low})"
    return f"c >= greatest(1, floor(({low} - ceil({percent} * {low} / 100) + 1) / 2))"


class _Group:
    """Members of a group as lists of members by token: overlaps of a query are counts over its tokens' lists."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray):
        self.sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        self.starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        self.union, self.ends = tokens[self.starts], np.append(self.starts[1:], len(tokens))

    def rows_of(self, query: np.ndarray) -> np.ndarray:
        if not len(self.union):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        return at[self.union[at] == query]

    def overlaps(self, rows: np.ndarray) -> np.ndarray:
        lo, n = self.starts[rows], self.ends[rows] - self.starts[rows]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def _link_group(percent: int):
    """Links inside one group: (node, smallest node of its part); the parts are exact within the group."""

    def run(key, table):
        node, at = np.unique(table.column("node").to_numpy(), return_index=True)
        tokens, offsets = tk.list_values(tk.whole(table.column("tokens")).take(pa.array(at)))
        group, parent = _Group(tokens, offsets), np.arange(len(node))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        parts = len(node)
        for i in range(len(node)):
            if parts == 1:
                break
            overlap = group.overlaps(group.rows_of(tokens[offsets[i] : offsets[i + 1]]))
            for k in np.flatnonzero(100 * overlap >= percent * (group.sizes[i] + group.sizes - overlap)).tolist():
                a, b = root(i), root(k)
                if a != b:
                    parent[max(a, b)] = min(a, b)  # nodes are in order: a part's root is its smallest
                    parts -= 1
        found = node[[root(i) for i in range(len(node))]]
        return pa.table({"a": pa.array(node), "b": pa.array(found)})

    return run


def _open_groups(percent: int):
    """Queries against one group: the token union bounds the overlap, then members are compared."""

    def run(key, queries, members):
        a, b = [], []
        if queries.num_rows and members.num_rows:
            tokens, offsets = tk.list_values(tk.whole(members.column("tokens")))
            group, node, part = _Group(tokens, offsets), members.column("node").to_numpy(), members.column("component").to_numpy()
            least = int(group.sizes.min())
            every, at = tk.list_values(tk.whole(queries.column("tokens")))
            for i, q in enumerate(queries.column("node").to_pylist()):
                query = every[at[i] : at[i + 1]]
                rows = group.rows_of(query)
                if len(rows) < needed_overlap(max(len(query), least), percent):
                    continue
                overlap = group.overlaps(rows)
                hits = np.flatnonzero(100 * overlap >= percent * (len(query) + group.sizes - overlap))
                _, one = np.unique(part[hits], return_index=True)
                a += [q] * len(one)
                b += node[hits[one]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def ngram_jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, group_size: int = 1024, group_tokens: int = 1_000_000, queries_per_task: int = 512, buckets: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id long, text string).

    Words are maximal runs of bytes other than ASCII white space, A-Z folded. A null, empty or blank text has the empty
    set, links with nothing and is its own component; a text of fewer than n words is one shingle. A null doc_id links
    as any other row but never names a component that has another id. Rows that repeat a doc_id each keep their row;
    they share the component if their texts link. Other columns are ignored. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    nulls = docs.where("doc_id is null").select("doc_id", "text")
    docs = docs.where("doc_id is not null").select("doc_id", "text")

    def hashes(batch):
        for _, _, sets in _sets(batch, n):
            yield np.concatenate(sets)

    counts = scratch.send(bucket_counts(docs, hashes, buckets))
    records = scratch.keep(_records(docs, n, percent, counts), "records")
    classes = records.where("n > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("m"))
    classes = scratch.keep(classes.select("sig", F.col("m.doc_id").alias("doc_id"), F.col("m.doc_id").alias("node"), F.col("m.n").alias("n"), F.col("m.prefix").alias("prefix")), "classes")
    #: A class is a node by its smallest doc_id; where several classes have the same, all but one get a hash.
    twice = classes.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("sig").alias("first")).where("c > 1")
    several_texts = bool(twice.take(1))
    if several_texts:
        classes = classes.join(twice.select("doc_id", "first"), "doc_id", "left").withColumn("node", F.when(F.col("first") != F.col("sig"), F.xxhash64("doc_id", "sig")).otherwise(F.col("doc_id"))).drop("first")

    #: Counts are summed before they are dealt by token; the join's raw postings of a hot token can be split.
    common = classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("met")).where("met > 1")
    postings = classes.select("doc_id", "node", "n", "sig", F.explode("prefix").alias("token"))
    low = f"ceil({percent} * n / 100)"
    shared = postings.join(common, "token").groupBy("node").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("c"), F.max(F.struct("met", "token")).alias("m"), F.collect_list("token").alias("shared")
    )
    shared = scratch.keep(shared.where(f"c >= greatest(1, floor(({low} - ceil({percent} * {low} / 100) + 1) / 2))").select("doc_id", "node", "n", "sig", F.col("m.token").alias("key"), "shared"), "shared")

    keys = shared.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("pivot"), F.expr(f"greatest(ceil(count(*) / {group_size}), ceil(sum(n) / {group_tokens}))").alias("chunks"))
    groups = shared.join(keys, "key").withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)")).withColumn("group", F.xxhash64("key", "chunk"))
    groups = scratch.keep(groups.select("group", "doc_id", "node", "n", "sig", "pivot", "c", "chunks", "shared"), "groups")
    sets = _full_sets(docs, n, scratch.send(bloom(groups, ["doc_id"])))
    sets = scratch.keep(sets.join(groups.select("doc_id", "node", "sig", "group", "pivot", "c"), ["doc_id", "sig"]).drop("doc_id", "sig"), "sets")

    several = sets.where("c > 1")
    #: Each group of a key meets the key's smallest class; a key of one group holds it already.
    far = groups.where("chunks > 1").select("group", F.col("pivot").alias("p")).distinct()
    moved = several.where("node = pivot").select(F.col("pivot").alias("p"), "tokens").join(far, "p").select("group", F.col("p").alias("node"), "tokens")
    local = several.select("group", "node", "tokens").union(moved).groupBy("group").applyInArrow(_link_group(percent), "a long, b long")
    edges = scratch.keep(local.where("a <> b"), "edges-0")
    sets = sets.select("node", "tokens")
    parts = components(scratch, edges, "parts-1")
    for k in (1, 2):
        placed = groups.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).select("group", "node", "n", "component", "shared")
        placed = scratch.keep(placed, f"placed-{k}")
        size = placed.groupBy("component").agg(F.count("*").alias("size"))
        whole = placed.groupBy("group").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high"))
        whole = whole.join(size.withColumnRenamed("component", "low"), "low").withColumn("rank", F.expr("struct(if(low = high, size, 0L) as size, low)")).drop("size")
        known = placed.join(whole, "group")
        matrix = known.select(F.explode("shared").alias("token"), F.col("group").alias("g"), "least", "most", "low", "high", F.col("rank").alias("above")).distinct()
        top = matrix.groupBy("token").agg(F.max("above").alias("top"))
        rows = known.select("group", "node", "n", "component", "rank", F.expr("low = high").alias("pure"), F.explode("shared").alias("token"))
        rows = rows.join(top, "token").where("not (pure and rank >= top)").drop("top", "pure")
        fits = f"100 * n >= {percent} * least and 100 * most >= {percent} * n"
        found = rows.join(matrix, "token").where(f"(rank < above or rank = above and group < g) and {fits} and not (low = high and component = low)")
        found = found.groupBy("node", "n", "g", "low", "high", "least").agg(F.count("*").alias("c")).where(_meets(percent))
        if k == 1:
            alone = found.where("low = high").groupBy("node", "low").agg(F.min(F.struct("g", "n")).alias("m")).select("node", "m.n", "m.g")
            found = alone.union(found.where("low <> high").select("node", "n", "g"))
        found = scratch.keep(found.select("node", "n", "g"), f"found-{k}")
        if not found.take(1):
            break
        load = found.groupBy("g").agg(F.expr(f"greatest(ceil(count(*) / {queries_per_task}), ceil(sum(n) / {group_tokens}))").alias("tasks"))
        members = placed.withColumnRenamed("group", "g").join(load, "g").withColumn("task", F.explode(F.expr("sequence(0L, tasks - 1)"))).select("g", "task", "node", "component")
        asked = found.join(load, "g").withColumn("task", F.expr("pmod(xxhash64(node, 7), tasks)")).select("g", "task", "node")
        some = _possibly(scratch, sets, asked.select("node").union(members.select("node")))
        asked = asked.join(some, "node")
        opened = members.join(some, "node").toDF("node", "g", "task", "component", "tokens")
        links = scratch.keep(asked.groupBy("g", "task").cogroup(opened.groupBy("g", "task")).applyInArrow(_open_groups(percent), "a long, b long"), f"links-{k}")
        if links.take(1):
            edges = edges.union(links)
            parts = components(scratch, edges, f"parts-{k + 1}")
    named = classes.select("sig", "doc_id", "node").join(parts, "node", "left").select("sig", "doc_id", F.coalesce("component", "node").alias("component"))
    if several_texts:
        lowest = named.groupBy("component").agg(F.min("doc_id").alias("least"))
        named = named.join(lowest, "component").select("sig", F.col("least").alias("component"))
    named = named.select("sig", "component")
    out = records.join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    scratch.drop("shared", "sets", "groups", "edges-0", *(f"{x}-{k}" for x in ("placed", "found", "links") for k in (1, 2)))
    scratch.release()
    return out.union(_set_sizes(nulls, n).withColumn("component_id", F.lit(None).cast("long")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each component; all columns stay. Rows with a null doc_id and
    documents without words stay."""
    parts = ngram_jaccard_components(docs, n, percent)
    gone = parts.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract: three-word shingles, 100 * intersection >= 90 * union, over all of ``documents``."""
    return ngram_jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
r AS (SELECT t FROM t GROUP BY t HAVING count(*) > 1),
u AS (SELECT t.doc_id, t.t FROM t JOIN r USING (t)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, d.b FROM reach JOIN d ON d.a = reach.y)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = n.doc_id
"""
