"""Which listings are the same product: nodes, candidate pairs, scores, groups, canonical rows."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyforge.functions.numbers import close, exact_sum, multipack, positive
from tallyforge import storage
from tallyforge.functions.text import clean, is_empty, labelled, norm
from tallyforge.functions.weights import family_title_column
from tallyforge.operators.graph import communities, components, positive_edges, with_singletons
from tallyforge.storage import Scratch

# Thresholds of categories, their other names, and the model's prefix.
THRESHOLDS = {"sauces": 0.917444, "coconut_oil": 0.872321, "soap": 0.930329}
THRESHOLD_NAMES = {
    "sauce": "sauces", "sauces": "sauces", "соус": "sauces", "соусы": "sauces", "coconut_oil": "coconut_oil", "coconut-oil": "coconut_oil", "coconut oil": "coconut_oil", "кокосовое масло": "coconut_oil", "soap": "soap", "мыло": "soap",
}
DEFAULT_THRESHOLD = 0.872321
TEXT_PREFIX = "query: "
TOP_K, RESOLUTION = 30, 0.1


def category_groups(registry: DataFrame, group: str) -> DataFrame:
    """Business groups of categories: their keys and marketplaces (sorted, comma-joined), rows and periods."""
    index = F.col("__year").cast("int") * 12 + F.col("__month").cast("int")
    one = registry.groupBy(group, "__category_key").agg(F.collect_set("__marketplace_code").alias("m"), F.sum("rows_count").alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return one.groupBy(group).agg(
        joined(F.collect_set("__category_key")).alias("keys"), joined(F.flatten(F.collect_list("m"))).alias("marketplaces"), F.sum("n").alias("rows"), F.min("lo").alias("first_index"), F.max("hi").alias("last_index")
    )


def short_id(prefix: str, *parts: Column) -> Column:
    """The prefix and sixteen hexadecimal digits of the parts' SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def pair_hash(a: Column, b: Column) -> Column:
    """SHA-256 of a compact JSON list of two texts."""
    quoted = lambda c: F.to_json(F.array(clean(c)))
    one = lambda c: F.substring(quoted(c), 2, F.length(quoted(c)) - 2)
    return F.sha2(F.concat(F.lit("["), one(a), F.lit(","), one(b), F.lit("]")), 256)


def nodes(source: DataFrame, order: str) -> DataFrame:
    """One node for each (project_name, category_key, marketplace_code, article) of rows with an article.

    Texts are the first that aren't empty and weights the first that aren't NULL, by the column ``order``; metrics are
    exact sums; hashes are a sorted JSON list.
    """
    keys = ["project_name", "category_key", "marketplace_code", "article"]
    rows = source.withColumn("article", clean(F.col("article"))).where("article <> ''").withColumn("marketplace_code", clean(F.col("marketplace_code")))
    first_text = lambda c: F.coalesce(F.min_by(F.when(~is_empty(F.col(c)), F.col(c)), F.when(~is_empty(F.col(c)), F.col(order))), F.lit("")).alias(c)
    first_number = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))
    out = rows.groupBy(*keys).agg(
        *(first_text(c) for c in ("category_name", "marketplace", "sku", "brand", "subcategory")),
        positive(first_number("unit_amount")).alias("unit_amount"),
        positive(first_number("total_amount")).alias("total_amount"),
        exact_sum(F.coalesce("sales_volume", F.lit(0.0))).alias("sales_volume"),
        exact_sum(F.coalesce("revenue", F.lit(0.0))).alias("revenue"),
        F.count(F.lit(1)).alias("row_count"),
        F.to_json(F.array_sort(F.collect_set(F.nullif(F.trim("row_hash"), F.lit(""))))).alias("source_row_hashes_json"),
    )
    out = out.withColumn("node_id", short_id("sku_", *(F.col(k) for k in keys))).withColumn("multipack_count", multipack(F.col("unit_amount"), F.col("total_amount")))
    return out.withColumns({"embedding_text": model_text(), "retrieval_text": retrieval_text()})


def _number_text(c: str) -> Column:
    return F.when(positive(F.col(c)).isNotNull(), F.col(c).cast("double").cast("string"))


def retrieval_text() -> Column:
    return labelled(**{"бренд": clean(F.col("brand")), "подкатегория": clean(F.col("subcategory")), "название": clean(F.col("sku"))})


def model_text() -> Column:
    return labelled(**{"бренд": clean(F.col("brand")), "подкатегория": clean(F.col("subcategory")), "название": clean(F.col("sku")), "вес единицы кг": _number_text("unit_amount"), "общий вес кг": _number_text("total_amount"), "штук в упаковке": _number_text("multipack_count")})


def hashing_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic vector of a text: signed hashes of its words and of their three-letter pieces, of unit length.
    It stands in where no model is given."""
    from pyspark.sql.functions import pandas_udf

    def run(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for x in texts:
            v = np.zeros(size, np.float32)
            for word in str(x or "").lower().split():
                for piece in {word, *(f" {word} "[i : i + 3] for i in range(len(word)))}:
                    h = zlib.crc32(piece.encode())
                    v[h % size] += 1.0 if h >> 16 & 1 else -1.0
            n = float(np.linalg.norm(v))
            out.append(v / n if n else v)
        return pd.Series(out)

    return pandas_udf(run, "array<float>")(F.concat(F.lit(TEXT_PREFIX), clean(text)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p.cast("double") * r.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / n))).otherwise(F.lit(0.0))


def blocks(df: DataFrame, block: Column) -> DataFrame:
    """``df`` with block and scope: blocks of more than one row, all others in one ``global`` block."""
    key = norm(block)
    counted = df.withColumn("_b", key)
    many = counted.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 and _b <> ''").select("_b", F.lit(True).alias("_own"))
    out = counted.join(many, "_b", "left")
    return out.withColumn("block", F.when(F.col("_own"), F.concat(F.lit("s:"), F.col("_b"))).otherwise(F.lit("g"))).withColumn("scope", F.when(F.col("_own"), F.lit("same_subcategory")).otherwise(F.lit("global"))).drop("_b", "_own")


def top_k(rows: DataFrame, k: int = TOP_K, queries: DataFrame | None = None, tile: int = 4096) -> DataFrame:
    """node, other, score, rank, scope: the k + 1 rows of the greatest inner product within each block, self among them
    but left out; ranks count from 0 with self, ties go to the smaller node.

    ``rows``: node, vector, block, scope. Blocks are cut into tiles of about ``tile`` rows; each tile of queries meets
    each tile of its block in a task of its own, which gives its best, and the best of these are ranked, so a block of
    any size takes bounded memory.
    """
    size = rows.groupBy("block").agg(F.expr(f"ceil(count(*) / {tile})").alias("tiles"))
    tiled = rows.join(size, "block").withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")))
    every = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    asked = tiled if queries is None else tiled.join(queries.select("node").distinct(), "node", "left_semi")
    left = asked.withColumn("u", F.explode(every)).select("block", "t", "u", "scope", "node", "vector")
    right = tiled.withColumn("v", F.explode(every)).select("block", F.col("v").alias("t"), F.col("t").alias("u"), "node", "vector").toDF("block", "t", "u", "node", "vector")
    kind = dict(rows.dtypes)["node"]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "scope", "node", "other", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})
        b = b.sort_values("node")
        x, y = np.stack(a["vector"].to_numpy()).astype(np.float64), np.stack(b["vector"].to_numpy()).astype(np.float64)
        score = x @ y.T
        take = min(k + 1, len(b))
        best = np.argsort(-score, 1, kind="stable")[:, :take]
        at = np.repeat(np.arange(len(a)), take)
        return pd.DataFrame({"block": a["block"].to_numpy()[at], "scope": a["scope"].to_numpy()[at], "node": a["node"].to_numpy()[at], "other": b["node"].to_numpy()[best.ravel()], "score": score[at, best.ravel()]})

    near = left.groupBy("block", "t", "u").cogroup(right.groupBy("block", "t", "u")).applyInPandas(meet, f"block string, scope string, node {kind}, other {kind}, score double")
    w = Window.partitionBy("node").orderBy(F.desc("score"), "other")
    ranked = near.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") <= k)
    return ranked.where("node <> other").select("node", "other", "score", "rank", "scope")


def candidate_pairs(near: DataFrame) -> DataFrame:
    """One row for each undirected pair: its best score, then smallest rank; rank at least 1, score of six places."""
    pairs = near.select(F.least("node", "other").alias("node_id_a"), F.greatest("node", "other").alias("node_id_b"), F.struct((-F.col("score")).alias("s"), F.greatest(F.lit(1), F.col("rank")).alias("r"), F.col("scope").alias("c")).alias("x"))
    best = pairs.groupBy("node_id_a", "node_id_b").agg(F.min("x").alias("x"))
    return best.select("node_id_a", "node_id_b", F.round(-F.col("x.s"), 6).alias("similarity"), F.col("x.r").alias("candidate_rank"), F.col("x.c").alias("scope"))


def same_pack(unit_a, unit_b, total_a, total_b, pack_a, pack_b) -> Column:
    """Same unit weight, and same total or same number of packs."""
    return close(unit_a, unit_b, 0.02, 0.05) & (close(total_a, total_b, 0.02, 0.05) | close(pack_a, pack_b, 0.25, 0.0))


def same_pack_two_of_three(unit_a, unit_b, total_a, total_b, pack_a, pack_b) -> Column:
    yes = lambda c: c.cast("int")
    return yes(close(unit_a, unit_b, 0.02, 0.05)) + yes(close(total_a, total_b, 0.02, 0.05)) + yes(close(pack_a, pack_b, 0.25, 0.0)) >= 2


def pack_signature(unit: Column, total: Column, pack: Column) -> Column:
    """``u=…|t=…|p=…`` with rounded numbers, ``na`` where there is none."""
    part = lambda c, n: F.coalesce(F.bround(positive(c), n).cast("string"), F.lit("na"))
    return F.concat(F.lit("u="), part(unit, 3), F.lit("|t="), part(total, 3), F.lit("|p="), part(pack, 2))


def threshold_of(key: Column, name: Column | None = None, thresholds: Mapping[str, float] = THRESHOLDS, default: float = DEFAULT_THRESHOLD) -> Column:
    """A category's threshold by its key, else by its name, else the default."""
    known = dict(thresholds) | {a: thresholds[b] for a, b in THRESHOLD_NAMES.items() if b in thresholds}
    # a dash and an underscore are the same in keys
    table = F.create_map(*(F.lit(x) for kv in {k.replace("-", "_"): v for k, v in known.items()}.items() for x in kv))
    look = lambda c: F.try_element_at(table, F.translate(norm(c), "-", "_"))
    return F.coalesce(look(key), *([look(name)] if name is not None else []), F.lit(default))


Scorer = Callable[[pd.Series, pd.Series], np.ndarray]


def scored(pairs: DataFrame, scorer: Scorer, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all pairs with score, newly scored pairs). ``pairs``: node_id_a, node_id_b, text_a, text_b. A cached score counts
    if the nodes and the hash of their texts agree; only misses reach the scorer."""
    hashed = pairs.withColumn("pair_hash", pair_hash(F.col("text_a"), F.col("text_b")))
    keys = ["node_id_a", "node_id_b", "pair_hash"]
    if cache is None:
        missed, known = hashed, None
    else:
        missed = hashed.join(cache.select(*keys), keys, "left_anti")
        known = hashed.join(cache.select(*keys, "score"), keys)

    def run(batches):
        for b in batches:
            b["score"] = np.asarray(scorer(b["text_a"], b["text_b"]), float)
            yield b

    new = missed.mapInPandas(run, StructType([*missed.schema.fields, StructField("score", DoubleType())]))
    return (new if known is None else known.unionByName(new)), new.select(*keys, "score")


def family_parts(scratch: Scratch, nodes_: DataFrame, edges: DataFrame, method: str = "leiden", gamma: float = RESOLUTION, previous: DataFrame | None = None, alone: DataFrame | None = None) -> DataFrame:
    """(node, component): the family of every node. ``edges``: a, b, weight of positive pairs; ``previous``: node,
    family; ``alone``: nodes that manual splits keep by themselves."""
    rows = positive_edges(edges, previous)
    if alone is not None:
        single = alone.select("node").distinct()
        rows = rows.join(single.withColumnRenamed("node", "a"), "a", "left_anti").join(single.withColumnRenamed("node", "b"), "b", "left_anti")
    parts = components(scratch, rows, "family") if method == "connected_components" else communities(scratch, rows, "family", gamma, method)
    return with_singletons(parts, nodes_.select(F.col("node_id").alias("node")))


def _stable_ids(members: DataFrame, prefix: str, keys: Sequence[str], previous: str, manual: str) -> DataFrame:
    """An id for each group of keys: the manual one of a sole member, else the most frequent previous (ties: the
    smallest), else the next free number in the order of the keys."""
    group = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(manual).alias("_manual"))
    votes = members.where(F.col(previous).isNotNull() & (F.col(previous) != "")).groupBy(*keys, previous).agg(F.count(F.lit(1)).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_v"), previous)
    vote = votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, F.col(previous).alias("_vote"))
    number = F.max(F.expr(f"try_cast(regexp_extract(coalesce({previous}, ''), '^{prefix}_([0-9]+)$', 1) as long)"))
    used = members.agg(F.greatest(F.coalesce(number, F.lit(0)), F.coalesce(F.max(F.expr(f"try_cast(regexp_extract(coalesce({manual}, ''), '^{prefix}_([0-9]+)$', 1) as long)")), F.lit(0))).alias("_used"))
    named = group.join(vote, list(keys), "left").withColumn("_id", F.coalesce(F.when((F.col("_n") == 1) & (F.col("_manual") != ""), F.col("_manual")), F.col("_vote")))
    fresh = numbered(named.where("_id is null").select(*keys), keys).crossJoin(used)
    fresh = fresh.select(*keys, F.format_string(f"{prefix}_%06d", F.col("_k") + F.col("_used")).alias("_new"))
    return named.join(fresh, list(keys), "left").select(*keys, F.coalesce("_id", "_new").alias(f"{prefix}_id"))


def numbered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` with ``_k``, its place from 1 in a total order: ranges are sorted apart and offset by the sizes of those
    before, so no task sees all rows."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    scratch = Scratch(df.sparkSession, "numbered")
    spread = scratch.keep(spread, "rows")
    base = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_m0"))
    offset = base.withColumn("_o", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_c")
    return spread.join(F.broadcast(offset), "_p").withColumn("_k", F.col("_m") - F.col("_m0") + 1 + F.coalesce("_o", F.lit(0))).drop("_p", "_m", "_m0", "_o")


def grouped(nodes_: DataFrame, parts: DataFrame, edges: DataFrame, previous: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """Families and packs: node_id, mlfam_id, mlpack_id, canonical_node_id, canonical_sku, status, confidence, component_size.

    ``parts``: node, component; ``edges``: node_id_a, node_id_b, score, predicted; ``previous``: node_id, ml_family_id,
    ml_pack_id, confidence_score; ``manual``: node_id, target_family_id, target_pack_id of nodes split by hand.
    """
    spark = nodes_.sparkSession
    previous = previous if previous is not None else spark.createDataFrame([], "node_id string, ml_family_id string, ml_pack_id string, confidence_score double")
    manual = manual if manual is not None else spark.createDataFrame([], "node_id string, target_family_id string, target_pack_id string")
    rows = nodes_.join(parts.withColumnRenamed("node", "node_id"), "node_id").join(previous, "node_id", "left").join(manual.withColumn("by_hand", F.lit(True)), "node_id", "left")
    family = _stable_ids(rows, "mlfam", ["component"], "ml_family_id", "target_family_id")
    rows = rows.join(family, "component").withColumn("signature", pack_signature(F.col("unit_amount"), F.col("total_amount"), F.col("multipack_count")))
    pack = _stable_ids(rows, "mlpack", ["mlfam_id", "signature"], "ml_pack_id", "target_pack_id")
    rows = rows.join(pack, ["mlfam_id", "signature"])
    lead = F.struct(F.coalesce("sales_volume", F.lit(0.0)), F.coalesce("revenue", F.lit(0.0)), F.coalesce("sku", F.lit("")), F.col("node_id"))
    chosen = rows.groupBy("mlfam_id", "signature").agg(F.max_by("node_id", lead).alias("canonical_node_id"), F.max_by("sku", lead).alias("canonical_sku"))
    size = rows.groupBy("mlfam_id").agg(F.count(F.lit(1)).alias("family_size"))
    positive_ = edges.where("predicted")
    best = positive_.select(F.col("node_id_a").alias("node_id"), "score").union(positive_.select(F.col("node_id_b").alias("node_id"), "score")).groupBy("node_id").agg(F.max("score").alias("best"))
    out = rows.join(chosen, ["mlfam_id", "signature"]).join(size, "mlfam_id").join(best, "node_id", "left")
    hand = F.coalesce("by_hand", F.lit(False))
    return out.select(
        "node_id",
        "mlfam_id",
        "mlpack_id",
        "canonical_node_id",
        F.coalesce("canonical_sku", F.lit("")).alias("canonical_sku"),
        F.when(hand, "manual_singleton").when(F.col("family_size") > 1, "auto_grouped").otherwise("singleton").alias("status"),
        F.when(~hand, F.round(F.greatest("best", "confidence_score"), 6)).alias("confidence"),
        F.when(hand, F.lit(1)).otherwise(F.col("family_size")).cast("long").alias("component_size"),
    )


def regrouped(scratch: Scratch, nodes_: DataFrame, scored_pairs: DataFrame, threshold: float, method: str = "leiden", gamma: float = RESOLUTION, previous: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """Families and packs from stored scores alone: neither texts nor vectors are read again. ``scored_pairs``:
    node_id_a, node_id_b, score; ``previous`` and ``manual`` as in ``grouped``."""
    edges = scratch.keep(scored_pairs.withColumn("predicted", F.coalesce(F.col("score") >= threshold, F.lit(False))), "scored")
    positive_ = edges.where("predicted").select(F.col("node_id_a").alias("a"), F.col("node_id_b").alias("b"), F.col("score").alias("weight"))
    before = previous.select(F.col("node_id").alias("node"), F.col("ml_family_id").alias("family")) if previous is not None else None
    alone = manual.select(F.col("node_id").alias("node")) if manual is not None else None
    return grouped(nodes_, family_parts(scratch, nodes_, positive_, method, gamma, before, alone), edges, previous, manual)


def family_titles(candidates: DataFrame) -> DataFrame:
    """family, title: the family title of its first candidate by revenue, sales, members and name, NULL if that is empty.
    ``candidates``: family, canonical_sku, brand, category_name, revenue, sales_volume, source_count."""
    order = F.struct(*((-F.coalesce(c, F.lit(float("-inf")))).alias(n) for n, c in (("r", F.col("revenue").cast("double")), ("s", F.col("sales_volume").cast("double")), ("c", F.col("source_count").cast("double")))), F.col("canonical_sku").isNull().alias("n"), F.col("canonical_sku").alias("k"))
    first = candidates.groupBy("family").agg(F.min(F.struct(order.alias("o"), F.struct("brand", "category_name").alias("x"))).alias("m"))
    return first.select("family", F.nullif(family_title_column(F.col("m.o.k"), F.col("m.x.brand"), F.col("m.x.category_name")), F.lit("")).alias("title"))


def snapshot(spark: SparkSession, folder: str, rows: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str) -> tuple[DataFrame, bool]:
    """(vectors of ``rows``, whether they were there already). ``rows``: node, text. The snapshot is named by the model and
    by all nodes with their texts, and counts if its manifest agrees with its rows; else it is made again.

    The fingerprint is an order-free sum over hashes, so no sort is needed; a snapshot is moved into place whole.
    """
    h = F.sha2(F.concat_ws("\u0001", F.col("node").cast("string"), F.col("text")), 256)
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)")).alias(f"h{k}")
    mark = rows.agg(F.count(F.lit(1)).alias("n"), *(part(k) for k in range(4))).first()
    name = f"{folder.rstrip('/')}/{hashlib.sha256('|'.join([model, *map(str, mark)]).encode()).hexdigest()[:32]}"
    wanted = {"model": model, "rows": mark["n"]}
    if storage.exists(spark, f"{name}/manifest.json"):
        try:
            kept = spark.read.parquet(f"{name}/vectors")
            if json.loads(storage.read_text(spark, f"{name}/manifest.json")) == wanted and kept.count() == mark["n"]:
                return kept, True
        except Exception:  # noqa: BLE001  a damaged snapshot, in whichever way, is made again
            pass
    stage = f"{name}.stage-{uuid.uuid4().hex}"
    embed(rows).select("node", "vector").write.parquet(f"{stage}/vectors")
    storage.write_text(spark, f"{stage}/manifest.json", json.dumps(wanted))
    storage.delete(spark, name)
    storage.move(spark, stage, name)
    return spark.read.parquet(f"{name}/vectors"), False


def canonical_rows(members: DataFrame) -> DataFrame:
    """One row for each (family, pack, canonical): smallest attributes, summed metrics, members, status."""
    status = F.when(F.bool_or(F.col("status") == "manual_singleton"), "manual_singleton").when(F.count(F.lit(1)) > 1, "auto_grouped").otherwise(F.min("status"))
    return members.groupBy("family", "pack", "canonical").agg(
        F.min("brand").alias("brand"), F.min("subcategory").alias("subcategory"), exact_sum(F.col("units")).alias("units"), exact_sum(F.col("revenue")).alias("revenue"), F.count(F.lit(1)).alias("members"), status.alias("status")
    )


def family_rollup(packs: DataFrame) -> DataFrame:
    """Family rows and pack rows in one table. A family shows its leading pack (revenue, members, name), and attributes
    that all its packs share."""
    w = Window.partitionBy("family").orderBy(F.col("revenue").desc_nulls_last(), F.col("members").desc_nulls_last(), F.col("canonical").asc_nulls_last(), F.col("pack").asc_nulls_last())
    ranked = packs.withColumn("_r", F.row_number().over(w))
    one = lambda c: F.when(F.countDistinct(c) == 1, F.min(c)).alias(c)
    top = ranked.groupBy("family").agg(
        F.lit("family").alias("level"), F.max(F.when(F.col("_r") == 1, F.col("canonical"))).alias("canonical"), F.lit(None).cast("string").alias("pack"), one("brand"), one("subcategory"), exact_sum(F.col("units")).alias("units"), exact_sum(F.col("revenue")).alias("revenue"), F.sum("members").alias("members"), F.count(F.lit(1)).alias("packs")
    )
    low = packs.select("family", F.lit("pack").alias("level"), "canonical", "pack", "brand", "subcategory", "units", "revenue", "members", F.lit(1).cast("long").alias("packs"))
    return top.unionByName(low)


def matched_packs(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """All rows of the packs that a search hit."""
    return rows.join(hits.select("family", "pack").distinct(), ["family", "pack"], "left_semi")


def incremental(nodes_: DataFrame, assignments: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """(nodes without an assignment of this profile, assignments that are reused)."""
    known = assignments.where(F.col("profile").eqNullSafe(profile))
    return nodes_.join(known.select("node_id"), "node_id", "left_anti"), known.join(nodes_.select("node_id"), "node_id", "left_semi")


def manual_split(groups: DataFrame, splits: DataFrame) -> DataFrame:
    """Groups after splits by hand: a split node is a family and a pack of its own, and sizes, statuses and canonical
    members of what is left are computed again. ``groups``: node_id, family, pack, sku, units, status."""
    rows = groups.join(splits.select("node_id", F.lit(True).alias("_s")).distinct(), "node_id", "left")
    own = F.concat(F.lit("_manual_"), F.col("node_id"))
    moved = rows.withColumns({"family": F.when(F.col("_s"), F.concat(F.lit("mlfam"), own)).otherwise(F.col("family")), "pack": F.when(F.col("_s"), F.concat(F.lit("mlpack"), own)).otherwise(F.col("pack"))})
    size = F.count(F.lit(1)).over(Window.partitionBy("family"))
    lead = Window.partitionBy("family", "pack").orderBy(F.col("units").desc_nulls_last(), "sku", "node_id")
    out = moved.withColumns({"component_size": size, "canonical_node_id": F.first("node_id").over(lead)})
    return out.withColumn("status", F.when(F.col("_s"), "manual_singleton").when(F.col("component_size") > 1, "auto_grouped").otherwise("singleton")).drop("_s")
