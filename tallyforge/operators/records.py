"""Product records for research, label states, graph summaries and the small languages of catalogs."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import exact_sum, positive, safe_div
from tallyforge.functions.text import clean, is_empty, marketplace_key, norm
from tallyforge.operators.identity import top_k

# Names of marketplaces, scopes by their weight.
MARKETPLACES = {"ozon": "oz", "озон": "oz", "oz": "oz", "wildberries": "wb", "вайлдберриз": "wb", "wb": "wb", "вб": "wb", "яндекс.маркет": "ym", "яндекс маркет": "ym", "yandex": "ym", "ym": "ym", "ям": "ym"}
SCOPES = ("global", "unknown_to_global", "same_subcategory")


def marketplace_code(c: Column) -> Column:
    """The code of a marketplace by any of its names, else NULL."""
    table = F.create_map(*(F.lit(x) for kv in MARKETPLACES.items() for x in kv))
    return F.try_element_at(table, F.lower(clean(c)))


def _unique(c: str, order: str) -> Column:
    """Values of a group that aren't empty, once each in any case, in the order of their first row, ``|``-joined."""
    first = F.array_sort(F.collect_list(F.when(~is_empty(F.col(c)), F.struct(F.col(order).alias("o"), clean(F.col(c)).alias("v")))))
    values = F.transform(first, lambda x: x["v"])
    fold = F.aggregate(values, F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.array_append(acc, v)))
    return F.array_join(fold, "|")


def product_records(rows: DataFrame, order: str) -> DataFrame:
    """One record for each ``marketplace::sku``: the first title and brand, subcategories, sales and rows.

    ``rows``: marketplace, sku, title, brand, subcategory, units.
    """
    keyed = rows.where(~is_empty(F.col("sku"))).withColumn("raw_record_id", F.concat_ws("::", marketplace_key(F.col("marketplace")), clean(F.col("sku"))))
    first = lambda c: F.min_by(F.when(~is_empty(F.col(c)), clean(F.col(c))), F.when(~is_empty(F.col(c)), F.col(order)))
    return keyed.groupBy("raw_record_id").agg(first("title").alias("title"), first("brand").alias("brand"), _unique("subcategory", order).alias("subcategories"), exact_sum(F.col("units")).alias("units"), F.count(F.lit(1)).alias("n_rows"))


def collapsed_titles(records: DataFrame) -> DataFrame:
    """Records of one exact title as one, ``exact_title::`` and a hash; a title of one record keeps its id."""
    key = norm(F.col("title"))
    out = records.withColumn("_k", F.when(key == "", F.col("raw_record_id")).otherwise(key)).groupBy("_k").agg(
        F.count(F.lit(1)).alias("records"), F.min("raw_record_id").alias("_id"), F.min("title").alias("title"), exact_sum(F.col("units")).alias("units")
    )
    name = F.when(F.col("records") > 1, F.concat(F.lit("exact_title::"), F.substring(F.sha1("_k"), 1, 16))).otherwise(F.col("_id"))
    return out.select(name.alias("record_id"), "title", "units", "records")


def merged_states(rows: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their label, conflicts): labels of a table and of a bot's states; where both have one and differ, the
    row is a conflict and leaves. ``rows``: row_index, label; ``states``: row_index, final_label."""
    both = rows.join(states.select("row_index", F.nullif(F.trim("final_label"), F.lit("")).alias("_bot")), "row_index", "left")
    own = F.nullif(F.trim("label"), F.lit(""))
    clash = own.isNotNull() & F.col("_bot").isNotNull() & (own != F.col("_bot"))
    return both.where(~F.coalesce(clash, F.lit(False))).withColumn("label", F.coalesce(own, F.col("_bot"))).drop("_bot"), both.where(clash).select("row_index")


def pack_estimate(unit: Column, total: Column) -> Column:
    return safe_div(positive(total), positive(unit))


def family_stats(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(size, brands and subcategories of each family; one row of size statistics). ``members``: family, brand, subcategory."""
    families = members.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("brand").alias("brands"), F.countDistinct("subcategory").alias("subcategories"))
    several = F.when(F.col("size") > 1, F.col("size"))
    stats = families.agg(F.count(F.lit(1)).alias("families"), F.avg("size").alias("mean"), F.avg(several).alias("mean_of_several"), F.max("size").alias("largest"), F.count(several).alias("several"))
    return families, stats


def shown_families(families: DataFrame, most_nodes: int) -> DataFrame:
    """Whole families, the largest first, while their nodes fit in ``most_nodes``; one that doesn't is passed over. At
    most ``most_nodes`` families can be shown, and only so many are looked at."""
    rows = families.orderBy(F.desc("size"), "family").limit(most_nodes).collect()
    left, chosen = most_nodes, []
    for r in rows:
        if r["size"] <= left:
            chosen.append((r["family"], r["size"]))
            left -= r["size"]
    return families.sparkSession.createDataFrame(chosen, "family string, size long")


def scoped_pairs(rows: DataFrame, k: int = 30, safety: int = 5) -> DataFrame:
    """Pairs by top-k search in scopes: within a subcategory, records without one against all, and a small search of all
    as a safety net; a pair keeps its best score, then the nearer scope, then the smaller rank.

    ``rows``: node, vector, sub.
    """
    sub = norm(F.col("sub"))
    own = rows.where(sub != "").withColumn("block", F.concat(F.lit("s:"), sub)).withColumn("scope", F.lit("same_subcategory"))
    every = rows.withColumn("block", F.lit("g")).withColumn("scope", F.lit("global"))
    unknown = every.withColumn("scope", F.lit("unknown_to_global"))
    parts = [top_k(own.select("node", "vector", "block", "scope"), k), top_k(unknown.select("node", "vector", "block", "scope"), k, queries=rows.where(sub == "").select("node")), top_k(every.select("node", "vector", "block", "scope"), safety)]
    near = parts[0].unionByName(parts[1]).unionByName(parts[2])
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in enumerate(SCOPES) for x in (kv[1], kv[0]))), F.col("scope"))
    best = near.withColumn("a", F.least("node", "other")).withColumn("b", F.greatest("node", "other")).groupBy("a", "b").agg(F.min(F.struct((-F.col("score")).alias("s"), (-weight).alias("w"), F.greatest(F.lit(1), F.col("rank")).alias("r"), F.col("scope").alias("c"))).alias("x"))
    return best.select("a", "b", F.round(-F.col("x.s"), 6).alias("score"), F.col("x.c").alias("scope"), F.col("x.r").alias("rank"))


def supplemental_pairs(records: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """At most ``budget`` pairs of different marketplaces of one brand, chosen by a seeded hash: neighbours in the hash's
    order within a brand, so no brand gives all its pairs. ``records``: id, brand, marketplace."""
    w = Window.partitionBy("_b").orderBy("_o", "id")
    rows = records.withColumn("_b", norm(F.col("brand"))).where("_b <> ''").withColumn("_o", F.xxhash64("id", F.lit(seed)))
    rows = rows.withColumns({"other": F.lead("id").over(w), "_m": F.lead("marketplace").over(w)})
    pairs = rows.where("other is not null and marketplace <> _m").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return pairs.orderBy(F.xxhash64("a", "b", F.lit(seed)), "a", "b").limit(budget)


def two_levels(groups: DataFrame) -> DataFrame:
    """Families with their sums and price, and their members below. ``groups``: family, node, units, revenue."""
    top = groups.groupBy("family").agg(exact_sum(F.col("units")).alias("units"), exact_sum(F.col("revenue")).alias("revenue"))
    top = top.select("family", F.lit(1).alias("level"), F.lit(None).cast("string").alias("node"), "units", "revenue", safe_div(F.col("revenue"), F.col("units")).alias("price"))
    low = groups.select("family", F.lit(2).alias("level"), "node", "units", "revenue", safe_div(F.col("revenue"), F.col("units")).alias("price"))
    return top.unionByName(low)


def summary(df: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(score).alias("low"), F.max(score).alias("high"))


def filtered(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column passes a catalog's filter; an empty filter passes all."""
    model = filter_model(text)
    if model is None:
        return df
    x = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    found = [x.contains(c["filter"].lower()) if c["type"] == "contains" else ~x.contains(c["filter"].lower()) for c in model.get("conditions", [model])]
    both = found[0] if len(found) == 1 else found[0] & found[1] if model["operator"] == "AND" else found[0] | found[1]
    return df.where(both)


def filter_model(text: str) -> dict | None:
    """A catalog's filter: one or two quoted terms joined by ``&`` or ``|``, each with NOT before it or not."""
    text = text.strip()
    if not text:
        return None
    terms = re.findall(r"(NOT\s+)?'([^']*)'", text, re.IGNORECASE)
    joins = re.findall(r"[&|]", re.sub(r"'[^']*'", "", text))
    if not terms or re.sub(r"(NOT\s+)?'[^']*'|[&|\s]", "", text, flags=re.IGNORECASE):
        raise ValueError(f"{text!r} is no filter")
    if len(terms) > 2 or len(joins) != len(terms) - 1:
        raise ValueError("a filter has one term, or two and a sign between them")
    one = lambda t: {"type": "notContains" if t[0] else "contains", "filter": t[1]}
    if len(terms) == 1:
        return {"filterType": "text", **one(terms[0])}
    return {"filterType": "text", "operator": "AND" if joins[0] == "&" else "OR", "conditions": [one(t) for t in terms]}


def pair_text(brand: Column, title: Column, unit: Column, total: Column) -> Column:
    """Text of one side of a pair for a model: labelled parts, numbers of four digits."""
    from pyspark.sql.functions import pandas_udf

    def short(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else f"{v:.4g}" for v in x], dtype=object)

    from tallyforge.functions.text import labelled

    digits = lambda c: pandas_udf(short, "string")(positive(c))
    return labelled(brand=clean(brand), title=clean(title), unit=digits(unit), total=digits(total))


def deleted_file(status: Column, kind: Column) -> Column:
    """A task's status after one of its files is gone."""
    return F.when(kind == "raw", F.when(status == "downloaded", "pending").otherwise(status)).when(kind == "processed", F.when(status == "processed", "downloaded").otherwise(status)).when(kind == "classified", F.when(status == "classified", "processed").otherwise(status)).otherwise(status)


