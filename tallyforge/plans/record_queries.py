"""Queries on product records, label states and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import numbers as n
from tallyforge.functions import text as t
from tallyforge.operators import records as r
from tallyforge.operators import summaries as su
from tallyforge.plans.adapter import CUBE, cube, table
from tallyforge.plans.catalog import query
from tallyforge.schema import q


def _rows(spark, d):
    x = cube(spark, d)
    return x.select(F.col("Маркетплейс").alias("marketplace"), F.col("Артикул").alias("sku"), F.col("SKU").alias("title"), F.col("Бренд").alias("brand"), F.col("Подкатегория").alias("subcategory"), n.number_of(x, "Продажи, шт").alias("units"), F.col("__row_hash").alias("rid"))


_RECORDS = f"WITH {CUBE}, rec AS (SELECT mp || '::' || art AS raw_record_id, min(sku) AS title, min(brand) AS brand, min(sub) AS subcategories, CAST(sum(qty) AS DOUBLE) AS units, count(*) AS n_rows FROM cube GROUP BY 1)"


@query("a17_product_records", f"{_RECORDS} SELECT * FROM rec")
def _(spark, d):
    return r.product_records(_rows(spark, d), "rid")


@query("a17_title_collapse", f"{_RECORDS}, x AS (SELECT lower(title) AS k, count(*) AS records, min(raw_record_id) AS id, min(title) AS title, CAST(sum(CAST(units AS DECIMAL(38,6))) AS DOUBLE) AS units FROM rec GROUP BY 1) SELECT CASE WHEN records > 1 THEN 'exact_title::' || substr(sha1(k), 1, 16) ELSE id END AS record_id, title, units, records FROM x")
def _(spark, d):
    return r.collapsed_titles(r.product_records(_rows(spark, d), "rid"))


@query("a20_graph_report", "WITH f AS (SELECT p_partkey % 300 AS f, count(*) AS size, count(DISTINCT p_brand) AS b FROM part GROUP BY 1) SELECT count(*) AS families, avg(size) AS mean, avg(size) FILTER (WHERE size > 1) AS mean_of_several, max(size) AS largest, count(*) FILTER (WHERE size > 1) AS several FROM f")
def _(spark, d):
    x = table(spark, d, "part").select((F.col("p_partkey") % 300).alias("family"), F.col("p_brand").alias("brand"), F.col("p_type").alias("subcategory"))
    return r.family_stats(x)[1]


@query("a20_graph_sample", "SELECT CAST(f AS VARCHAR) AS family, size FROM (SELECT p_size AS f, count(*) AS size FROM part GROUP BY 1) ORDER BY size DESC, family LIMIT 2")
def _(spark, d):
    x = table(spark, d, "part").groupBy(F.col("p_size").cast("string").alias("family")).agg(F.count("*").alias("size"))
    two = x.orderBy(F.desc("size"), "family").limit(2).agg(F.sum("size")).first()[0]
    return r.shown_families(x, int(two)).limit(2)


@query("j12_label_state_merge", "SELECT doc_id AS row_index, CASE WHEN doc_id % 3 = 0 THEN 'same' WHEN doc_id % 2 = 0 THEN 'different' END AS label FROM documents WHERE NOT (doc_id % 6 = 0)")
def _(spark, d):
    x = table(spark, d, "documents")
    rows = x.select(F.col("doc_id").alias("row_index"), F.expr("if(doc_id % 3 = 0, 'same', ' ')").alias("label"))
    return r.merged_states(rows, x.where("doc_id % 2 = 0").select(F.col("doc_id").alias("row_index"), F.lit("different").alias("final_label")))[0]


@query("a45_pack_estimate", "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size * 3.0 / p_size END::DOUBLE AS packs FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", r.pack_estimate(F.expr("if(p_size > 5, p_size, 0)"), F.col("p_size") * 3).alias("packs"))


@query("a54_two_levels", "WITH m AS (SELECT p_brand AS family, CAST(p_partkey AS VARCHAR) AS node, CAST(p_size AS DOUBLE) AS units, p_retailprice AS revenue FROM part), f AS (SELECT family, CAST(sum(CAST(units AS DECIMAL(38,6))) AS DOUBLE) AS units, CAST(sum(CAST(revenue AS DECIMAL(38,6))) AS DOUBLE) AS revenue FROM m GROUP BY 1) SELECT family, 1 AS level, NULL::VARCHAR AS node, units, revenue, revenue / units AS price FROM f UNION ALL SELECT family, 2, node, units, revenue, revenue / units FROM m")
def _(spark, d):
    return r.two_levels(table(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").cast("string").alias("node"), F.col("p_size").cast("double").alias("units"), F.col("p_retailprice").alias("revenue")))


@query("a55_labeling_summary", "SELECT lang AS run, source AS stratum, count(*) AS rows, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY ALL")
def _(spark, d):
    return r.summary(table(spark, d, "documents").select(F.col("lang").alias("run"), F.col("source").alias("stratum"), F.col("n_chars").alias("score")), ["run", "stratum"])


@query("a56_metric_pivot", "SELECT source AS algorithm, max(n_chars) FILTER (WHERE lang = 'de') AS de, max(n_chars) FILTER (WHERE lang = 'en') AS en FROM documents GROUP BY 1")
def _(spark, d):
    return su.pivoted(table(spark, d, "documents").select(F.col("source").alias("algorithm"), "lang", "n_chars"), "algorithm", "lang", ["de", "en"], F.max("n_chars"))


@query("m5_scoped_topk", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT a.vec_id AS node, b.vec_id AS other, a.label AS la, b.label AS lb, list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) AS score FROM e a JOIN e b ON TRUE), n1 AS (SELECT node, other, score FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) - 1 AS rk FROM s WHERE la = lb AND la > 0) WHERE rk <= 4), n2 AS (SELECT node, other, score FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) - 1 AS rk FROM s) WHERE rk <= CASE WHEN la = 0 THEN 4 ELSE 2 END) SELECT least(node, other) AS a, greatest(node, other) AS b, round(round(max(score), 6), 3) AS score FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2) WHERE node <> other GROUP BY 1, 2")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"), F.expr("if(label > 0, 'l' || label, '')").alias("sub"))
    return r.scoped_pairs(x, 4, 2).select("a", "b", F.round("score", 3).alias("score"))


@query("m6_supplemental_pairs")
def _(spark, d):
    return r.supplemental_pairs(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("marketplace")), 100)


@query("p16_pair_text", "SELECT p_partkey, concat_ws(' | ', 'brand: ' || p_brand, 'title: ' || p_name, 'unit: ' || CAST(p_size AS VARCHAR), CASE WHEN p_size > 10 THEN 'total: ' || CAST(p_size * 2 AS VARCHAR) END) AS text FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", r.pair_text(F.col("p_brand"), F.col("p_name"), F.col("p_size"), F.expr("if(p_size > 10, p_size * 2, 0)")).alias("text"))


@query("x15_marketplace_alias", "SELECT n_nationkey, ['oz', 'wb', 'ym', NULL][n_nationkey % 4 + 1] AS code FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", r.marketplace_code(F.expr("element_at(array(' ОЗОН', 'wildberries', 'Яндекс  Маркет', 'x'), n_nationkey % 4 + 1)")).alias("code"))


@query("x11_marketplace_key", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'unknown_marketplace' ELSE lower(n_name) END AS key FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", t.marketplace_key(F.expr("if(n_nationkey % 3 = 0, '  ', ' ' || n_name)")).alias("key"))


@query("d8_file_deletion", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'processed' END ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'downloaded' ELSE 'downloaded' END END AS status FROM orders) GROUP BY 1")
def _(spark, d):
    x = r.deleted_file(F.expr("if(o_orderkey % 3 = 0, 'downloaded', 'processed')"), F.expr("if(o_orderkey % 2 = 0, 'raw', 'processed')"))
    return table(spark, d, "orders").groupBy(x.alias("status")).agg(F.count("*").alias("n"))


@query("a53_duplicate_examples", "WITH k AS (SELECT p_brand, p_size, p_name, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand AS brand, p_size AS size, p_name AS title, n FROM k WHERE n >= 2")
def _(spark, d):
    return su.duplicates(table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_name").alias("title")), ["brand", "size", "title"])


@query("j14_dictionary_join", "SELECT n_name AS nation, count(*) AS n_rows, CAST(sum(CAST(c_acctbal AS DECIMAL(38,6))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return su.dictionary_sums(x, table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation")), "key", "nation", "balance")
