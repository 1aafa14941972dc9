"""Queries on matching, grouping, research and labelling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import numbers as n
from tallyforge.functions import text as t
from tallyforge.operators import boards as b
from tallyforge.operators import graph as g
from tallyforge.operators import identity as i
from tallyforge.operators import research as r
from tallyforge.operators import state as s
from tallyforge.operators import summaries as su
from tallyforge.plans.adapter import CUBE, cube, table
from tallyforge.plans.catalog import query
from tallyforge.schema import q
from tallyforge.storage import Scratch

_NODES = f"""WITH {CUBE}, nodes AS (SELECT 'sku_' || substr(sha1(concat_ws('|', 'demo', ck, mp, art)), 1, 16) AS node_id, ck, mp, art, min(sku) AS sku, min(brand) AS brand, min(sub) AS sub,
 CAST(sum(qty) AS DOUBLE) AS units, CAST(sum(rev) AS DOUBLE) AS revenue, count(*) AS n FROM cube GROUP BY ck, mp, art)"""


def _source(spark, d):
    x = cube(spark, d)
    return x.select(
        F.col("__project_name").alias("project_name"), F.col("__category_key").alias("category_key"), F.col("__marketplace_code").alias("marketplace_code"), F.col("Артикул").alias("article"), F.col("Категория").alias("category_name"),
        F.col("Маркетплейс").alias("marketplace"), F.col("SKU").alias("sku"), F.col("Бренд").alias("brand"), F.col("Подкатегория").alias("subcategory"), F.lit(0.5).alias("unit_amount"), F.lit(1.5).alias("total_amount"),
        n.number_of(x, "Продажи, шт").alias("sales_volume"), n.number_of(x, "Выручка, руб").alias("revenue"), F.col("__row_hash").alias("row_hash"),
    )


@query("a16_sku_nodes", f"{_NODES} SELECT node_id, art AS article, sku, brand, sub AS subcategory, units AS sales_volume, revenue, n AS row_count, 3.0::DOUBLE AS multipack_count FROM nodes")
def _(spark, d):
    return i.nodes(_source(spark, d), "row_hash").select("node_id", "article", "sku", "brand", "subcategory", "sales_volume", "revenue", "row_count", "multipack_count")


@query("p15_retrieval_text", "SELECT p_partkey, concat_ws(' | ', 'бренд: ' || p_brand, CASE WHEN p_size > 10 THEN 'подкатегория: ' || p_type END, 'название: ' || p_name) AS text FROM part")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.expr("if(p_size > 10, p_type, '  ')").alias("subcategory"), F.col("p_name").alias("sku"))
    return x.select("p_partkey", i.retrieval_text().alias("text"))


@query("x_pair_text_hash", "SELECT p_partkey, sha256('[\"' || p_name || '\",\"' || p_brand || '\"]') AS h FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", i.pair_hash(F.col("p_name"), F.col("p_brand")).alias("h"))


_EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


def _vectors(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("sub"))
    return i.blocks(x, F.col("sub"))


_TOPK = f"""WITH {_EMB}, s AS (SELECT a.vec_id AS node, b.vec_id AS other, list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) AS score FROM e a JOIN e b ON a.label = b.label),
 k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) - 1 AS rank FROM s)"""


@query("j17_topk_join", f"{_TOPK} SELECT node, other, round(score, 4) AS score FROM k WHERE rank <= 5 AND node <> other")
def _(spark, d):
    return i.top_k(_vectors(spark, d), 5).select("node", "other", F.round("score", 4).alias("score"))


@query("m4_candidate_pairs", f"{_TOPK} SELECT least(node, other) AS node_id_a, greatest(node, other) AS node_id_b, round(max(score), 6) AS similarity FROM k WHERE rank <= 5 AND node <> other GROUP BY 1, 2")
def _(spark, d):
    return i.candidate_pairs(i.top_k(_vectors(spark, d), 5)).select("node_id_a", "node_id_b", "similarity")


@query("m31_cosine", f"WITH {_EMB} SELECT a.vec_id AS node, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"))
    y = x.toDF("other", "w")
    return x.join(y, F.col("other") == F.col("node") + 1).select("node", "other", F.round(i.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("m9_same_pack", "SELECT p_partkey, abs(p_size - 20) <= greatest(0.02, 0.05 * greatest(p_size, 20)) AND (abs(p_size * 2 - 40) <= greatest(0.02, 0.05 * greatest(p_size * 2, 40)) OR FALSE) AS same, 'u=' || CAST(p_size AS DOUBLE) || '|t=na|p=2.0' AS signature FROM part")
def _(spark, d):
    x = F.col("p_size").cast("double")
    same = i.same_pack(x, F.lit(20.0), x * 2, F.lit(40.0), F.lit(1.0), F.lit(9.0))
    return table(spark, d, "part").select("p_partkey", same.alias("same"), i.pack_signature(x, F.lit(None), F.lit(2.0)).alias("signature"))


@query("m11_threshold", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 0.917444 WHEN 1 THEN 0.930329 WHEN 2 THEN 0.872321 ELSE 0.872321 END::DOUBLE AS threshold FROM nation")
def _(spark, d):
    k = F.expr("element_at(array('Соусы', ' Мыло ', 'coconut-oil', 'other'), n_nationkey % 4 + 1)")
    return table(spark, d, "nation").select("n_nationkey", i.threshold_of(F.lit(""), k).alias("threshold"))


_EDGES = f"{_TOPK}, ed AS (SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b FROM k WHERE rank <= 2 AND node <> other)"


def _edges(spark, d):
    near = i.top_k(_vectors(spark, d), 2)
    return near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


_REACH = "WITH RECURSIVE " + _EDGES.removeprefix("WITH ") + ", sym AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), reach(x, y) AS (SELECT a, a FROM sym UNION SELECT reach.x, sym.b FROM reach JOIN sym ON sym.a = reach.y)"


@query("m12_connected_components", f"{_REACH} SELECT x AS node, min(y) AS component FROM reach GROUP BY x")
def _(spark, d):
    scratch = Scratch(spark, "m12")
    edges = scratch.keep(_edges(spark, d), "edges")
    parts = g.components(scratch, edges, "cc")
    return g.with_singletons(parts, edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())


@query("a31_component_sizes", f"{_REACH} SELECT component, count(*) AS nodes FROM (SELECT x, min(y) AS component FROM reach GROUP BY x) GROUP BY component")
def _(spark, d):
    scratch = Scratch(spark, "a31")
    edges = scratch.keep(_edges(spark, d), "edges")
    parts = g.with_singletons(g.components(scratch, edges, "cc"), edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    return g.sizes(parts)


@query("j13_component_map", f"{_REACH}, p AS (SELECT x, min(y) AS c FROM reach GROUP BY x) SELECT m.a, m.b, coalesce(u.c = v.c, FALSE) AS same_component FROM (SELECT vec_id AS a, vec_id + 7 AS b FROM embeddings) m LEFT JOIN p u ON u.x = m.a LEFT JOIN p v ON v.x = m.b")
def _(spark, d):
    scratch = Scratch(spark, "j13")
    edges = scratch.keep(_edges(spark, d), "edges")
    parts = g.with_singletons(g.components(scratch, edges, "cc"), edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    pairs = table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 7).alias("b"))
    return r.component_flags(pairs, parts).select("a", "b", "same_component")


@query("m13_leiden_families")
def _(spark, d):
    scratch = Scratch(spark, "m13")
    edges = i.candidate_pairs(i.top_k(_vectors(spark, d), 5)).select(F.col("node_id_a").alias("a"), F.col("node_id_b").alias("b"), F.col("similarity").alias("weight")).where("weight > 0")
    return g.communities(scratch, edges, "leiden", 1.0)


@query("m14_label_propagation")
def _(spark, d):
    scratch = Scratch(spark, "m14")
    return g.communities(scratch, _edges(spark, d).withColumn("weight", F.lit(1.0)), "lpa", method="label_propagation")


@query("m15_modularity", f"{_EDGES}, m AS (SELECT count(*)::DOUBLE AS m FROM ed), ends AS (SELECT a % 5 AS c FROM ed UNION ALL SELECT b % 5 FROM ed), kk AS (SELECT c, count(*)::DOUBLE AS k FROM ends GROUP BY c), w AS (SELECT a % 5 AS c, count(*)::DOUBLE AS w FROM ed WHERE a % 5 = b % 5 GROUP BY 1) SELECT round(sum(coalesce(w, 0) / m - power(k / (2 * m), 2)), 8) AS modularity FROM kk LEFT JOIN w USING (c) CROSS JOIN m")
def _(spark, d):
    edges = _edges(spark, d).withColumn("weight", F.lit(1.0))
    parts = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node") % 5)
    return g.modularity(edges, parts).select(F.round("modularity", 8).alias("modularity"))


_MEMBERS = "mem AS (SELECT 'f' || (p_partkey % 40) AS family, 'k' || (p_partkey % 120) AS pack, 'c' || (p_partkey % 120) AS canonical, p_brand AS brand, p_type AS subcategory, CAST(p_size AS DOUBLE) AS units, p_retailprice AS revenue FROM part)"


def _members(spark, d):
    return table(spark, d, "part").selectExpr("'f' || (p_partkey % 40) AS family", "'k' || (p_partkey % 120) AS pack", "'c' || (p_partkey % 120) AS canonical", "p_brand AS brand", "p_type AS subcategory", "cast(p_size as double) AS units", "p_retailprice AS revenue", "'singleton' AS status", "p_partkey")


_CANON = f"WITH {_MEMBERS}, can AS (SELECT family, pack, canonical, min(brand) AS brand, min(subcategory) AS subcategory, CAST(sum(CAST(units AS DECIMAL(38,6))) AS DOUBLE) AS units, CAST(sum(CAST(revenue AS DECIMAL(38,6))) AS DOUBLE) AS revenue, count(*) AS members FROM mem GROUP BY ALL)"


@query("a18_canonical_rows", f"{_CANON} SELECT *, CASE WHEN members > 1 THEN 'auto_grouped' ELSE 'singleton' END AS status FROM can")
def _(spark, d):
    return i.canonical_rows(_members(spark, d))


@query(
    "a19_family_rollup",
    f"""{_CANON}, rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY revenue DESC NULLS LAST, members DESC NULLS LAST, canonical NULLS LAST, pack) AS k FROM can)
 SELECT family, 'family' AS level, max(CASE WHEN k = 1 THEN canonical END) AS canonical, NULL::VARCHAR AS pack, CASE WHEN count(DISTINCT brand) = 1 THEN min(brand) END AS brand, CASE WHEN count(DISTINCT subcategory) = 1 THEN min(subcategory) END AS subcategory,
 CAST(sum(CAST(units AS DECIMAL(38,6))) AS DOUBLE) AS units, CAST(sum(CAST(revenue AS DECIMAL(38,6))) AS DOUBLE) AS revenue, CAST(sum(members) AS BIGINT) AS members, count(*) AS packs FROM rk GROUP BY family
 UNION ALL SELECT family, 'pack', canonical, pack, brand, subcategory, units, revenue, members, 1 FROM can""",
)
def _(spark, d):
    return i.family_rollup(i.canonical_rows(_members(spark, d)).drop("status"))


@query("a21_family_candidates", f"{_NODES} SELECT 'f' || (CAST(art AS BIGINT) % 30) AS family, mp AS marketplace_code, CAST(sum(CAST(revenue AS DECIMAL(38,6))) AS DOUBLE) AS revenue, CAST(sum(CAST(units AS DECIMAL(38,6))) AS DOUBLE) AS units, count(*) AS nodes, min(brand) AS brand FROM nodes GROUP BY ALL")
def _(spark, d):
    x = i.nodes(_source(spark, d), "row_hash").withColumn("family", F.expr("'f' || (cast(article as long) % 30)"))
    return su.family_candidates(x, ["family", "marketplace_code"])


@query("w5_family_rank", f"{_CANON} SELECT family, pack, row_number() OVER (PARTITION BY family ORDER BY revenue DESC NULLS LAST, members DESC NULLS LAST, canonical NULLS LAST) AS place FROM can")
def _(spark, d):
    w = Window.partitionBy("family").orderBy(F.col("revenue").desc_nulls_last(), F.col("members").desc_nulls_last(), F.col("canonical").asc_nulls_last())
    return i.canonical_rows(_members(spark, d)).select("family", "pack", F.row_number().over(w).cast("long").alias("place"))


@query("w7_canonical_member", f"WITH {_MEMBERS}, p AS (SELECT *, row_number() OVER () AS z FROM mem) SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY p_partkey % 40, p_partkey % 120 ORDER BY p_size DESC, p_name, p_partkey) AS canonical_node_id, count(*) OVER (PARTITION BY p_partkey % 40) AS component_size FROM part")
def _(spark, d):
    x = _members(spark, d).join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").withColumnsRenamed({"p_partkey": "node_id", "p_name": "sku"})
    none = spark.createDataFrame([], "node_id long")
    return i.manual_split(x, none).select(F.col("node_id").alias("p_partkey"), "canonical_node_id", "component_size")


@query("j6_matched_packs", f"WITH {_MEMBERS} SELECT family, pack, count(*) AS members FROM mem WHERE (family, pack) IN (SELECT family, pack FROM mem WHERE lower(subcategory) LIKE '%large%') GROUP BY ALL")
def _(spark, d):
    x = _members(spark, d)
    return i.matched_packs(x, x.where("lower(subcategory) like '%large%'")).groupBy("family", "pack").agg(F.count("*").alias("members"))


@query("m10_scored_with_cache", "SELECT count(*) AS pairs, count(*) FILTER (WHERE p_partkey % 3 = 0) AS cached, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE length(p_name) END) AS DOUBLE) AS total FROM part")
def _(spark, d):
    pairs = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node_id_a"), F.concat(F.lit("x"), F.col("p_partkey")).alias("node_id_b"), F.col("p_name").alias("text_a"), F.col("p_brand").alias("text_b"))
    cache = pairs.where("cast(node_id_a as long) % 3 = 0").withColumn("pair_hash", i.pair_hash(F.col("text_a"), F.col("text_b"))).select("node_id_a", "node_id_b", "pair_hash", F.lit(7.0).alias("score"))
    every, new = i.scored(pairs, lambda a, _: a.str.len().to_numpy(float), cache)
    return every.agg(F.count("*").alias("pairs"), F.sum("score").alias("total")).crossJoin(new.agg((F.lit(0) + F.count("*")).alias("new"))).select("pairs", (F.col("pairs") - F.col("new")).alias("cached"), "total")


@query("m16_stable_ids")
def _(spark, d):
    x = i.nodes(_source(spark, d), "row_hash")
    parts = x.select(F.col("node_id").alias("node"), F.concat(F.lit("r"), F.substring("node_id", 5, 2)).alias("component"))
    edges = spark.createDataFrame([], "node_id_a string, node_id_b string, score double, predicted boolean")
    return i.grouped(x, parts, edges)


@query("m19_identity_reuse", "SELECT 'new' AS kind, count(*) AS nodes FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT 'reused', count(*) FROM part WHERE p_partkey % 4 = 0")
def _(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"))
    known = nodes.select("node_id", F.expr("if(node_id % 4 = 0, 'now', if(node_id % 4 = 1, 'old', null))").alias("profile"))
    new, reused = i.incremental(nodes, known, "now")
    return new.agg(F.lit("new").alias("kind"), F.count("*").alias("nodes")).union(reused.agg(F.lit("reused"), F.count("*")))


@query("m20_manual_split", "SELECT p_partkey, CASE WHEN p_partkey % 25 = 0 THEN 'mlfam_manual_' || p_partkey ELSE 'f' || (p_partkey % 40) END AS family, CASE WHEN p_partkey % 25 = 0 THEN 1 ELSE count(*) OVER (PARTITION BY p_partkey % 25 = 0, p_partkey % 40) END AS component_size FROM part")
def _(spark, d):
    x = _members(spark, d).withColumnRenamed("p_partkey", "node_id").withColumn("sku", F.col("pack"))
    return i.manual_split(x, x.where("node_id % 25 = 0").select("node_id")).select(F.col("node_id").alias("p_partkey"), "family", "component_size")


@query("m22_decide_label", "SELECT p_partkey, CASE WHEN p_brand <> 'Brand#12' THEN 'different' WHEN p_size / 50.0 < 0.55 THEN 'different' WHEN p_size / 50.0 >= 0.82 THEN 'duplicate' ELSE 'uncertain' END AS label FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", r.decided(F.col("p_size") / 50.0, F.col("p_brand"), F.lit("brand#12")).alias("label"))


@query("m24_fusion_edges", "SELECT count(*) FILTER (WHERE p_size >= 25) AS family_edges, count(*) FILTER (WHERE p_size >= 25 AND p_partkey % 2 = 0) AS pack_edges FROM part")
def _(spark, d):
    x = table(spark, d, "part").select((F.col("p_size") / 50).alias("score"), (F.col("p_partkey") % 2 == 0).alias("same_pack"))
    return r.fusion_edges(x, 0.5).agg(F.count_if("family_edge").alias("family_edges"), F.count_if("pack_edge").alias("pack_edges"))


# Lexical candidates and text


_DOC_WORDS = "regexp_extract_all(lower(text), '[0-9a-zа-я]+')"


@query("x2_normalise_title", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' Ёж-№' || p_brand), 'ё', 'е', 'g'), '[^0-9a-zа-я]+', ' ', 'g')) AS title FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", t.title(F.concat(F.col("p_name"), F.lit(" Ёж-№"), F.col("p_brand"))).alias("title"))


@query("x3_clean_text", "SELECT c_custkey, 'a b ' || c_name AS x FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", t.clean(F.concat(F.lit(" \t a  b\n"), F.col("c_name"), F.lit("  "))).alias("x"))


@query("x5_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' соус 500 мл x ab'), '[0-9a-zа-я]+'), lambda w: length(w) > 1 AND w NOT IN ('соус', 'мл', 'x') AND NOT regexp_full_match(w, '[0-9]+')))), ' ') AS tokens FROM part")
def _(spark, d):
    x = t.meaningful_tokens(F.concat(F.col("p_name"), F.lit(" соус 500 мл x ab")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(x), " ").alias("tokens"))


@query("x7_jaccard", "SELECT p_partkey, len(list_intersect(s, u))::DOUBLE / len(list_distinct(list_concat(s, u))) AS jaccard, len(list_intersect(s, u))::DOUBLE / least(len(s), len(u)) AS containment FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS s, ['red', 'widget', 'steel'] AS u FROM part)")
def _(spark, d):
    a, c = F.array_distinct(F.split("p_name", " ")), F.array(*(F.lit(x) for x in ("red", "widget", "steel")))
    return table(spark, d, "part").select("p_partkey", t.jaccard(a, c).alias("jaccard"), t.containment(a, c).alias("containment"))


@query("x10_sku_text", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_partkey || '.50' END AS sku FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", t.sku_text(F.expr("if(p_partkey % 2 = 0, p_partkey || '.00', p_partkey || '.50')")).alias("sku"))


@query("x13_relation", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'unknown' WHEN p_brand = 'Brand#13' THEN 'same' ELSE 'different' END AS relation FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", t.relation(F.expr("if(p_size % 5 = 0, ' ', upper(p_brand))"), F.lit("brand#13 ")).alias("relation"))


_REC = "rec AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' n' || (p_partkey % 700) AS title FROM part), tok AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(regexp_extract_all(lower(title), '[0-9a-zа-я]+')) AS w FROM rec) WHERE length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+')), ok AS (SELECT w FROM tok GROUP BY w HAVING count(*) BETWEEN 2 AND 120)"


@query("j16_token_block_join", f"WITH {_REC} SELECT a.id AS a, b.id AS b, count(*) AS shared FROM tok a JOIN ok USING (w) JOIN tok b USING (w) WHERE a.id < b.id GROUP BY ALL")
def _(spark, d):
    return r.token_pairs(table(spark, d, "part").selectExpr("p_partkey AS id", "p_name || ' ' || p_type || ' n' || (p_partkey % 700) AS title"))


@query("m7_exact_title_pairs", "WITH k AS (SELECT p_partkey AS id, lower(p_name || p_brand || p_type) AS key FROM part), ok AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 80) SELECT a.id AS a, b.id AS b FROM k a JOIN ok USING (key) JOIN k b USING (key) WHERE a.id < b.id")
def _(spark, d):
    return r.title_pairs(table(spark, d, "part").selectExpr("p_partkey AS id", "p_name || p_brand || p_type AS title"))


@query("m8_pair_flags", "SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_type <> b.p_type AS cross_marketplace, a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_size % 2 = 0 AS hard_negative, a.p_brand = b.p_brand AND a.p_size <> b.p_size AS pack_variant FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(spark, d):
    x = table(spark, d, "part")
    y = x.select(*(F.col(c).alias(f"{c}_b") for c in x.columns))
    flavor = lambda a, c: F.when(F.col(c) % 2 == 0, F.array(F.lit(a))).otherwise(F.array().cast("array<string>"))
    pairs = x.join(y, F.col("p_partkey_b") == F.col("p_partkey") + 1).select(
        F.col("p_partkey").alias("a"), F.col("p_partkey_b").alias("b"), F.col("p_type").alias("marketplace_a"), F.col("p_type_b").alias("marketplace_b"), F.col("p_brand").alias("brand_a"), F.col("p_brand_b").alias("brand_b"),
        (F.col("p_size") == F.col("p_size_b")).alias("same_pack"), flavor("чили", "p_size").alias("flavors_a"), F.when(F.col("p_size") == F.col("p_size_b"), flavor("мяса", "p_size_b")).otherwise(F.array().cast("array<string>")).alias("flavors_b"), F.lit(0.9).alias("similarity"),
    )
    return r.pair_flags(pairs).select("a", "b", "cross_marketplace", "hard_negative", "pack_variant")


@query("a37_ngram_counts", f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS gram FROM (SELECT {_DOC_WORDS} AS w FROM documents WHERE lang = 'en')) GROUP BY gram HAVING count(*) >= 20")
def _(spark, d):
    x = table(spark, d, "documents").where("lang = 'en'").select(F.expr("regexp_extract_all(lower(text), '[0-9a-zа-я]+', 0)").alias("w"))
    return r.ngram_counts(x, F.col("w"), 2).where("n >= 20")


# Calibration


_CAL = "cal AS (SELECT d.source AS method, CASE WHEN d.doc_id % 3 = 0 THEN 'test' ELSE 'dev' END AS split, round((d.n_chars % 97) / 97.0, 3)::DOUBLE AS score, l.quality = 1 AS target, d.doc_id FROM documents d JOIN labels l USING (doc_id))"


def _cal(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return x.select(F.col("source").alias("method"), F.expr("if(doc_id % 3 = 0, 'test', 'dev')").alias("split"), F.round((F.col("n_chars") % 97) / 97.0, 3).alias("score"), (F.col("quality") == 1).alias("target"), "doc_id")


_RATES = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END AS accuracy, 5.0::DOUBLE * fp + 1.0::DOUBLE * fn AS cost"
_COUNTS = "count(*) FILTER (WHERE p AND target)::DOUBLE AS tp, count(*) FILTER (WHERE p AND NOT target)::DOUBLE AS fp, count(*) FILTER (WHERE NOT p AND NOT target)::DOUBLE AS tn, count(*) FILTER (WHERE NOT p AND target)::DOUBLE AS fn"


@query("a27_binary_metrics", f"WITH {_CAL}, c AS (SELECT method, {_COUNTS} FROM (SELECT *, score >= 0.4 AS p FROM cal) GROUP BY method) SELECT *, {_RATES} FROM c")
def _(spark, d):
    return r.binary_metrics(_cal(spark, d).withColumn("predicted", F.col("score") >= 0.4), ["method"])


_GRID = f"WITH {_CAL}, th AS (SELECT DISTINCT method, score AS threshold FROM cal WHERE split = 'dev' UNION SELECT method, max(score) * (1 + power(2::DOUBLE, -52)) FROM cal WHERE split = 'dev' GROUP BY method), c AS (SELECT th.method, threshold, {_COUNTS} FROM (SELECT th.*, cal.target, cal.score >= th.threshold AS p FROM th JOIN cal ON cal.method = th.method AND cal.split = 'dev') th GROUP BY th.method, threshold), gr AS (SELECT *, {_RATES} FROM c)"


@query("a28_threshold_grid", f"{_GRID} SELECT * FROM gr")
def _(spark, d):
    return r.threshold_grid(_cal(spark, d).where("split = 'dev'"), ["method"])


@query("m25_threshold_strategies", f"{_GRID} SELECT method, 'max_f1' AS strategy, arg_max(threshold, (f1, precision, threshold)) AS threshold FROM gr GROUP BY method UNION ALL SELECT method, 'cost_sensitive', arg_max(threshold, (-cost, -fp, threshold)) FROM gr GROUP BY method")
def _(spark, d):
    return r.best_thresholds(r.threshold_grid(_cal(spark, d).where("split = 'dev'"), ["method"]), ["method"])


@query("m26_calibrate", f"{_GRID}, ch AS (SELECT method, 'max_f1' AS strategy, arg_max(threshold, (f1, precision, threshold)) AS threshold FROM gr GROUP BY method UNION ALL SELECT method, 'cost_sensitive', arg_max(threshold, (-cost, -fp, threshold)) FROM gr GROUP BY method), ev AS (SELECT ch.method, strategy, threshold, split, {_COUNTS} FROM (SELECT ch.*, cal.split, cal.target, cal.score >= threshold AS p FROM ch JOIN cal USING (method)) ch GROUP BY ALL) SELECT *, {_RATES} FROM ev")
def _(spark, d):
    return r.calibrated(_cal(spark, d))


@query("m23_select_run", f"{_GRID} SELECT method, threshold, cost FROM gr ORDER BY cost, fp, fn, f1 DESC, threshold DESC, method LIMIT 1")
def _(spark, d):
    x = r.threshold_grid(_cal(spark, d).where("split = 'dev'"), ["method"]).withColumn("strategy", F.lit("grid"))
    return r.best_run(x, "missing").select("method", "threshold", "cost")


@query("a29_confusion", "SELECT lang AS actual, count(*) FILTER (WHERE n_chars % 3 = 0) AS de, count(*) FILTER (WHERE n_chars % 3 = 1) AS en, count(*) FILTER (WHERE n_chars % 3 = 2) AS fr FROM documents WHERE lang IN ('de', 'en', 'fr') GROUP BY lang")
def _(spark, d):
    x = table(spark, d, "documents").select(F.col("lang").alias("actual"), F.expr("element_at(array('de', 'en', 'fr'), cast(n_chars % 3 + 1 as int))").alias("guess"))
    return r.confusion(x, ["de", "en", "fr"])


@query("a29_class_report", "WITH x AS (SELECT lang AS a, ['de', 'en', 'fr'][n_chars % 3 + 1] AS g FROM documents), n AS (SELECT unnest(['de', 'en', 'fr']) AS label), y AS (SELECT label, (SELECT count(*) FROM x WHERE a = label AND g = label)::DOUBLE AS tp, (SELECT count(*) FROM x WHERE a = label)::DOUBLE AS s, (SELECT count(*) FROM x WHERE g = label)::DOUBLE AS sd FROM n), z AS (SELECT label, CASE WHEN sd > 0 THEN tp / sd ELSE 0 END AS precision, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS recall, CAST(s AS BIGINT) AS support FROM y) SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM z")
def _(spark, d):
    x = table(spark, d, "documents").select(F.col("lang").alias("actual"), F.expr("element_at(array('de', 'en', 'fr'), cast(n_chars % 3 + 1 as int))").alias("guess"))
    return r.class_report(x, ["de", "en", "fr"])


@query("a30_volume_buckets", f"WITH {_CAL}, x AS (SELECT *, (doc_id % 101)::DOUBLE AS imp FROM cal), c AS (SELECT quantile_cont(imp, 1.0/3) AS lo, quantile_cont(imp, 2.0/3) AS hi FROM x WHERE split = 'dev' AND imp > 0) SELECT CASE WHEN NOT imp > 0 THEN 'none' WHEN imp <= lo THEN 'low' WHEN imp <= hi THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, count(*) FILTER (WHERE target) AS positive FROM x CROSS JOIN c GROUP BY 1")
def _(spark, d):
    x = r.buckets(_cal(spark, d).withColumn("imp", (F.col("doc_id") % 101).cast("double")), "imp")
    return x.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("target").alias("positive"))


@query("a32_bcubed", "WITH x AS (SELECT p_partkey % 40 AS p, p_partkey % 60 AS t FROM part), o AS (SELECT p, t, count(*)::DOUBLE AS o FROM x GROUP BY ALL), np AS (SELECT p, count(*)::DOUBLE AS np FROM x GROUP BY p), nt AS (SELECT t, count(*)::DOUBLE AS nt FROM x GROUP BY t), z AS (SELECT sum(o * o / np) / sum(o) AS precision, sum(o * o / nt) / sum(o) AS recall FROM o JOIN np USING (p) JOIN nt USING (t)) SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / (precision + recall), 9) AS f1 FROM z")
def _(spark, d):
    x = r.bcubed(table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 40).alias("predicted"), (F.col("p_partkey") % 60).alias("actual")))
    return x.select(*(F.round(c, 9).alias(c) for c in x.columns))


@query("a34_split_counts", f"WITH {_CAL} SELECT method, count(*) FILTER (WHERE split = 'dev') AS dev, count(*) FILTER (WHERE split = 'test') AS test FROM cal GROUP BY method")
def _(spark, d):
    return su.crosstab(_cal(spark, d), "method", "split", ["dev", "test"])


@query("a35_sales_lookup", f"WITH {CUBE} SELECT mp || '::' || art AS raw_record_id, CAST(sum(qty) AS DOUBLE) AS units FROM cube WHERE qty >= 15 AND ck IN ('economy', 'promo', 'standard') GROUP BY 1")
def _(spark, d):
    x = cube(spark, d).where("__category_key in ('economy', 'promo', 'standard')")
    units = n.number_of(x, "Продажи, шт")
    return x.where(units >= 15).groupBy(F.concat_ws("::", t.marketplace_key(F.col("__marketplace_code")), F.col("Артикул")).alias("raw_record_id")).agg(n.exact_sum(units).alias("units"))


@query("j11_sales_attach", "WITH s AS (SELECT l_partkey AS id, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS units FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey AS a, p_partkey + 1 AS b, x.units AS units_a, y.units AS units_b FROM part LEFT JOIN s x ON x.id = p_partkey LEFT JOIN s y ON y.id = p_partkey + 1")
def _(spark, d):
    sales = table(spark, d, "lineitem").where("l_partkey % 2 = 0").groupBy("l_partkey").agg(n.exact_sum(F.col("l_quantity")).alias("units"))
    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return r.with_sales(pairs, sales).select("a", "b", "units_a", "units_b")


@query("n7_pair_weight", "SELECT p_partkey, round(ln(1 + greatest(0, p_size - 10.0, 5.0)), 9) AS w FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(n.pair_weight(F.col("p_size") - 10, F.lit(5)), 9).alias("w"))


@query("m29_freeze_labels", "WITH x AS (SELECT doc_id % 150 AS pair_key, CASE doc_id % 7 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'different' ELSE 'same' END AS label, doc_id % 3 AS priority, doc_id AS row FROM documents), m AS (SELECT * FROM x WHERE label <> 'uncertain'), g AS (SELECT pair_key FROM m GROUP BY pair_key HAVING count(DISTINCT label) = 1) SELECT pair_key, label, row FROM (SELECT *, row_number() OVER (PARTITION BY pair_key ORDER BY priority, row) AS k FROM m) JOIN g USING (pair_key) WHERE k = 1")
def _(spark, d):
    x = table(spark, d, "documents").select((F.col("doc_id") % 150).alias("pair_key"), F.expr("CASE doc_id % 7 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'different' ELSE 'same' END").alias("label"), (F.col("doc_id") % 3).alias("priority"), F.col("doc_id").alias("row"))
    return r.frozen(x)[0].select("pair_key", "label", "row")


@query("w13_stratified_split", "WITH x AS (SELECT doc_id, lang, CAST('0x' || substr(sha256('42:' || doc_id), 1, 12) AS BIGINT) AS o FROM documents), y AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY o, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM x) SELECT doc_id, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * (0.7::DOUBLE + 0.15::DOUBLE), 0) THEN 'dev' ELSE 'test' END AS split FROM y")
def _(spark, d):
    return r.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", ["lang"], {"train": 0.7, "dev": 0.15, "test": 0.15}).select("doc_id", "split")


@query("m30_component_split")
def _(spark, d):
    x = _edges(spark, d)
    return r.component_split(x, {"train": 0.7, "dev": 0.15, "test": 0.15}).select("a", "b", "split")


@query("w12_position_strata", "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY -(n_chars % 97), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= floor(n * 0.1) THEN 'top' WHEN k > n - floor(n * 0.2) THEN 'bottom' ELSE 'middle' END AS position FROM x")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 97).alias("score"))
    return r.position_strata(x, "score", "doc_id", 0.1, 0.2).select("doc_id", "position")


@query("m27_stratified_sample")
def _(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pair_key"), F.col("source").alias("brand"), (F.col("n_chars") % 97).alias("score"))
    return r.sampled(x, {"high": 30, "low": 20, "any": 10}, {"high": F.col("score") > 80, "low": F.col("score") < 10}, 5)


@query("m28_preserve_labels", "WITH x AS (SELECT CAST(doc_id AS VARCHAR) AS pair_key, CASE WHEN doc_id % 5 = 0 THEN 'same' END AS label FROM documents WHERE doc_id < 200), f AS (SELECT CAST(doc_id AS VARCHAR) AS pair_key, CAST('0x' || substr(sha256('42:' || doc_id), 1, 12) AS BIGINT) AS o FROM documents WHERE doc_id >= 150) SELECT pair_key, label FROM x WHERE label IS NOT NULL UNION ALL SELECT pair_key, NULL FROM (SELECT * FROM f WHERE pair_key NOT IN (SELECT pair_key FROM x) ORDER BY o, pair_key LIMIT 60)")
def _(spark, d):
    x = table(spark, d, "documents")
    labels = x.where("doc_id < 200").select(F.col("doc_id").cast("string").alias("pair_key"), F.expr("if(doc_id % 5 = 0, 'same', null)").alias("label"))
    return r.refilled(labels, x.where("doc_id >= 150").select(F.col("doc_id").cast("string").alias("pair_key")), 100).select("pair_key", "label")


@query("o7_round_robin", "SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents) ORDER BY k, lang, doc_id LIMIT 50")
def _(spark, d):
    return r.round_robin(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 50).select("doc_id")


@query("o8_limit_by_split", "SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 12 + CASE WHEN lang IN ('de', 'en') THEN 1 ELSE 0 END")
def _(spark, d):
    return r.limited(table(spark, d, "documents").select("doc_id", F.col("lang").alias("split")), 50, ["doc_id"]).select("doc_id")


@query("w10_cumcount", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long").alias("k"))


# Profiles


@query("a36_profile", "SELECT 'source' AS column, 0.0::DOUBLE AS missing, count(DISTINCT source) AS distinct FROM documents UNION ALL SELECT 'odd', avg(CASE WHEN doc_id % 4 = 0 THEN 1.0 ELSE 0.0 END), count(DISTINCT CASE WHEN doc_id % 4 <> 0 THEN n_chars END) FROM documents")
def _(spark, d):
    return r.profile(table(spark, d, "documents").select("source", F.expr("if(doc_id % 4 = 0, null, n_chars)").alias("odd")), ["source", "odd"])


@query("a38_crosstab", "SELECT p_brand AS brand, count(*) FILTER (WHERE p_size < 20) AS small, count(*) FILTER (WHERE p_size >= 20) AS large FROM part GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.expr("if(p_size < 20, 'small', 'large')").alias("size"))
    return su.crosstab(x, "brand", "size", ["small", "large"])


@query("a39_spearman", "WITH c AS (SELECT p_size AS x, round(p_retailprice / 50) AS y FROM part), rx AS (SELECT x, sum(n) OVER (ORDER BY x) - n + (n + 1) / 2.0 AS a FROM (SELECT x, count(*) AS n FROM c GROUP BY x)), ry AS (SELECT y, sum(n) OVER (ORDER BY y) - n + (n + 1) / 2.0 AS b FROM (SELECT y, count(*) AS n FROM c GROUP BY y)) SELECT round(corr(a::DOUBLE, b::DOUBLE), 9) AS rho FROM c JOIN rx USING (x) JOIN ry USING (y)")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_size").alias("x"), F.round(F.col("p_retailprice") / 50).alias("y"))
    return r.spearman(x, "x", "y").select(F.round("rho", 9).alias("rho"))


@query("a40_anomaly_flags", f"WITH {CUBE} SELECT count(*) FILTER (WHERE qty > 45) AS many, count(*) FILTER (WHERE kg < 0.1) AS light, count(*) FILTER (WHERE rev / qty > 1500) AS dear FROM cube")
def _(spark, d):
    x = cube(spark, d)
    units, money, kg = (n.number_of(x, c) for c in ("Продажи, шт", "Выручка, руб", "Объем, кг"))
    return su.flag_counts(x, {"many": units > 45, "light": kg < 0.1, "dear": money / units > 1500})


@query("a41_monthly_dynamics", "WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT min(month) AS lo, max(month) AS hi, sum(n) AS t FROM c), m AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month, t FROM b) SELECT month, coalesce(n, 0) AS n, coalesce(n, 0) / t AS share, avg(coalesce(n, 0)) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean3 FROM m LEFT JOIN c USING (month)")
def _(spark, d):
    return r.monthly(table(spark, d, "orders"), F.col("o_orderdate"))


@query("a44_record_profile", f"WITH {CUBE} SELECT count(*) AS raw_rows, count(DISTINCT mp || '::' || art) AS records, count(DISTINCT art) AS articles, (SELECT count(*) FROM (SELECT art FROM cube GROUP BY art HAVING count(DISTINCT mp) > 1)) AS shared FROM cube")
def _(spark, d):
    return su.record_profile(cube(spark, d))


@query("a46_score_describe", "SELECT source, count(*) AS n, min(n_chars) AS lo, quantile_cont(n_chars::DOUBLE, 0.5) AS mid, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95, max(n_chars) AS hi FROM documents GROUP BY source")
def _(spark, d):
    return su.described(table(spark, d, "documents"), ["source"], "n_chars", {"mid": 0.5, "p95": 0.95}).withColumn("p95", F.round("p95", 6))


@query("a49_node_score_stats", f"{_TOPK}, p AS (SELECT least(node, other) AS a, greatest(node, other) AS b, round(max(score), 6) AS score FROM k WHERE rank <= 3 AND node <> other GROUP BY 1, 2), z AS (SELECT a AS node, score FROM p UNION ALL SELECT b, score FROM p) SELECT node, count(*) AS edges, max(score) AS best, min(score) AS worst FROM z GROUP BY node")
def _(spark, d):
    x = i.candidate_pairs(i.top_k(_vectors(spark, d), 3)).select(F.col("node_id_a").alias("a"), F.col("node_id_b").alias("b"), F.col("similarity").alias("score"))
    return r.node_scores(x)


@query("a50_top_senders", "SELECT regexp_extract(url, '://([^/]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, domain LIMIT 20")
def _(spark, d):
    return su.top_values(table(spark, d, "pages"), F.regexp_extract("url", "://([^/]+)", 1), "domain", 20)


@query("o6_longest_titles", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def _(spark, d):
    return su.largest(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 15)


# Boards


def _answers(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("team"), F.col("ts").alias("at"), F.lit(1).cast("long").alias("amount"), F.col("event_id").alias("id"), F.col("user_id").alias("voter"), (F.col("user_id") % 40).alias("row_id"))


@query("a42_team_leaderboard", "SELECT event_type AS team, count(*) AS answers, count(DISTINCT user_id % 40) AS rows, row_number() OVER (ORDER BY count(*) DESC, count(DISTINCT user_id % 40) DESC, event_type) AS place FROM events GROUP BY 1")
def _(spark, d):
    return b.leaderboard(_answers(spark, d), "team")


@query("a43_majority_vote", "WITH v AS (SELECT conv_id AS row_id, role AS label, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), w AS (SELECT row_id, arg_min(label, (turn, label)) AS label FROM v WHERE k = 2 GROUP BY row_id), n AS (SELECT DISTINCT row_id, n FROM v) SELECT row_id, CASE WHEN label IS NOT NULL THEN 'done' WHEN n >= 3 THEN 'conflict' ELSE 'open' END AS status, label, n AS votes FROM n LEFT JOIN w USING (row_id)")
def _(spark, d):
    x = table(spark, d, "conversations").select(F.col("conv_id").alias("row_id"), F.col("role").alias("label"), F.col("turn").alias("at"), F.col("turn").alias("voter"))
    return b.majority(x, 2, 3)


@query("a48_lead_change", "WITH s AS (SELECT event_type AS team, count(*) FILTER (WHERE event_id % 2 = 0) AS old, count(*) AS new FROM events GROUP BY 1), x AS (SELECT s.*, (SELECT max(o.old) FROM s o WHERE o.team <> s.team) AS rival FROM s) SELECT * FROM x WHERE new > rival AND old <= rival")
def _(spark, d):
    x = table(spark, d, "events").groupBy(F.col("event_type").alias("team")).agg(F.count_if(F.col("event_id") % 2 == 0).alias("old"), F.count("*").alias("new"))
    return b.lead_changes(x)


@query("t3_combos", "WITH x AS (SELECT event_type AS team, ts, event_id, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) + INTERVAL 5 MINUTE THEN 1 WHEN lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS f FROM events), y AS (SELECT *, CAST(sum(f) OVER (PARTITION BY team ORDER BY ts, event_id) AS BIGINT) AS combo FROM x) SELECT team, combo, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS amount, count(*) AS answers FROM y GROUP BY team, combo")
def _(spark, d):
    return b.combos(_answers(spark, d))


@query("t4_lease_expiry", "WITH n AS (SELECT min(ts) + INTERVAL 12 HOUR AS now FROM events), l AS (SELECT DISTINCT user_id FROM events, n WHERE ts + INTERVAL 30 MINUTE > now AND ts <= now) SELECT c_custkey AS row_id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT user_id FROM l)")
def _(spark, d):
    x = table(spark, d, "events")
    now = x.agg((F.min("ts") + F.expr("interval 12 hours")).alias("now"))
    leases = x.crossJoin(now).where("ts <= now").select(F.col("user_id").alias("row_id"), (F.col("ts") + F.expr("interval 30 minutes")).alias("expires_at"), "now")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.expr("if(c_custkey % 3 = 0, 'same', null)").alias("label"))
    return b.available(rows, leases, F.col("now")).select("row_id")


@query("t5_milestones", "SELECT event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def _(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("team"), (F.col("user_id") % 5).alias("milestone"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return b.claimed(x).select("id")


@query("a13_project_summary", "SELECT n AS project, a.runs, e.tasks FROM (SELECT p_brand AS n FROM part UNION SELECT c_mktsegment FROM customer) LEFT JOIN (SELECT p_brand, count(*) AS runs FROM part GROUP BY 1) a ON a.p_brand = n LEFT JOIN (SELECT c_mktsegment, count(*) AS tasks FROM customer GROUP BY 1) e ON e.c_mktsegment = n")
def _(spark, d):
    parts = {"runs": table(spark, d, "part").groupBy(F.col("p_brand").alias("project")).agg(F.count("*").alias("runs")), "tasks": table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("project")).agg(F.count("*").alias("tasks"))}
    return s.project_summary(parts)


@query("f11_task_filters", "SELECT 'errors' AS view, count(*) FILTER (WHERE event_id % 5 = 0) AS n FROM events UNION ALL SELECT 'ready', count(*) FILTER (WHERE event_id % 3 = 0) FROM events")
def _(spark, d):
    x = table(spark, d, "events").selectExpr("if(event_id % 5 = 0, 'failed', 'ok') AS status", "'done' AS download_status", "'done' AS process_status", "if(event_id % 3 = 0, 'done', 'open') AS save_status")
    one = lambda v: s.filtered_tasks(x, v).agg(F.lit(v).alias("view"), F.count("*").alias("n"))
    return one("errors").union(one("ready"))
