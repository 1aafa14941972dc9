"""Queries on cleaning, names in files, weights, merging, rules and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import numbers as n
from tallyforge.functions import text as t
from tallyforge.functions import weights as w
from tallyforge.operators import etl, rules
from tallyforge.plans.adapter import CUBE, cube, table
from tallyforge.plans.catalog import query
from tallyforge.schema import q
from tallyforge.sources.files import catalog_tasks


@query("p1_upsert_column", "SELECT n_nationkey, 'x' AS mark, n_name FROM nation")
def _(spark, d):
    return etl.upsert_column(table(spark, d, "nation").select("n_nationkey", "n_name"), "mark", "x", 1, False)


@query("p3_filename_marketplace", "SELECT n_nationkey, ['Ozon', 'Wildberries', 'Яндекс.Маркет', 'Unknown', 'Wildberries'][n_nationkey % 5 + 1] AS marketplace FROM nation")
def _(spark, d):
    name = F.expr("element_at(array('report_OZON_1.csv', 'data-wb-2.csv', 'ym_sales.csv', 'other.csv', 'Wildberries 1.csv'), n_nationkey % 5 + 1)")
    return table(spark, d, "nation").select("n_nationkey", etl.filename_marketplace(name).alias("marketplace"))


@query("p4_filename_category", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Unknown' END AS category FROM nation")
def _(spark, d):
    name = F.expr("if(n_nationkey % 2 = 0, 'a__b__' || n_name || '.csv', n_name || '.csv')")
    return table(spark, d, "nation").select("n_nationkey", etl.filename_category(name).alias("category"))


@query("p5_standardize_columns", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand, p_name AS title, CAST(p_size AS VARCHAR) AS units, NULL::VARCHAR AS seller FROM part")
def _(spark, d):
    x = table(spark, d, "part").selectExpr("cast(p_partkey as string) AS id", "p_brand AS brand", "p_name AS Name", "cast(p_size as string) AS sales", "p_retailprice AS final_price_average", "p_retailprice AS Revenue", "1 AS junk")
    return etl.standardise(x, "wb").select(*(F.col(a).alias(b) for a, b in (("SKU", "id"), ("Бренд", "brand"), ("Название", "title"), ("Продажи", "units"), ("Продавец", "seller"))))


@query("p6_merge_rename", "SELECT count(*) AS n_rows, CAST(sum(p_size) AS DOUBLE) AS units FROM part WHERE p_size > 0 AND p_size >= 15 AND p_size < 40000")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("SKU"), F.col("p_size").alias("Продажи"), F.col("p_partkey").alias("_row"))
    rows, _ = etl.merge([x.where("SKU % 2 = 0"), x.where("SKU % 2 = 1").withColumn("Цвет", F.lit("a"))])
    return rows.agg(F.count("*").alias("n_rows"), n.exact_sum(F.col(q("Продажи, шт"))).alias("units"))


@query("a22_merge_file_counts", "SELECT p_partkey % 2 AS file, count(*) AS rows_in, count(*) FILTER (WHERE p_size >= 15) AS rows_kept FROM part GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("SKU"), F.col("p_size").alias("Продажи"), F.col("p_partkey").alias("_row"))
    return etl.merge([x.where("SKU % 2 = 0"), x.where("SKU % 2 = 1")])[1].select(F.col("file").cast("long").alias("file"), "rows_in", "rows_kept")


@query("w1_merge_subset", "SELECT CAST(k AS BIGINT) AS brand_row, b AS brand FROM (SELECT p_brand AS b, min(p_partkey) AS k FROM part WHERE p_size >= 15 GROUP BY 1)")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_brand").alias("Бренд"), F.col("p_partkey").alias("SKU"), F.col("p_size").alias("Продажи"), F.col("p_partkey").alias("_row"))
    return etl.merge([x], keys=["Бренд"])[0].select(F.col("SKU").alias("brand_row"), F.col("Бренд").alias("brand"))


@query("p9_month_label", "SELECT o_orderkey, ['янв.', 'фев.', 'мар.', 'апр.', 'май', 'июн.', 'июл.', 'авг.', 'сен.', 'окт.', 'ноя.', 'дек.'][month(o_orderdate)] AS label FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", etl.month_label(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("label"))


@query("p8_postprocess", "SELECT CAST(p_partkey AS VARCHAR) AS article, p_name AS title, 'мар.' AS month FROM part")
def _(spark, d):
    x = table(spark, d, "part").select(F.lit("05.03.2024").alias("Дата"), F.col("p_partkey").cast("string").alias("SKU"), F.col("p_name").alias("Название"), F.lit(1).alias("Вес аномалия"))
    return etl.postprocessed(x).select(F.col("Артикул").alias("article"), F.col("SKU").alias("title"), F.col("месяц").alias("month"))


@query("p10_weight_alias", "SELECT p_partkey, p_size AS unit, p_size * 2 AS total FROM part")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("Вес, кг"), (F.col("p_size") * 2).alias("Вес, кг (сумм.)"))
    return etl.weight_names(x).select("p_partkey", F.col("`Вес, кг (ед.)`").alias("unit"), F.col("`Вес, кг`").alias("total"))


@query("p17_flatten_value", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'a: 1; b: 2' END AS x, 'p, ' || n_name AS y FROM nation")
def _(spark, d):
    m = F.expr("if(n_nationkey % 2 = 0, map('name', n_name, 'z', '1'), map('a', '1', 'b', '2'))")
    return table(spark, d, "nation").select("n_nationkey", etl.flattened(m, "map").alias("x"), etl.flattened(F.array(F.lit("p"), F.col("n_name")), "list").alias("y"))


@query("s10_catalog_scan", "SELECT n_name AS name, n_name || '/a' AS path, 0 AS slot FROM nation UNION ALL SELECT n_name, n_name || '/b', 1 FROM nation WHERE n_nationkey % 2 = 0")
def _(spark, d):
    x = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.expr("n_name || '/a '").alias("Путь"), F.expr("if(n_nationkey % 2 = 0, n_name || '/b', ' ')").alias("Путь2"), F.lit("f").alias("Фильтр"))
    return catalog_tasks(x).select("name", "path", "slot")


@query("x1_weight_text", "SELECT p_partkey, lower(p_name) || ' 1.5 л' AS x FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", t.weight_text(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" 1,5 Л "))).alias("x"))


@query("g6_derived_metrics", "SELECT p_partkey, CAST(0.5 AS DOUBLE) AS unit, CAST(0.5 * (p_size % 5 + 2) AS DOUBLE) AS total, CAST(p_size * 0.5 * (p_size % 5 + 2) AS DOUBLE) AS kg, 2024 AS year FROM part")
def _(spark, d):
    x = table(spark, d, "part").select(
        F.lit("05.03.2024").alias("Дата"), F.lit("c").alias("Категория"), F.col("p_partkey").cast("string").alias("SKU"), F.col("p_brand").alias("Бренд"), F.concat(F.col("p_name"), F.lit(" 500 г x "), (F.col("p_size") % 5 + 2).cast("string")).alias("Название"),
        F.col("p_size").cast("string").alias("Продажи"), F.lit("100,5").alias("Средняя цена"),
    )
    y = w.with_weights(x)
    return y.select(F.col("SKU").cast("long").alias("p_partkey"), F.col("`Вес, кг (ед.)`").alias("unit"), F.col("`Вес, кг`").alias("total"), F.col("`Объем, кг`").alias("kg"), F.col("Год").alias("year"))


@query("g4_extract_weight", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 0.5 WHEN 1 THEN 0.01 WHEN 2 THEN 1.5 WHEN 3 THEN 0.175 WHEN 4 THEN 0.6 WHEN 5 THEN 0.25 WHEN 6 THEN NULL ELSE 0.5 END::DOUBLE AS unit,
 round(CASE p_partkey % 8 WHEN 0 THEN 0.5 * (p_size + 1) WHEN 1 THEN 0.01 * (p_size + 1) WHEN 2 THEN 1.5 * (p_size + 1) WHEN 3 THEN 0.175 * (p_size + 1) WHEN 4 THEN 0.6 * (p_size + 1) WHEN 5 THEN 0.25 WHEN 6 THEN NULL ELSE 0.5 * 2 + 0.25 * 3 END::DOUBLE, 6) AS total FROM part""")
def _(spark, d):
    shapes = ["n || 'x500 г'", "'10 mg, 10 г*' || n || ' шт'", "n || ' по 1,5 л'", "n || ' шт. - 175 грамм'", "'600 мл, комплект: ' || n || ' упаковок'", "'250 миллилитров, 100млн'", "'из ' || n || ' штук'", "'2x500 г и 250 мл × 3'"]
    title = F.expr("element_at(array(" + ", ".join(f"p_name || ', ' || {x}" for x in shapes) + "), cast(p_partkey % 8 + 1 as int))")
    x = table(spark, d, "part").withColumn("n", (F.col("p_size") + 1).cast("string")).select("p_partkey", w.title_weights(title).alias("w"))
    return x.select(F.col("p_partkey"), F.col("w.unit").alias("unit"), F.round("w.total", 6).alias("total"))


@query("g5_sanitize", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1.74 WHEN 1 THEN 0.5 WHEN 4 THEN 2.5 WHEN 5 THEN 1.5 END::DOUBLE AS unit, p_partkey % 6 <> 4 AS odd,
 ['fixed_liters_174-> 1.74', 'fixed_long_ml_1000500-> 0.5kg', 'too_big>40.0kg_no_fix', 'empty_or_bad', 'ok', 'fixed_long_ml_2001500-> 1.5kg'][p_partkey % 6 + 1] AS why FROM part""")
def _(spark, d):
    title = F.expr("p_name || element_at(array(' 174л', ' 1000500 мл', ' 41 кг', ' 41', ' 2,5 кг', ' 2001500ml'), cast(p_partkey % 6 + 1 as int))")
    return table(spark, d, "part").select("p_partkey", w.title_weights(title).alias("w")).select("p_partkey", "w.unit", "w.odd", "w.why")


@query("x14_family_title", f"WITH {CUBE} SELECT DISTINCT art AS article, CASE CAST(art AS BIGINT) % 5 WHEN 3 THEN 'Big Widgets' WHEN 4 THEN sku || ' 5% off' ELSE sku END AS title FROM cube")
def _(spark, d):
    x = cube(spark, d).select("Артикул", "SKU").distinct()
    shapes = ["SKU || ', 500 мл, 6 шт'", "'набор: 3 штуки ' || SKU || ' - 1,5 кг'", "'Acme-Pro, ' || SKU || ' — ACME PRO 12 штук'", "'Widgets, big, extra virgin, 20 шт'", "SKU || ' 5% off, 2 л'"]
    title = w.family_title_column(F.expr("element_at(array(" + ", ".join(shapes) + "), cast(cast(`Артикул` as long) % 5 as int) + 1)"), F.lit("acme pro"), F.lit("Big Widgets"))
    return x.select(F.col("Артикул").alias("article"), title.alias("title"))


_RULES = [
    {"match_field": "SKU", "match_type": "contains", "pattern": "RED", "target_column": "Тип", "set_value": "red", "mode": "fill_empty", "priority": "1"},
    {"match_field": "Бренд", "match_type": "regex", "pattern": "brand#1[23]", "target_column": "Тип", "set_value": "brand", "mode": "overwrite", "priority": "2"},
    {"match_field": "Тип", "match_type": "equals", "pattern": " BRAND ", "target_column": "Вид", "set_value": "own", "mode": "fill_empty", "priority": "3"},
    {"match_field": "Продажи, шт", "match_type": "gte", "pattern": "40", "target_column": "Сегмент", "set_value": "big", "mode": "fill_empty", "priority": "4", "category": "promo|LARGE"},
    {"match_field": "", "match_type": "otherwise", "pattern": "", "target_column": "Тип", "set_value": "rest", "mode": "overwrite", "priority": "9"},
    {"match_field": "SKU", "match_type": "contains", "pattern": "blue", "target_column": "Вид", "set_value": "mix", "mode": "fill_empty", "priority": "5", "conditions_json": '[{"join_with_prev": "or", "match_field": "SKU", "match_type": "startswith", "pattern": "green"}, {"join_with_prev": "and", "match_field": "Бренд", "match_type": "not_contains", "pattern": "#2"}]'},
]
_CLASS = """r1 AS (SELECT *, CASE WHEN lower(sku) LIKE '%red%' THEN 'red' END AS t1 FROM cube), r2 AS (SELECT *, CASE WHEN regexp_matches(lower(brand), 'brand#1[23]') THEN 'brand' ELSE t1 END AS t2 FROM r1),
 r3 AS (SELECT *, CASE WHEN t2 = 'brand' THEN 'own' WHEN (lower(sku) LIKE '%blue%' OR sku LIKE 'green%') AND brand NOT LIKE '%#2%' THEN 'mix' END AS vid, CASE WHEN qty >= 40 AND lower(cat) IN ('promo', 'large') THEN 'big' END AS seg, coalesce(t2, 'rest') AS tip FROM r2)"""


def _classified(spark, d, **kw):
    rows = [{"active": "1", "category": "", "comment": ""} | r for r in _RULES]
    return rules.apply(cube(spark, d), rules.compiled(rows), **kw)


@query("c6_rule_classifier", f"WITH {CUBE}, {_CLASS} SELECT rid, tip AS kind, vid AS variety, seg AS segment FROM r3")
def _(spark, d):
    x = _classified(spark, d)
    return x.select(F.col("__row_hash").alias("rid"), F.col("Тип").alias("kind"), F.col("Вид").alias("variety"), F.col("Сегмент").alias("segment"))


@query("c8_fill_unclassified", f"WITH {CUBE}, {_CLASS} SELECT coalesce(seg, 'none') AS segment, count(*) AS n_rows FROM r3 GROUP BY 1")
def _(spark, d):
    return _classified(spark, d, fill={"Сегмент": "none"}).groupBy(F.col("Сегмент").alias("segment")).agg(F.count("*").alias("n_rows"))


@query("c9_rule_report", f"WITH {CUBE}, {_CLASS} SELECT 1 AS rule, count(*) FILTER (WHERE t1 IS NOT NULL) AS applied FROM r3 UNION ALL SELECT 2, count(*) FILTER (WHERE regexp_matches(lower(brand), 'brand#1[23]')) FROM r3 UNION ALL SELECT 3, count(*) FILTER (WHERE t2 = 'brand') FROM r3 UNION ALL SELECT 4, count(seg) FROM r3 UNION ALL SELECT 5, count(*) FILTER (WHERE t2 IS NULL) FROM r3 UNION ALL SELECT 6, count(*) FILTER (WHERE vid = 'mix') FROM r3")
def _(spark, d):
    rows = rules.compiled([{"active": "1", "category": ""} | r for r in _RULES])
    return rules.rule_report(_classified(spark, d, report=True), rows).select("rule", "applied")


@query("a26_empty_share", f"WITH {CUBE}, {_CLASS} SELECT avg(CASE WHEN vid IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS variety, avg(CASE WHEN seg IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS segment FROM r3")
def _(spark, d):
    return rules.empty_share(_classified(spark, d), ["Вид", "Сегмент"]).toDF("variety", "segment")


@query("c10_manual_overrides", f"WITH {CUBE} SELECT rid, CASE WHEN brand = 'Brand#12' THEN 'by brand' WHEN art = '77' THEN 'by article' END AS kind FROM cube")
def _(spark, d):
    fixes = [{"match_field": "SKU", "match_value": "77", "target_column": "Тип", "set_value": "by article", "mode": "overwrite", "priority": "1"}, {"match_field": "Бренд", "match_value": " BRAND#12", "target_column": "Тип", "set_value": "by brand", "mode": "overwrite", "priority": "2"}]
    return rules.override(cube(spark, d), fixes).select(F.col("__row_hash").alias("rid"), F.col("Тип").alias("kind"))


@query("c13_output_diff", "SELECT 'n_name' AS column, count(*) FILTER (WHERE n_nationkey % 5 = 0) AS differences FROM nation UNION ALL SELECT 'n_regionkey', 0 FROM (SELECT 1)")
def _(spark, d):
    x = table(spark, d, "nation")
    return rules.differences(x, x.withColumn("n_name", F.expr("if(n_nationkey % 5 = 0, null, n_name)")), "n_nationkey")
