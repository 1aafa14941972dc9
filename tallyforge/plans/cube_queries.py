"""Queries on the cube: reports, exports, predicates, joins, windows and maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import numbers as n
from tallyforge.functions import text as t
from tallyforge.operators import cube as c
from tallyforge.operators import exports as e
from tallyforge.operators import reports as r
from tallyforge.operators import summaries as su
from tallyforge.operators.identity import numbered
from tallyforge.plans.adapter import CUBE, PROJECT, cube, table
from tallyforge.plans.catalog import query
from tallyforge.schema import q, visible

_ASCII = {
    "Период": "period", "Год": "year", "Месяц": "month", "Маркетплейс": "marketplace", "Категория": "category", "Бренд": "brand", "Подкатегория": "subcategory", "SKU": "title", "Строк": "n_rows", "SKU, шт": "n_titles",
    "Продажи, шт": "units", "Выручка, руб": "revenue", "Объем, кг": "kg", "Средняя цена, руб": "price", "Цена за кг, руб": "price_kg", "Артикул": "article",
}


def _ascii(df):
    return df.select(*(F.col(q(x)).alias(_ASCII.get(x, x.strip("_"))) for x in df.columns))


_METRICS = """count(*) AS n_rows, count(DISTINCT sku) AS n_titles, CAST(sum(qty) AS DOUBLE) AS units, CAST(sum(rev) AS DOUBLE) AS revenue, CAST(sum(kg) AS DOUBLE) AS kg,
 CASE WHEN sum(qty) > 0 THEN CAST(sum(rev) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) END AS price, CASE WHEN sum(kg) > 0 THEN CAST(sum(rev) AS DOUBLE) / CAST(sum(kg) AS DOUBLE) END AS price_kg"""
_DIMS = "printf('%04d-%02d', y, mo) AS period, y AS year, mo AS month, market AS marketplace, cat AS category"


def _report_sql(extra: str = "", where: str = "", tail: str = "") -> str:
    return f"WITH {CUBE} SELECT {_DIMS}{extra}, {_METRICS} FROM cube {where} GROUP BY ALL {tail}"


@query("a1_report_category_month", _report_sql())
def _(spark, d):
    spec = r.ReportSpec("category_month", PROJECT)
    return _ascii(r.ordered(r.report(cube(spark, d), spec), spec))


@query("a2_report_brand_month", _report_sql(", brand", "WHERE y * 12 + mo BETWEEN 1996 * 12 + 1 AND 1996 * 12 + 6"))
def _(spark, d):
    spec = r.ReportSpec("brand_month", PROJECT, first=1996 * 12 + 1, last=1996 * 12 + 6)
    return _ascii(r.ordered(r.report(cube(spark, d), spec), spec))


@query("a3_report_classification_month", _report_sql(", sub AS subcategory", "WHERE y = 1997"))
def _(spark, d):
    spec = r.ReportSpec("classification_month", PROJECT, first=1997 * 12 + 1, last=1997 * 12 + 12)
    return _ascii(r.ordered(r.report(cube(spark, d), spec), spec))


@query(
    "a4_report_top_sku",
    f"WITH {CUBE} SELECT {_DIMS}, sku AS title, brand, sub AS subcategory, {_METRICS} FROM cube GROUP BY ALL ORDER BY revenue DESC NULLS LAST, units DESC NULLS LAST, period, year, month, marketplace, category, title, brand, subcategory LIMIT 500",
)
def _(spark, d):
    spec = r.ReportSpec("top_sku", PROJECT, rows=500)
    return _ascii(r.ordered(r.report(cube(spark, d), spec), spec))


@query("a5_dimension_text", "SELECT coalesce(nullif(trim(CASE WHEN n_nationkey % 3 = 0 THEN '  ' WHEN n_nationkey % 3 = 1 THEN ' ' || n_name || ' ' END), ''), CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'Не заполнено') AS name, n_nationkey FROM nation")
def _(spark, d):
    x = table(spark, d, "nation")
    dirty = F.expr("CASE WHEN n_nationkey % 3 = 0 THEN '  ' WHEN n_nationkey % 3 = 1 THEN ' ' || n_name || ' ' END")
    return x.select(t.dimension(dirty, F.expr("CASE WHEN n_nationkey % 2 = 0 THEN n_name END")).alias("name"), "n_nationkey")


@query("a6_volume_fallback", f"WITH {CUBE} SELECT cat AS category, CAST(sum(kg) AS DOUBLE) AS kg, CAST(sum(CAST(CAST(qty AS DOUBLE) / 8 * 1000 AS DECIMAL(38,6))) AS DOUBLE) AS from_tonnes, CAST(0 AS DOUBLE) AS none FROM cube GROUP BY cat")
def _(spark, d):
    x = cube(spark, d)
    tonnes = x.withColumn("Объем, т", (n.num(F.col(q("Продажи, шт"))) / 8).cast("string"))
    return tonnes.groupBy(F.col("Категория").alias("category")).agg(
        n.exact_sum(r.volume_kg(x.columns)).alias("kg"), n.exact_sum(r.volume_kg(["Объем, т"])).alias("from_tonnes"), n.exact_sum(r.volume_kg([])).alias("none")
    )


@query("a7_export_breakdown", f"WITH {CUBE} SELECT y AS year, mo AS month, ck AS category_key, mp AS marketplace_code, count(*) AS rows, min(cat) AS category, min(market) AS marketplace FROM cube GROUP BY ALL")
def _(spark, d):
    return _ascii(r.breakdown(cube(spark, d), PROJECT))


@query("a8_export_categories", f"WITH {CUBE} SELECT ck AS category_key, mp AS marketplace_code, count(*) AS rows, min(cat) AS category, min(market) AS marketplace FROM cube GROUP BY ALL")
def _(spark, d):
    return _ascii(r.categories(cube(spark, d), PROJECT))


@query("a9_period_bounds", f"WITH {CUBE} SELECT min(y * 12 + mo) AS first_index, max(y * 12 + mo) AS last_index, count(*) AS rows FROM cube")
def _(spark, d):
    return r.period_bounds(cube(spark, d), PROJECT)


_REGISTRY = f"WITH {CUBE}, reg AS (SELECT y, mo, mp, ck, min(cat) AS cat, count(*) AS n FROM cube GROUP BY y, mo, mp, ck)"


def _registry(spark, d):
    x = r.breakdown(cube(spark, d), PROJECT)
    return x.select(F.lit(PROJECT).alias("__project_name"), "__year", "__month", "__marketplace_code", "__category_key", F.col("category").alias("category_name"), F.col("rows").alias("rows_count"))


@query(
    "a10_large_category_flags",
    f"{_REGISTRY}, f AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ck) AS BIGINT) AS tot FROM reg) SELECT y AS year, mo AS month, mp AS marketplace_code, ck AS category_key, n AS rows_count, tot AS category_rows, n >= 40 OR tot >= 10000 AS is_heavy,"
    " nullif(concat_ws('; ', CASE WHEN n >= 40 THEN 'slice rows ' || n END, CASE WHEN tot >= 10000 THEN 'category rows ' || tot END), '') AS heavy_reason FROM f",
)
def _(spark, d):
    return _ascii(c.heavy_flags(_registry(spark, d), 40, 10_000).drop("__project_name", "category_name"))


@query("a11_large_category_summary", f"{_REGISTRY}, f AS (SELECT *, sum(n) OVER (PARTITION BY ck) AS tot FROM reg) SELECT ck AS category_key, count(*) AS slices, CAST(sum(n) AS BIGINT) AS rows, max(n) AS largest, bool_or(n >= 40 OR tot >= 10000) AS is_heavy FROM f GROUP BY ck")
def _(spark, d):
    return _ascii(c.heavy_summary(c.heavy_flags(_registry(spark, d), 40, 10_000)))


@query("a12_eligible_categories", f"{_REGISTRY} SELECT split_part(cat, ' ', 1) AS grp, string_agg(DISTINCT ck, ',' ORDER BY ck) AS keys, string_agg(DISTINCT mp, ',' ORDER BY mp) AS marketplaces, CAST(sum(n) AS BIGINT) AS rows, min(y * 12 + mo) AS first_index, max(y * 12 + mo) AS last_index FROM reg GROUP BY 1")
def _(spark, d):
    from tallyforge.operators.identity import category_groups

    x = _registry(spark, d).withColumn("grp", F.substring_index("category_name", " ", 1))
    return category_groups(x, "grp")


@query("a14_run_counts", "SELECT event_type AS run_id, count(*) AS tasks, count(*) FILTER (WHERE user_id % 3 = 0) AS failed, count(*) FILTER (WHERE user_id % 3 = 1) AS done FROM events GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("run_id"), F.expr("element_at(array('failed', 'done', 'open'), cast(user_id % 3 + 1 as int))").alias("status"))
    from tallyforge.operators.state import run_counts

    return run_counts(x)


@query("a15_task_summary", f"WITH {CUBE} SELECT count(DISTINCT ck) AS categories, count(DISTINCT y * 12 + mo) AS months, count(DISTINCT mp) AS marketplaces FROM cube")
def _(spark, d):
    return su.task_summary(cube(spark, d))


@query("a23_duplicate_hash_audit", f"WITH {CUBE} SELECT CAST(sum(k - 1) AS BIGINT) AS extra_rows, count(*) AS repeated FROM (SELECT art, mp, y, mo, count(*) AS k FROM cube GROUP BY ALL HAVING count(*) > 1)")
def _(spark, d):
    from tallyforge.operators.state import repeated

    return repeated(cube(spark, d), ["Артикул", "__marketplace_code", "__year", "__month"])


@query("a24_group_report", f"WITH {CUBE} SELECT y AS year, mo AS month, cat AS category, market AS marketplace, count(*) AS n_rows, CAST(sum(qty) AS DOUBLE) AS units, CAST(sum(rev) AS DOUBLE) AS revenue FROM cube WHERE mp IN ('asia', 'europe') AND y BETWEEN 1996 AND 1997 GROUP BY ALL")
def _(spark, d):
    x = cube(spark, d).where("__marketplace_code in ('asia', 'europe') and __year between 1996 and 1997")
    return su.group_totals(x, {"year": "__year", "month": "__month", "category": "Категория", "marketplace": "Маркетплейс"})


@query("a25_single_value", f"WITH {CUBE} SELECT ck AS category_key, CASE WHEN count(DISTINCT lower(trim(cat))) = 1 THEN min(cat) END AS one, CASE WHEN count(DISTINCT lower(trim(brand))) = 1 THEN min(brand) END AS many FROM cube GROUP BY ck")
def _(spark, d):
    from tallyforge.operators.state import single_value

    return cube(spark, d).groupBy(F.col("__category_key").alias("category_key")).agg(single_value("Категория").alias("one"), single_value("Бренд").alias("many"))


@query("a47_latest_month", f"WITH {CUBE} SELECT ck AS category_key, max(y * 12 + mo) // 12 AS label_year, max(y * 12 + mo) AS idx FROM (SELECT ck, y, mo - 1 AS mo FROM cube) GROUP BY ck")
def _(spark, d):
    x = cube(spark, d).withColumn("i", F.expr("__year * 12 + __month - 1"))
    return su.latest(x, ["__category_key"], "__year", "i").toDF("category_key", "label_year", "idx")


@query("a51_filtered_count", f"WITH {CUBE} SELECT count(*) AS rows FROM cube WHERE qty BETWEEN 10 AND 20 AND brand = 'Brand#12'")
def _(spark, d):
    f = [{"column": "Продажи, шт", "match": "gte", "value": "10"}, {"column": "Продажи, шт", "match": "lte", "value": "20,0"}, {"column": "Бренд", "match": "equals", "value": "Brand#12"}]
    return e.filtered(cube(spark, d), f).agg(F.count("*").alias("rows"))


@query("f1_positive_import_filter", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'bad' WHEN o_orderkey % 5 = 1 THEN '0' ELSE '1 0' || (o_orderkey % 7) || ',5' END AS units FROM orders WHERE o_orderkey % 5 > 1 AND o_orderkey % 3 > 0")
def _(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'bad' WHEN o_orderkey % 5 = 1 THEN '0' ELSE '1 0' || (o_orderkey % 7) || ',5' END").alias("Продажи"), F.expr("cast(o_orderkey % 3 as string)").alias("Объем, т"))
    return c.positive_rows(x).select("o_orderkey", F.col("Продажи").alias("units"))


@query("f2_min_sales_filter", f"WITH {CUBE} SELECT rid FROM cube WHERE qty >= 15")
def _(spark, d):
    return c.min_sales(cube(spark, d)).select(F.col("__row_hash").alias("rid"))


@query("f3_sales_quantile_filter", f"WITH {CUBE}, p AS (SELECT ck, quantile_cont(CAST(qty AS DOUBLE), 0.8) AS cut FROM cube WHERE qty > 0 GROUP BY ck) SELECT rid FROM cube JOIN p USING (ck) WHERE qty > 0 AND CAST(qty AS DOUBLE) >= greatest(cut, 15)")
def _(spark, d):
    return c.sales_quantile(cube(spark, d), 0.8, 15, ["__category_key"]).select(F.col("__row_hash").alias("rid"))


@query("f4_sales_range_filter", f"WITH {CUBE} SELECT rid FROM cube WHERE qty > 0 AND qty >= 20 AND qty < 40")
def _(spark, d):
    from tallyforge.operators.etl import sales_range

    return sales_range(cube(spark, d), 20, 40).select(F.col("__row_hash").alias("rid"))


_F5 = {
    "contains": ("SKU", "WID", "lower(sku) LIKE '%wid%'"),
    "not_contains": ("SKU", "red", "NOT coalesce(lower(sku) LIKE '%red%', FALSE)"),
    "startswith": ("Бренд", "brand#1", "lower(brand) LIKE 'brand#1%'"),
    "equals": ("Бренд", "Brand#23", "brand = 'Brand#23'"),
    "gt": ("Продажи, шт", "30,5", "qty > 30.5"),
    "gte": ("Продажи, шт", "30", "qty >= 30"),
    "lt": ("Продажи, шт", "5", "qty < 5"),
    "lte": ("Продажи, шт", "5", "qty <= 5"),
}
for _match, (_column, _value, _where) in _F5.items():

    @query(f"f5_filter_{_match}", f"WITH {CUBE} SELECT rid, brand FROM cube WHERE {_where}")
    def _(spark, d, m=_match, col=_column, v=_value):
        f = [{"column": col, "match": m, "value": v}, {"column": "__year", "match": "equals", "value": "0"}, {"column": "Бренд", "match": "equals", "value": " "}]
        return e.filtered(cube(spark, d), f).select(F.col("__row_hash").alias("rid"), F.col("Бренд").alias("brand"))


@query("f6_scope_predicate", f"WITH {CUBE} SELECT rid FROM cube WHERE ck IN ('economy', 'promo') AND y * 12 + mo BETWEEN 1995 * 12 + 11 AND 1996 * 12 + 2")
def _(spark, d):
    return r.in_scope(cube(spark, d), PROJECT, ["economy", "promo"], 1995 * 12 + 11, 1996 * 12 + 2).select(F.col("__row_hash").alias("rid"))


@query("f7_hash_exclusion", f"WITH {CUBE} SELECT rid FROM cube WHERE rid NOT IN (SELECT rid FROM cube ORDER BY rid LIMIT 3)")
def _(spark, d):
    x = cube(spark, d)
    three = [r[0] for r in x.select("__row_hash").orderBy("__row_hash").limit(3).collect()]
    return e.filtered(x, excluded_hashes=three).select(F.col("__row_hash").alias("rid"))


@query("f8_search", f"WITH {CUBE} SELECT rid, sku AS title FROM cube WHERE lower(sku) LIKE '%blue%' OR lower(brand) LIKE '%blue%' OR lower(art) LIKE '%blue%' OR lower(cat) LIKE '%blue%' ORDER BY y DESC, mo DESC, rid LIMIT 100 OFFSET 50")
def _(spark, d):
    x = e.search(cube(spark, d), " Blue ").orderBy(F.desc("__year"), F.desc("__month"), "__row_hash")
    return e.page(x, 100, 50).select(F.col("__row_hash").alias("rid"), F.col("SKU").alias("title"))


@query("f10_active_in_month", "SELECT c_custkey FROM customer WHERE (c_custkey % 4 = 0 OR '1996-0' || (c_custkey % 9 + 1) <= '1996-05') AND (c_custkey % 3 = 0 OR '1996-0' || (c_custkey % 8 + 2) >= '1996-05')")
def _(spark, d):
    from tallyforge.operators.state import active_in

    x = table(spark, d, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 4 <> 0 THEN '1996-0' || (c_custkey % 9 + 1) END").alias("active_from"), F.expr("CASE WHEN c_custkey % 3 <> 0 THEN '1996-0' || (c_custkey % 8 + 2) END").alias("active_to"))
    return active_in(x, F.lit("1996-05")).select("c_custkey")


@query("f12_empty_test", "SELECT n_nationkey, n_nationkey % 3 < 2 AS empty FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", t.is_empty(F.expr("CASE WHEN n_nationkey % 3 = 0 THEN '  \t' WHEN n_nationkey % 3 = 2 THEN n_name END")).alias("empty"))


@query("f14_null_safe_equality", "SELECT count(*) AS same FROM nation a JOIN nation b ON nullif(a.n_regionkey, 0) IS NOT DISTINCT FROM nullif(b.n_regionkey, 0)")
def _(spark, d):
    x = table(spark, d, "nation").select(F.expr("nullif(n_regionkey, 0)").alias("a"))
    return x.join(x.toDF("b"), su.same(F.col("a"), F.col("b"))).agg(F.count("*").alias("same"))


@query("j1_anti_row_hash", f"WITH {CUBE} SELECT DISTINCT rid FROM cube WHERE y = 1998 AND rid NOT IN (SELECT rid FROM cube WHERE brand = 'Brand#11')")
def _(spark, d):
    x = cube(spark, d)
    return c.unseen(x.where("__year = 1998"), x.where(F.col("Бренд") == "Brand#11")).select(F.col("__row_hash").alias("rid"))


@query("j2_anti_business_hash", f"WITH {CUBE} SELECT rid FROM cube a WHERE a.y = 1998 AND NOT EXISTS (SELECT 1 FROM cube b WHERE b.ck = 'promo' AND b.y = a.y AND b.mo = a.mo AND b.mp = a.mp AND b.brand = a.brand)")
def _(spark, d):
    x = cube(spark, d).withColumn("__business_row_hash", F.col("Бренд"))
    return c.unseen(x.where("__year = 1998"), x.where("__category_key = 'promo'"), business=True).select(F.col("__row_hash").alias("rid"))


@query("j3_group_join", f"WITH {CUBE}, g AS (SELECT DISTINCT ck, mp, art, 'fam-' || (CAST(art AS BIGINT) % 50) AS fam FROM cube WHERE CAST(art AS BIGINT) % 2 = 0) SELECT fam, count(*) AS n_rows, CAST(sum(qty) AS DOUBLE) AS units FROM cube LEFT JOIN g USING (ck, mp, art) GROUP BY fam")
def _(spark, d):
    x = cube(spark, d)
    g = x.where("cast(`Артикул` as long) % 2 = 0").select(F.lit(PROJECT).alias("project_name"), F.col("__category_key").alias("category_key"), F.col("__marketplace_code").alias("marketplace_code"), F.col("Артикул").alias("article")).distinct()
    g = g.withColumn("fam", F.expr("'fam-' || (cast(article as long) % 50)"))
    return e.with_groups(x, g).groupBy("fam").agg(F.count("*").alias("n_rows"), n.exact_sum(n.num(F.col(q("Продажи, шт")))).alias("units"))


@query("j8_delete_slices", f"WITH {CUBE} SELECT y AS year, mp AS marketplace_code, count(*) AS n_rows FROM cube WHERE NOT (ck = 'promo' AND mp = 'asia') GROUP BY ALL")
def _(spark, d):
    x = cube(spark, d)
    keys = x.where("__category_key = 'promo' and __marketplace_code = 'asia'").select("__project_name", "__year", "__month", "__marketplace_code", "__category_key").distinct()
    return _ascii(c.without_slices(x, keys).groupBy("__year", "__marketplace_code").agg(F.count("*").alias("n_rows")))


@query("j19_plan_lookup", f"{_REGISTRY}, p AS (SELECT DISTINCT y, mo, m.mp, ck FROM reg CROSS JOIN (SELECT DISTINCT mp FROM reg) m) SELECT p.y AS year, p.mo AS month, p.mp AS marketplace_code, p.ck AS category_key, reg.n IS NOT NULL AS in_cube, reg.n AS rows_count FROM p LEFT JOIN reg ON p.y = reg.y AND p.mo = reg.mo AND p.mp = reg.mp AND p.ck = reg.ck")
def _(spark, d):
    return _ascii(su.plan_lookup(_registry(spark, d)))


@query("j20_category_month_plan", "SELECT DISTINCT p_type AS category, printf('%04d-%02d', 1995 + CAST(i // 12 AS INTEGER), CAST(i % 12 + 1 AS INTEGER)) AS period FROM part, range(30) t(i) WHERE printf('%04d-%02d', 1995 + CAST(i // 12 AS INTEGER), CAST(i % 12 + 1 AS INTEGER)) >= '1995-04' AND length(p_type) % 2 = 0 OR i >= 24")
def _(spark, d):
    from tallyforge.operators.state import active_in, month_plan

    x = table(spark, d, "part").select(F.col("p_type").alias("category")).distinct().withColumn("active_from", F.expr("if(length(category) % 2 = 0, '1995-04', '1997-01')")).withColumn("active_to", F.lit(None).cast("string"))
    return active_in(month_plan(x, (1995, 1), (1997, 6)), F.col("period")).select("category", "period")


@query("w1_merge_dedup", f"WITH {CUBE} SELECT rid, art AS article FROM (SELECT *, row_number() OVER (PARTITION BY art, mp ORDER BY mp, ok, ln, rid) AS k FROM cube) WHERE k = 1")
def _(spark, d):
    from tallyforge.operators.etl import first_of_each

    x = cube(spark, d).withColumn("ok", F.expr("cast(substring_index(__row_hash, '-', 1) as long)")).withColumn("ln", F.expr("cast(split(__row_hash, '-')[1] as int)"))
    return first_of_each(x, ["Артикул", "__marketplace_code"], ["__marketplace_code", "ok", "ln", "__row_hash"]).select(F.col("__row_hash").alias("rid"), F.col("Артикул").alias("article"))


@query("w2_stage_hash_dedup", f"WITH {CUBE} SELECT sha1(concat_ws('|', market, cat, sku, brand)) AS h FROM cube GROUP BY 1")
def _(spark, d):
    return cube(spark, d).withColumn("__row_hash", F.sha1(F.concat_ws("|", "Маркетплейс", "Категория", "SKU", "Бренд"))).dropDuplicates(["__row_hash"]).select(F.col("__row_hash").alias("h"))


_RUNS = "runs AS (SELECT event_id AS run_id, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'succeeded' END AS status, event_type AS project, CAST(user_id % 10 AS VARCHAR) AS category, ts AS created_at, CASE WHEN event_id % 3 > 0 THEN ts END AS finished_at FROM events)"


def _runs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.expr("if(event_id % 4 = 0, 'failed', 'succeeded')").alias("status"), F.col("event_type").alias("project"), F.expr("cast(user_id % 10 as string)").alias("category"), F.col("ts").alias("created_at"), F.expr("if(event_id % 3 > 0, ts, null)").alias("finished_at"))


@query("w3_latest_successful_run", f"WITH {_RUNS} SELECT project, category, run_id FROM (SELECT *, row_number() OVER (PARTITION BY project, category ORDER BY coalesce(finished_at, created_at) DESC, created_at DESC, run_id DESC) AS k FROM runs WHERE status = 'succeeded') WHERE k = 1")
def _(spark, d):
    return c.latest_runs(_runs(spark, d), "succeeded").select("project", "category", "run_id")


@query("w4_prune_failed_runs", f"WITH {_RUNS} SELECT run_id FROM (SELECT *, row_number() OVER (PARTITION BY project, category ORDER BY coalesce(finished_at, created_at) DESC, created_at DESC, run_id DESC) AS k FROM runs WHERE status = 'failed') WHERE k > 1")
def _(spark, d):
    return c.prunable_runs(_runs(spark, d)).select("run_id")


@query("w8_quantile_window", f"WITH {CUBE} SELECT mp AS marketplace_code, quantile_cont(CAST(qty AS DOUBLE), 0.2) AS q20, quantile_cont(CAST(qty AS DOUBLE), 0.95) AS q95 FROM cube GROUP BY mp")
def _(spark, d):
    x = cube(spark, d)
    return su.quantiles(x, ["__marketplace_code"], n.number_of(x, "Продажи, шт"), {"q20": 0.2, "q95": 0.95}).withColumnRenamed("__marketplace_code", "marketplace_code")


@query("w9_group_size", f"WITH {CUBE} SELECT rid, count(*) OVER (PARTITION BY art) AS size FROM cube")
def _(spark, d):
    return su.group_size(cube(spark, d).select(F.col("__row_hash").alias("rid"), "Артикул"), ["Артикул"]).drop("Артикул")


@query("o1_report_order", f"WITH {CUBE} SELECT row_number() OVER (ORDER BY y, mo, cat, market) AS place, y AS year, mo AS month, cat AS category, market AS marketplace FROM cube GROUP BY y, mo, cat, market ORDER BY place")
def _(spark, d):
    spec = r.ReportSpec("category_month", PROJECT)
    x = r.report(cube(spark, d), spec)
    return numbered(x, r.places(x)).orderBy("_k").select(F.col("_k").alias("place"), F.col("Год").alias("year"), F.col("Месяц").alias("month"), F.col("Категория").alias("category"), F.col("Маркетплейс").alias("marketplace"))


@query("o2_export_order", f"WITH {CUBE} SELECT rid FROM cube ORDER BY brand DESC NULLS LAST, rid")
def _(spark, d):
    return e.ordered(cube(spark, d), "Бренд", descending=True).select(F.col("__row_hash").alias("rid"))


@query("o3_paging", f"WITH {CUBE} SELECT rid FROM cube ORDER BY y, mo, cat, market, brand, sku, rid LIMIT 500 OFFSET 1000")
def _(spark, d):
    return e.page(e.ordered(cube(spark, d)), 10_000, 1000).select(F.col("__row_hash").alias("rid"))


@query("u2_union_all", "SELECT kind, count(*) AS n_rows FROM (SELECT 'order' AS kind FROM orders UNION ALL SELECT 'event' FROM events) GROUP BY kind")
def _(spark, d):
    x = table(spark, d, "orders").select(F.lit("order").alias("kind")).unionByName(table(spark, d, "events").select(F.lit("event").alias("kind")))
    return x.groupBy("kind").agg(F.count("*").alias("n_rows"))


@query("u3_distinct", f"WITH {CUBE} SELECT DISTINCT ck AS category_key, mp AS marketplace_code FROM cube")
def _(spark, d):
    return _ascii(cube(spark, d).select("__category_key", "__marketplace_code").distinct())


@query("u4_set_union", "SELECT r_name AS name FROM region UNION SELECT n_name FROM nation UNION SELECT c_mktsegment FROM customer")
def _(spark, d):
    x = [table(spark, d, a).select(F.col(b).alias("name")) for a, b in (("region", "r_name"), ("nation", "n_name"), ("customer", "c_mktsegment"))]
    return x[0].union(x[1]).union(x[2]).distinct()


@query("p11_visible_columns", f"WITH {CUBE} SELECT brand, sku AS title FROM cube")
def _(spark, d):
    x = e.projected(cube(spark, d), ["Бренд", "__row_hash", "SKU", "nothing"])
    assert visible(["__a", "b"], ["__a"]) == ["b"]
    return _ascii(x)


@query("p12_row_hash", f"WITH {CUBE} SELECT rid, sha1(concat_ws('|', 'demo', y, mo, mp, ck, sku, coalesce(CASE WHEN ok % 2 = 0 THEN brand END, '<NULL>'))) AS row_hash, sha1(concat_ws('|', 'demo', y, mo, mp, sku, coalesce(CASE WHEN ok % 2 = 0 THEN brand END, '<NULL>'))) AS business_hash FROM cube")
def _(spark, d):
    x = cube(spark, d).withColumn("rid", F.col("__row_hash")).withColumn("Бренд", F.expr("if(cast(substring_index(__row_hash, '-', 1) as long) % 2 = 0, `Бренд`, null)"))
    return c.with_hashes(x, ["SKU", "Бренд"]).select("rid", F.col("__row_hash").alias("row_hash"), F.col("__business_row_hash").alias("business_hash"))


@query("p13_period_label", "SELECT i AS idx, printf('%04d-%02d', CAST((i - 1) // 12 AS INTEGER), CAST((i - 1) % 12 + 1 AS INTEGER)) AS label FROM (SELECT DISTINCT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS i FROM orders)")
def _(spark, d):
    x = table(spark, d, "orders").select(r.period_index(F.year("o_orderdate"), F.month("o_orderdate")).alias("idx")).distinct()
    return x.select("idx", r.index_label(F.col("idx")).alias("label"))


@query("p14_day_coverage", "SELECT y, mo, CASE WHEN make_date(y, mo, 1) < DATE '1998-05-01' THEN CAST(day(last_day(make_date(y, mo, 1))) AS INTEGER) WHEN make_date(y, mo, 1) = DATE '1998-05-01' THEN 17 ELSE 0 END AS days_loaded, CAST(day(last_day(make_date(y, mo, 1))) AS INTEGER) AS days_in_month FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo FROM orders)")
def _(spark, d):
    x = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo")).distinct()
    loaded, days = c.day_coverage_columns(F.col("y"), F.col("mo"), F.lit("1998-05-17").cast("date"))
    return x.select("y", "mo", loaded.alias("days_loaded"), days.alias("days_in_month"))


@query("k2_decimal_comma", f"WITH {CUBE} SELECT rid, regexp_replace(CAST(rev AS VARCHAR), '([0-9])\\.([0-9])', '\\1,\\2', 'g') AS revenue, CAST(qty AS VARCHAR) AS year FROM cube")
def _(spark, d):
    x = cube(spark, d).select(F.col("__row_hash").alias("rid"), F.replace(F.col(q("Выручка, руб")), F.lit(","), F.lit(".")).alias("revenue"), F.replace(F.col(q("Продажи, шт")), F.lit(","), F.lit(".")).alias("Год"))
    return e.with_decimal_commas(x).withColumnRenamed("Год", "year")


@query("k4_typed_export", f"WITH {CUBE} SELECT rid, CAST(floor(qty) AS BIGINT) AS units, CAST(rev AS DOUBLE) AS revenue, CAST(NULL AS BIGINT) AS bad FROM cube")
def _(spark, d):
    x = cube(spark, d).select(F.col("__row_hash").alias("rid"), F.col(q("Продажи, шт")).alias("units"), F.col(q("Выручка, руб")).alias("revenue"), F.col("SKU").alias("bad"))
    return e.typed(x, {"units": "integer", "revenue": "double", "bad": "integer"})


@query("d4_hash_backfill", "SELECT n_nationkey, sha1(concat_ws('|', 'demo', 1, 2, 'mp', coalesce(n_name, '<NULL>'))) AS h FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'old' FROM nation WHERE n_nationkey % 2 = 1")
def _(spark, d):
    x = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit("demo").alias("__project_name"), F.lit(1).alias("__year"), F.lit(2).alias("__month"), F.lit("mp").alias("__marketplace_code"), F.expr("if(n_nationkey % 2 = 1, 'old', '')").alias("__business_row_hash"))
    return c.backfilled(x, ["n_name"]).select("n_nationkey", F.col("__business_row_hash").alias("h"))


@query("d5_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey <= 5")
def _(spark, d):
    x = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changes = x.where("c_custkey % 10 = 0").select("c_custkey", F.lit("changed").alias("segment")).union(x.where("c_custkey <= 5").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("segment")))
    return c.upserted(x, changes, ["c_custkey"])


@query("d5_newest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return c.newest(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("d6_replace_run", "SELECT run_id, count(*) AS n_rows FROM (SELECT event_type AS run_id FROM events WHERE event_type <> 'click' UNION ALL SELECT 'click' FROM nation) GROUP BY run_id")
def _(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("run_id"))
    return c.replaced_run(x, table(spark, d, "nation").select(F.lit("click").alias("run_id")), "click").groupBy("run_id").agg(F.count("*").alias("n_rows"))


@query("d9_stale_runs", "SELECT CASE WHEN event_id % 4 IN (0, 1) THEN 'failed' WHEN event_id % 4 = 2 THEN 'succeeded' ELSE 'failed' END AS status, count(*) AS runs FROM events GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "events").select(F.expr("element_at(array('queued', 'running', 'succeeded', 'failed'), cast(event_id % 4 + 1 as int))").alias("status"))
    return c.stale_failed(x).groupBy("status").agg(F.count("*").alias("runs"))


_BITS = "SELECT o_orderkey, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b, o_orderkey % 5 = 0 AS c, o_orderkey % 7 = 0 AS e, o_orderkey % 11 = 0 AS f, o_orderkey % 13 <> 0 AS g FROM orders"


def _bits(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", "o_orderkey % 2 = 0 AS a", "o_orderkey % 3 = 0 AS b", "o_orderkey % 5 = 0 AS c", "o_orderkey % 7 = 0 AS e", "o_orderkey % 11 = 0 AS f", "o_orderkey % 13 <> 0 AS g")


@query("d10_plan_status", f"SELECT status, count(*) AS tasks FROM (SELECT CASE WHEN f THEN 'failed' WHEN a AND c AND e THEN 'stale' WHEN a AND NOT g THEN 'incomplete' WHEN a THEN 'ready' WHEN c OR b THEN 'incomplete' ELSE 'missing' END AS status FROM ({_BITS})) GROUP BY status")
def _(spark, d):
    x = c.plan_status(*(F.col(k) for k in ("f", "b", "c", "a", "e", "g")))
    return _bits(spark, d).groupBy(x.alias("status")).agg(F.count("*").alias("tasks"))


@query("d11_task_status", f"SELECT status, count(*) AS tasks FROM (SELECT CASE WHEN e THEN 'saved' WHEN c THEN 'classified' WHEN b THEN 'processed' WHEN a THEN 'downloaded' ELSE 'pending' END AS status FROM ({_BITS})) GROUP BY status")
def _(spark, d):
    return _bits(spark, d).groupBy(c.task_status(F.col("e"), F.col("c"), F.col("b"), F.col("a")).alias("status")).agg(F.count("*").alias("tasks"))


@query("d12_due_schedules", "SELECT event_id FROM events WHERE user_id % 2 = 0 AND ts <= (SELECT min(ts) FROM events) + INTERVAL 1 DAY")
def _(spark, d):
    x = table(spark, d, "events").select("event_id", (F.col("user_id") % 2 == 0).alias("enabled"), F.col("ts").alias("next_run_at"))
    now = x.agg((F.min("next_run_at") + F.expr("interval 1 day")).alias("now"))
    return c.due(x.crossJoin(now), F.col("now")).select("event_id")


@query("d13_run_status", "SELECT event_type AS run, CASE WHEN count(*) FILTER (WHERE user_id % 50 = 0) > 0 THEN 'paused' WHEN count(*) FILTER (WHERE user_id % 3 = 0) > 0 THEN 'completed_with_errors' ELSE 'succeeded' END AS status FROM events GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.count_if(F.col("user_id") % 3 == 0).alias("bad"), F.count_if(F.col("user_id") % 50 == 0).alias("open"))
    return x.select("run", c.run_status(F.col("bad"), F.col("open")).alias("status"))


@query("n1_num", "SELECT o_orderkey, TRY_CAST(replace(replace(replace(x, chr(160), ''), ' ', ''), ',', '.') AS DOUBLE) AS v FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '1 234,5' WHEN 1 THEN '12' || chr(160) || '000' WHEN 2 THEN 'abc' WHEN 3 THEN '-7.25' WHEN 4 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS x FROM orders)")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", n.num(F.expr("CASE o_orderkey % 6 WHEN 0 THEN '1 234,5' WHEN 1 THEN '12' || ' ' || '000' WHEN 2 THEN 'abc' WHEN 3 THEN '-7.25' WHEN 4 THEN '' ELSE cast(o_orderkey as string) END")).alias("v"))


@query("n2_num_in_text", "SELECT event_id, TRY_CAST(nullif(regexp_extract(replace(props, ',', '.'), '([-+]?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS v FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", n.num_in_text(F.col("props")).alias("v"))


@query("n4_numbers_close", "SELECT p_partkey, p_size > 0 AND abs(p_size - 25.0) <= greatest(2.0, 0.1 * greatest(p_size, 25.0)) AS close FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", n.close(F.col("p_size"), F.lit(25.0), 2.0, 0.1).alias("close"))


@query("n5_multipack", "SELECT p_partkey, nullif(round_even(p_size / 4.0, 0), 0) AS packs, greatest(1.0, round_even(p_size / 4.0, 0)) AS at_least_one FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", n.multipack(F.lit(4.0), F.col("p_size")).alias("packs"), n.multipack_at_least_one(F.lit(4.0), F.col("p_size")).alias("at_least_one"))


@query("n6_safe_div", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 100.0 / s_acctbal END AS a, CASE WHEN s_acctbal > 0 THEN 100.0 / s_acctbal ELSE 0 END AS b FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", n.safe_div(F.lit(100.0), F.col("s_acctbal")).alias("a"), n.safe_div(F.lit(100.0), F.col("s_acctbal"), 0.0).alias("b"))


@query("n9_hash_fraction", "SELECT doc_id, CAST(('0x' || substr(sha256('42:' || doc_id), 1, 12)) AS BIGINT) / 281474976710656.0 AS x FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", n.hash_fraction(F.col("doc_id"), 42).alias("x"))
