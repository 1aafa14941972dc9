"""Queries on files, imports, classification as a whole, candidates and rebuilt groups."""

from __future__ import annotations

import io
import sqlite3
import tempfile
import zipfile

from pyspark.sql import functions as F

from tallyforge import storage
from tallyforge.functions.text import filename_safe
from tallyforge.operators import cube as c
from tallyforge.operators import etl, exports, identity, records, research, rules, state
from tallyforge.plans.adapter import table
from tallyforge.plans.catalog import query
from tallyforge.schema import q
from tallyforge.sources import files, sheets
from tallyforge.storage import Scratch
from tallyforge.streaming import boards


def _nations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _raw_file(spark, path: str, content: bytes) -> str:
    """A file of a few bytes in the shared folder."""
    target, store = storage._path(spark, path)
    stream = store.create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    return path


def _csv(spark, d, sep: str = ";", head: str = "Ключ", encoding: str = "utf-8-sig") -> bytes:
    rows = _nations(spark, d).orderBy("n_nationkey").collect()
    return "".join([f"{head}{sep}Имя\n", *(f'{r.n_nationkey}{sep}"{r.n_name}{sep} г"\n' for r in rows)]).encode(encoding)


_FILE_ROWS = "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name || '{sep} г' AS name FROM nation"


@query("s1_sniffed_csv", _FILE_ROWS.format(sep=","))
def _(spark, d):
    path = _raw_file(spark, Scratch(spark, "s1").path("in.csv"), _csv(spark, d, ",", encoding="cp1251"))
    return files.read_any_csv(spark, path).toDF("k", "name")


@query("s2_semicolon_csv", _FILE_ROWS.format(sep=";"))
def _(spark, d):
    folder = Scratch(spark, "s2").root
    for name in ("b.csv", "a.csv", "c.txt"):
        _raw_file(spark, f"{folder}/{name}", _csv(spark, d) if name == "a.csv" else b"x;y\n1;2\n")
    first, *rest = files.list_csv(spark, folder)
    assert len(rest) == 1
    return files.read_text_csv(spark, first).toDF("k", "name")


@query("s3_strict_csv", "SELECT f AS file, n_nationkey + 1 AS row, CAST(n_nationkey AS VARCHAR) AS k, CASE WHEN f = 1 THEN n_name || '; г' END AS name FROM nation CROSS JOIN (SELECT 0 AS f UNION ALL SELECT 1)")
def _(spark, d):
    scratch = Scratch(spark, "s3")
    short = "".join(["Ключ;Имя\n", *(f"{r.n_nationkey}\n" for r in _nations(spark, d).orderBy("n_nationkey").collect())]).encode()
    paths = [_raw_file(spark, scratch.path("short.csv"), short), _raw_file(spark, scratch.path("whole.csv"), _csv(spark, d))]
    rows = files.read_strict(spark, paths)
    return rows.select(F.col("_file").alias("file"), F.col("_row").cast("int").alias("row"), F.col("Ключ").alias("k"), F.col("Имя").alias("name"))


@query("s5_zip_pick", "SELECT 'rows.csv' AS name, count(*) AS lines FROM nation")
def _(spark, d):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("rows.csv", _csv(spark, d))
        z.writestr("more.csv", "x")
    path = _raw_file(spark, Scratch(spark, "s5").path("in.zip"), out.getvalue())
    return files.zipped_csv(spark, [path]).select("name", F.expr("cast(size(split(cast(content as string), '\\n')) - 2 as long) AS lines"))


@query("s6_csv_row_count", "SELECT count(*) AS n FROM nation")
def _(spark, d):
    path = _raw_file(spark, Scratch(spark, "s6").path("in.csv"), _csv(spark, d))
    return spark.createDataFrame([(files.count_csv(spark, path),)], "n long")


@query("s7_sheet_input", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def _(spark, d):
    path = Scratch(spark, "s7").path("in.xlsx")
    sheets.write_sheet(_nations(spark, d).withColumn("n_regionkey", F.expr("if(n_regionkey > 0, n_regionkey, null)")), path)
    return files.read_table(spark, path).toDF("k", "name", "region")


@query("s8_label_states", "SELECT CAST(n_nationkey AS BIGINT) AS row_index, n_name AS final_label FROM nation")
def _(spark, d):
    with tempfile.NamedTemporaryFile(suffix=".db") as f:
        with sqlite3.connect(f.name) as con:
            con.execute("CREATE TABLE row_states (row_index INTEGER, status TEXT, final_label TEXT, updated_at TEXT)")
            con.executemany("INSERT INTO row_states VALUES (?, 'done', ?, 'now')", [(r.n_nationkey, r.n_name) for r in _nations(spark, d).collect()])
        return files.label_states(spark, f.name).select("row_index", "final_label")


@query("k1_csv_sink", "SELECT CAST(p_partkey AS VARCHAR) AS k, p_name || '; \"x\"' AS name FROM part")
def _(spark, d):
    path = Scratch(spark, "k1").path("out")
    files.write_csv(table(spark, d, "part").select(F.col("p_partkey").alias("Ключ"), F.concat("p_name", F.lit('; "x"')).alias("Имя")), path)
    return spark.read.option("header", True).option("sep", ";").option("escape", '"').csv(path).toDF("k", "name")


@query("k3_sheet_sink", "SELECT CAST(p_partkey AS VARCHAR) AS k, p_name || ' <&> \"x\"' AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def _(spark, d):
    path = Scratch(spark, "k3").path("out")
    n = sheets.write_sheets(table(spark, d, "part").select(F.col("p_partkey").alias("Ключ"), F.concat("p_name", F.lit(' <&> "x"')).alias("Имя"), F.col("p_size").alias("Размер")), path)
    out = sheets.read_sheet(spark, path)
    assert out.columns == ["Ключ", "Имя", "Размер"] and n >= 0
    return out.toDF("k", "name", "size")


@query("k5_split_by_category", "SELECT p_type AS category, count(*) AS rows FROM part GROUP BY 1")
def _(spark, d):
    path = Scratch(spark, "k5").path("out")
    files.write_by_category(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("__category_key")), path, confirmed=True)
    return spark.read.option("header", True).option("sep", ";").option("basePath", path).csv(path).groupBy(F.col("__category_key").alias("category")).agg(F.count("*").alias("rows"))


@query("k6_manifest", "SELECT 'run-1' AS run, count(*) AS rows FROM nation")
def _(spark, d):
    path = Scratch(spark, "k6").path("manifest.json")
    files.write_manifest(spark, path, {"run": "run-1", "rows": _nations(spark, d).count()})
    return spark.read.schema("run string, rows long").json(path)


@query("k7_vector_snapshot", "SELECT count(*) AS nodes, FALSE AS first, TRUE AS second, TRUE AS again FROM part")
def _(spark, d):
    folder = Scratch(spark, "k7").root
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node"), F.col("p_name").alias("text"))
    embed = lambda x: x.select("node", identity.hashing_embedding(F.col("text")).alias("vector"))
    first, a = identity.snapshot(spark, folder, rows, embed, "hash")
    second, b = identity.snapshot(spark, folder, rows, embed, "hash")
    _, other = identity.snapshot(spark, folder, rows.withColumn("text", F.concat("text", F.lit("!"))), embed, "hash")
    return second.join(first.withColumnRenamed("vector", "w"), "node").agg(F.count_if(F.col("vector") == F.col("w")).alias("nodes")).withColumns({"first": F.lit(a), "second": F.lit(b), "again": F.lit(not other)})


def _report(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("SKU"), F.col("p_name").alias("Название"), F.col("p_brand").alias("Бренд"), F.col("p_size").cast("string").alias("Продажи, шт"), F.lit("1,5").alias("Объем, кг"))


def _imported(spark, d, name: str):
    cube = c.Cube(spark, Scratch(spark, name).root)
    rows = _report(spark, d)
    for k in range(2):
        part = rows.where(F.expr(f"cast(SKU as long) % 2 = {k}"))
        cube.import_slice(part, c.Slice("demo", 2024, k + 1, "ozon", f"c{k}", f"C {k}"), f"run-{k}", f"{k}.csv")
    return cube


_IMPORTED = "SELECT p_partkey % 2 + 1 AS month, count(*) AS rows, count(DISTINCT p_partkey) AS articles, CAST(sum(p_size) AS DOUBLE) AS units FROM part WHERE p_size >= 15 GROUP BY 1"


def _by_month(df):
    return df.groupBy(F.col("__month").alias("month")).agg(F.count("*").alias("rows"), F.countDistinct("SKU").alias("articles"), F.sum(F.col(q("__num:Продажи, шт"))).alias("units"))


@query("d1_append_import", _IMPORTED)
def _(spark, d):
    return _by_month(_imported(spark, d, "d1").rows())


@query("d2_idempotent_import", _IMPORTED.replace("AS units", "AS units, 2 AS slices, 0 AS again"))
def _(spark, d):
    cube = _imported(spark, d, "d2")
    again = cube.import_slice(_report(spark, d).where("cast(SKU as long) % 2 = 0"), c.Slice("demo", 2024, 1, "ozon", "c0", "C 0"), "run-2", "0.csv")
    return _by_month(cube.rows()).withColumns({"slices": F.lit(cube.registry().count()), "again": F.lit(again)})


@query("d3_schema_evolution", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS old, CASE WHEN n_nationkey % 2 = 1 THEN 'new' END AS more FROM nation")
def _(spark, d):
    x = _nations(spark, d)
    left, right = c.merged_schema(x.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), "n_name"), x.where("n_nationkey % 2 = 1").select(F.col("n_nationkey").cast("string").alias("k"), "n_name", F.lit("new").alias("more")))
    return left.unionByName(right, allowMissingColumns=True).select("k", F.col("n_name").alias("old"), "more")


@query("d7_delete_slices", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'saved' WHEN o_orderkey % 2 = 0 THEN 'classified' WHEN o_orderkey % 5 = 0 THEN 'processed' ELSE 'downloaded' END AS status, CASE WHEN o_orderkey % 3 > 0 THEN 'done' ELSE 'pending' END AS save_status FROM orders")
def _(spark, d):
    tasks = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 3).alias("month"), F.lit("saved").alias("status"), F.lit("done").alias("save_status"), F.lit("old").alias("error_message"),
        F.expr("if(o_orderkey % 2 = 0, 'classified', '')").alias("classify_status"), F.expr("if(o_orderkey % 5 = 0, 'processed', '')").alias("process_status"), F.lit("downloaded").alias("download_status"),
    )
    keys = spark.createDataFrame([(0,), (0,)], "month long")
    return state.slices_deleted(tasks, keys, ["month"]).select("o_orderkey", "status", "save_status")


@query("j9_semi_delete", "SELECT l_orderkey % 10 AS run_id, count(*) AS rows FROM lineitem WHERE l_orderkey % 10 NOT IN (3, 7) GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("run_id"))
    return state.without_runs(rows, spark.createDataFrame([(3,), (7,), (3,)], "run_id long")).groupBy("run_id").agg(F.count("*").alias("rows"))


@query("p18_months", "SELECT y * 12 + m - 1 AS at, y, m, ny, nm FROM (SELECT (2023 * 12 + 10 + i) // 12 AS y, (2023 * 12 + 10 + i) % 12 + 1 AS m, (2023 * 12 + 11 + i) // 12 AS ny, (2023 * 12 + 11 + i) % 12 + 1 AS nm FROM range(6) t(i))")
def _(spark, d):
    months = state.month_iter((2023, 11), (2024, 4))
    assert state.months_by_year((2023, 11), (2024, 4)) == {2023: (11, 12), 2024: (1, 2, 3, 4)}
    return spark.createDataFrame([(y * 12 + m - 1, y, m, *state.next_month(y, m)) for y, m in months], "at long, y long, m long, ny long, nm long")


@query("f9_grouped_search", "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'SMALL') AND p_size % 2 = 0 AND (lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%')")
def _(spark, d):
    x = table(spark, d, "part").select(
        "p_partkey", F.lit("demo").alias("project_name"), F.col("p_type").alias("category_key"), F.expr("if(p_size % 2 = 0, 'canonical', 'source')").alias("row_level"), F.col("p_name").alias("normalized_sku"),
        F.upper("p_name").alias("canonical_sku"), F.lit(None).cast("string").alias("sku"), F.col("p_brand").alias("brand"), F.lit("1").alias("article"), F.lit("x").alias("category_name"), F.lit("y").alias("marketplace"),
    )
    groups = spark.createDataFrame([("ECONOMY", "SMALL"), ("ECONOMY", "ECONOMY"), ("other", "LARGE")], "group_key string, source_key string")
    return exports.grouped_products(x, "demo", " ECONOMY ", groups, "canonical", " RiNG ").select("p_partkey")


@query("f15_label_targets", "SELECT doc_id, score, CASE doc_id % 4 WHEN 2 THEN 0 ELSE 1 END AS target FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score FROM documents) WHERE doc_id % 4 < 3 AND doc_id % 7 > 0")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.expr("if(doc_id % 7 > 0, cast(n_chars as string), 'none')").alias("score"), F.expr("element_at(array('exact_duplicate', ' same_product_different_pack', 'different_product', 'uncertain'), cast(doc_id % 4 + 1 as int))").alias("label"))
    return research.labelled(x).select("doc_id", "score", F.col("same_base_product").alias("target"))


@query("a33_link_metrics", """SELECT p_type AS part, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn,
 coalesce(sum(p_size) FILTER (WHERE NOT y AND p), 0)::DOUBLE AS false_link_weight, coalesce(sum(p_size) FILTER (WHERE y AND NOT p), 0)::DOUBLE AS missed_link_weight, count(*) FILTER (WHERE b <> p) AS changed, count(*) FILTER (WHERE b AND NOT p) AS cuts,
 round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 9)::DOUBLE AS f0_5 FROM (SELECT *, p_size % 2 = 0 AS y, p_partkey % 3 > 0 AS p, p_partkey % 2 = 0 AS b FROM part) GROUP BY 1""")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_type").alias("part"), F.expr("p_size % 2 = 0").alias("target"), F.expr("p_partkey % 3 > 0").alias("predicted"), F.expr("p_partkey % 2 = 0").alias("baseline"), F.col("p_size").alias("pair_weight"))
    return research.link_metrics(x, ["part"]).select("part", "tp", "fp", "fn", "tn", "false_link_weight", "missed_link_weight", "changed", "cuts", F.round("f0_5", 9).alias("f0_5"))


@query("a52_file_stats", "SELECT 'demo' AS project, 2 AS raw_files, 14 AS raw_bytes, 1 AS classified_files, (SELECT count(*) FROM nation) AS rows UNION ALL SELECT 'empty', 0, 0, 0, 0")
def _(spark, d):
    root = Scratch(spark, "a52").root
    for name in ("demo/raw/a.csv", "demo/raw/b.csv", "demo/classified/a.csv", "empty/other/a.csv"):
        _raw_file(spark, f"{root}/{name}", b"a;b\n1;2"[:7])
    stats = files.file_stats(spark, root, ["raw", "classified"])
    database = _nations(spark, d).agg(F.lit("demo").alias("project"), F.count("*").alias("rows"))
    return state.project_summary({"files": stats, "database": database}).select("project", "raw_files", "raw_bytes", "classified_files", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("w6_family_title_rank", "SELECT family, title FROM (SELECT p_brand AS family, p_name || ' set' AS title, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_name || ' set, 6 шт') AS r FROM part) WHERE r = 1")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_brand").alias("family"), F.concat("p_name", F.lit(" set, 6 шт")).alias("canonical_sku"), F.col("p_brand").alias("brand"), F.lit("some parts").alias("category_name"), F.col("p_retailprice").alias("revenue"), F.col("p_size").alias("sales_volume"), F.lit(1).alias("source_count"))
    return identity.family_titles(x)


_PAIRS = "SELECT p_partkey AS a, p_size % 7 AS score, p_size % 3 AS shared, p_type AS marketplace_a, p_name AS sku_a, p_brand AS marketplace_b, CAST(p_partkey AS VARCHAR) AS sku_b, CASE p_partkey % 4 WHEN 0 THEN 'supplemental_random_control' WHEN 1 THEN 'supplemental_lexical_overlap' ELSE 'faiss_embedding_topk' END AS src FROM part"


def _pairs(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS a", "p_size % 7 AS baseline_similarity_score", "p_size % 7 AS embedding_similarity_score", "p_size % 3 AS shared_title_tokens_count", "p_size % 3 AS candidate_rank", "p_type AS marketplace_a", "p_name AS sku_a", "p_brand AS marketplace_b", "cast(p_partkey as string) AS sku_b",
        "CASE p_partkey % 4 WHEN 0 THEN 'supplemental_random_control' WHEN 1 THEN 'supplemental_lexical_overlap' ELSE 'faiss_embedding_topk' END AS candidate_source")


@query("o5_candidate_order", f"SELECT a FROM ({_PAIRS}) ORDER BY score DESC, shared DESC, marketplace_a, sku_a, marketplace_b, sku_b LIMIT 50")
def _(spark, d):
    return research.ordered_candidates(_pairs(spark, d), 50).select("a")


@query("o5_candidate_cap", f"WITH p AS ({_PAIRS}), f AS (SELECT a FROM p WHERE src LIKE 'faiss%' ORDER BY score DESC, shared, marketplace_a, sku_a, marketplace_b, sku_b LIMIT 60), s AS (SELECT a FROM p WHERE src NOT LIKE 'faiss%' ORDER BY src, score DESC, shared, marketplace_a, sku_a, marketplace_b, sku_b LIMIT 30) SELECT a FROM f UNION ALL SELECT a FROM s")
def _(spark, d):
    return research.capped_candidates(_pairs(spark, d), 90).select("a")


@query("x8_title_similarity", "SELECT p_partkey, round(0.65 + 0.35 * 2 * length(p_name) / (2 * length(p_name) + 6), 6)::DOUBLE AS similarity FROM part")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", "p_name", F.concat("p_name", F.lit(" extra")).alias("other"))
    return x.select("p_partkey", research.title_similarity(F.col("p_name"), F.col("other")).alias("similarity"))


@query("x9_rule_score", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.0 WHEN p_partkey % 3 = 1 THEN 1.0 ELSE round(0.65 + 0.35 * 2 * length(p_name) / (2 * length(p_name) + 6), 6) END::DOUBLE AS score FROM part")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title_a"), F.expr("CASE p_partkey % 3 WHEN 0 THEN ' !' WHEN 1 THEN upper(p_name) ELSE p_name || ' extra' END").alias("title_b"))
    return research.rule_score(x).select("p_partkey", "score")


@query("x16_safe_names", "SELECT n_nationkey, 'a_' || n_name || '_b' AS name FROM nation")
def _(spark, d):
    return spark.createDataFrame([(r.n_nationkey, filename_safe(f" a/{r.n_name}: b. ")) for r in _nations(spark, d).collect()], "n_nationkey int, name string")


@query("x17_filter_language", "SELECT p_partkey, 1 AS filter FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_name) NOT LIKE '%bolt%' UNION ALL SELECT p_partkey, 2 FROM part WHERE lower(p_name) LIKE '%red%' AND lower(p_name) NOT LIKE '%bolt%'")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", "p_name")
    one, two = (records.filtered(x, "p_name", f"'Red' {s} NOT 'bolt'") for s in "|&")
    return one.select("p_partkey", F.lit(1).alias("filter")).union(two.select("p_partkey", F.lit(2)))


_RULES = [
    {"match_field": "Название", "match_type": "contains", "pattern": "red", "target_column": "Тип", "set_value": "red", "mode": "fill_empty", "priority": "1", "category": ""},
    {"match_field": "Название", "match_type": "contains", "pattern": "bolt", "target_column": "Категория", "set_value": "bolts", "mode": "overwrite", "priority": "2", "category": "small"},
    {"match_field": "Название", "match_type": "contains", "pattern": "blue", "target_column": "Тип", "set_value": "blue bolt", "mode": "fill_empty", "priority": "3", "category": "bolts"},
    {"match_field": "Название", "match_type": "contains", "pattern": "no such", "target_column": "Тип", "set_value": "never", "mode": "fill_empty", "priority": "4", "category": "large"},
]
_CLASSIFIED = "SELECT p_partkey, p_name, CASE WHEN p_name LIKE '%bolt%' AND lower(p_type) = 'small' THEN 'bolts' ELSE p_type END AS cat, CASE WHEN p_name LIKE '%red%' THEN 'red' WHEN p_name LIKE '%bolt%' AND p_name LIKE '%blue%' AND lower(p_type) = 'small' THEN 'blue bolt' END AS kind FROM part"


def _unclassified(spark, d):
    return table(spark, d, "part").select(F.lit("05.03.2024").alias("Дата"), F.col("p_type").alias("Категория"), F.col("p_partkey").cast("string").alias("SKU"), F.col("p_name").alias("Название"), F.lit("x").alias("Вес причина"))


@query("c11_classify", f"SELECT CAST(p_partkey AS VARCHAR) AS article, p_name AS title, cat AS category, CASE WHEN p_partkey = 7 THEN 'by hand' ELSE coalesce(kind, 'none') END AS kind, 'мар.' AS month FROM ({_CLASSIFIED})")
def _(spark, d):
    done = etl.classify(_unclassified(spark, d), [{"active": "1"} | r for r in _RULES], {"Тип": "none"}, [{"match_field": "SKU", "match_value": "7", "target_column": "Тип", "set_value": "by hand"}])
    assert done.dropped == ("Вес причина",) and done.renamed == {"SKU": "Артикул", "Название": "SKU"}
    return done.rows.select(F.col("Артикул").alias("article"), F.col("SKU").alias("title"), F.col("Категория").alias("category"), F.col("Тип").alias("kind"), F.col("месяц").alias("month"))


@query("c12_sample_audit", f"""WITH x AS ({_CLASSIFIED}) SELECT 1 AS rule, count(*) FILTER (WHERE p_name LIKE '%red%') AS matched, NULL::VARCHAR AS reason FROM x UNION ALL SELECT 2, count(*) FILTER (WHERE cat = 'bolts'), NULL FROM x
 UNION ALL SELECT 3, count(*) FILTER (WHERE cat = 'bolts' AND p_name LIKE '%blue%'), NULL FROM x UNION ALL SELECT 4, 0, 'never_matched_sample' FROM (SELECT 1)""")
def _(spark, d):
    return rules.sample_audit(_unclassified(spark, d), rules.compiled([{"active": "1"} | r for r in _RULES])).select("rule", "matched", "reason")


@query("c7_slice_prefilter", f"SELECT cat AS category, coalesce(kind, 'none') AS kind, count(*) AS n FROM ({_CLASSIFIED}) WHERE p_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') GROUP BY 1, 2")
def _(spark, d):
    compiled = rules.compiled([{"active": "1"} | r for r in _RULES])
    assert [r.value for r in rules.reachable(compiled, "Small", "Категория")[0]] == ["red", "bolts", "blue bolt"]
    done = rules.apply(_unclassified(spark, d).where("`Категория` = 'SMALL'"), compiled, fill={"Тип": "none"}, slice_category="Small")
    return done.groupBy(F.col("Категория").alias("category"), F.col("Тип").alias("kind")).agg(F.count("*").alias("n"))


@query("m7_lexical_candidates")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", F.concat(F.lit("model"), (F.col("p_partkey") % 500).cast("string"))).alias("title"))
    return research.lexical_candidates(x)


@query("m6_four_sources")
def _(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", F.concat(F.lit("model"), (F.col("p_partkey") % 500).cast("string"))).alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("marketplace"),
        F.col("p_size").cast("double").alias("unit_amount"), F.col("p_size").cast("double").alias("total_amount"), F.lit(1.0).alias("multipack_count"))
    return research.supplemental(x, x.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))


@query("m18_confidence", "SELECT 'n' || n_nationkey AS node_id, CASE WHEN n_nationkey = 3 THEN 'manual_singleton' WHEN n_regionkey < 4 THEN 'auto_grouped' ELSE 'singleton' END AS status, CASE WHEN n_nationkey = 3 THEN NULL WHEN n_regionkey < 4 THEN 0.95 END::DOUBLE AS confidence FROM nation")
def _(spark, d):
    return _rebuilt(spark, d, 3).select("node_id", "status", F.col("confidence").cast("double").alias("confidence"))


def _rebuilt(spark, d, by_hand=None):
    """Nations as listings: those of a region are a chain of scored pairs, but for the last region's, which score low."""
    x = _nations(spark, d)
    nodes = x.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node_id"), F.lit("cat").alias("category_key"), F.col("n_name").alias("sku"), F.lit(1.0).alias("unit_amount"), F.lit(1.0).alias("total_amount"), F.lit(1.0).alias("multipack_count"), F.col("n_nationkey").cast("double").alias("sales_volume"), F.lit(0.0).alias("revenue"))
    side = x.select("n_regionkey", F.col("n_nationkey").alias("k"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"))
    lead = side.groupBy("n_regionkey").agg(F.max(F.struct("k", "id")).alias("m")).select("n_regionkey", F.col("m.id").alias("node_id_a"))
    pairs = side.join(lead, "n_regionkey").where("id <> node_id_a").select("node_id_a", F.col("id").alias("node_id_b"), F.expr("if(n_regionkey < 4, 0.95D, 0.2D)").alias("score"))
    manual = spark.createDataFrame([(f"n{by_hand}", "mlfam_000900", "mlpack_000900")], "node_id string, target_family_id string, target_pack_id string") if by_hand is not None else None
    return identity.regrouped(Scratch(spark, "rebuilt"), nodes, pairs, 0.9, "connected_components", manual=manual)


@query("m21_graph_rebuild", "WITH x AS (SELECT *, max(n_nationkey) OVER (PARTITION BY n_regionkey) AS m, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation) SELECT 'n' || n_nationkey AS node_id, CASE WHEN n_regionkey < 4 THEN 'n' || m ELSE 'n' || n_nationkey END AS canonical_node_id, CASE WHEN n_regionkey < 4 THEN c ELSE 1 END AS component_size FROM x")
def _(spark, d):
    return _rebuilt(spark, d).select("node_id", "canonical_node_id", "component_size")


@query("m30_record_holdout")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b"), F.expr("l_quantity > 49").alias("positive"))
    return research.record_split(x, {"train": 0.7, "dev": 0.15, "test": 0.15})[0]


@query("t1_chunked_transform", "SELECT CAST(p_partkey AS VARCHAR) AS k, upper(p_name) AS name FROM part")
def _(spark, d):
    scratch = Scratch(spark, "t1")
    table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_name").alias("name")).repartition(4).write.option("sep", ";").csv(scratch.path("in"))
    stream = spark.readStream.schema("k string, name string").option("sep", ";").option("maxFilesPerTrigger", 1).csv(scratch.path("in"))
    boards.in_batches(stream, lambda x: x.withColumn("name", F.upper("name")), scratch.path("out"), scratch.path("checkpoint")).awaitTermination()
    return spark.read.schema("k string, name string, batch int").parquet(scratch.path("out")).drop("batch")
