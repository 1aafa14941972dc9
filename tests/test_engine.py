"""The cube, rules, merging, identity, files and streams, end to end on small tables."""

import json
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import etl, exports, graph, identity, reports, rules
from tallyforge.operators import research as rs
from tallyforge.operators.cube import Cube, DuplicateSliceError, Slice
from tallyforge.sources import files
from tallyforge.storage import Scratch, shared_folder
from tallyforge.streaming import boards as streams

COLUMNS = "`SKU` string, `Бренд` string, `Продажи, шт` string, `Объем, кг` string, `Выручка, руб` string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), COLUMNS)


GOOD = [("s1", "A", "20", "2", "40"), ("s2", "A", "20,0", "2", "40"), ("low", "A", "3", "1", "1"), ("zero", "A", "0", "0", "1"), ("bad", "A", "many", "1", "1")]


def test_slices_load_once_and_replace(spark, tmp_path):
    cube, s = Cube(spark, f"file://{tmp_path}/cube"), Slice("p", 2025, 1, "oz", "soap", "Мыло")
    assert cube.import_slice(rows(spark, *GOOD), s, "r1", "a.csv") == 2
    assert cube.import_slice(rows(spark, *GOOD), s, "r2", "a.csv") == 0
    assert cube.rows().count() == 2 and cube.rows().select("__row_hash").distinct().count() == 2
    with pytest.raises(DuplicateSliceError):
        cube.import_slice(rows(spark, ("s9", "B", "30", "3", "9")), Slice("p", 2025, 1, "oz", "soap2", "Мыло"), "r3", "b.csv")
    assert cube.rows().count() == 2
    assert cube.import_slice(rows(spark, ("s9", "B", "30", "3", "9")), Slice("p", 2025, 1, "oz", "soap2", "Мыло"), "r4", "b.csv", overwrite=True) == 1
    assert [r["SKU"] for r in cube.rows().collect()] == ["s9"]
    assert [r["__category_key"] for r in cube.registry().collect()] == ["soap2"]
    other = Slice("p", 2025, 1, "oz", "soap2", "Мыло", source_type="subject")
    assert cube.import_slice(rows(spark, ("s9", "B", "30", "3", "9"), ("s8", "B", "31", "3", "9")), other, "r5", "c.csv") == 1
    assert cube.delete_slices([other]) == 1 and cube.registry().count() == 0
    assert cube.journal().count() == 4


def test_reports_and_exports(spark, tmp_path):
    cube = Cube(spark, f"file://{tmp_path}/cube")
    cube.import_slice(rows(spark, *GOOD), Slice("p", 2025, 1, "oz", "soap", "Мыло"), "r1")
    cube.import_slice(rows(spark, ("t", "B", "30", "3", "90")), Slice("p", 2025, 2, "wb", "soap", "Мыло"), "r2")
    found = reports.report(cube.rows(), reports.ReportSpec("brand_month", "p", last=2025 * 12 + 1)).collect()
    assert [(r["Бренд"], r["Продажи, шт"], r["Выручка, руб"], r["Объем, кг"], r["Средняя цена, руб"]) for r in found] == [("A", 40.0, 80.0, 4.0, 2.0)]
    with pytest.raises(ValueError, match="period"):
        reports.ReportSpec("brand_month", "p", first=5, last=1)
    out = exports.projected(exports.filtered(cube.rows(), [{"column": "Бренд", "match": "equals", "value": "B"}]))
    assert not any(c.startswith("__") for c in out.columns) and out.count() == 1
    plan = cube.rows().where("__year = 2025 and __marketplace_code = 'wb'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "__marketplace_code" in plan


def test_group_join_keeps_rows(spark):
    cube = spark.createDataFrame([("p", "c", "m", "1"), ("p", "c", "m", "1"), ("p", "c", "m", "2")], "__project_name string, __category_key string, __marketplace_code string, `Артикул` string")
    g = spark.createDataFrame([("p", "c", "m", "1", "f1")], "project_name string, category_key string, marketplace_code string, article string, family string")
    assert sorted(str(r.family) for r in exports.with_groups(cube, g).collect()) == ["None", "f1", "f1"]
    with pytest.raises(ValueError, match="two groups"):
        exports.with_groups(cube, g.union(g))


def test_merge_keeps_the_first(spark):
    a = spark.createDataFrame([("a", "20", "x", 0), ("b", "5", "x", 1), ("d", "20", "x", 2), ("a", "20", "x", 3)], "SKU string, `Продажи` string, `Название` string, _row int")
    b = spark.createDataFrame([("a", "20", "x", 0), ("e", "30", "y", 1), ("big", "50000", "y", 2)], "SKU string, `Продажи` string, `Название` string, _row int")
    out, counts = etl.merge([a, b])
    assert [r["SKU"] for r in out.orderBy("_file", "_row").collect()] == ["a", "d", "e"]
    assert "Продажи, шт" in out.columns
    assert sorted(tuple(r) for r in counts.collect()) == [(0, 4, 3), (1, 3, 2)]
    q, _ = etl.merge([spark.createDataFrame([(str(k), str(k * 10), k) for k in range(5)], "SKU string, `Продажи` string, _row int")], least=0, quantile=0.2)
    assert sorted(r["SKU"] for r in q.collect()) == ["2", "3", "4"]


def rule(**kw):
    return {"active": "1", "priority": "1", "category": "", "target_column": "Тип", "match_field": "SKU", "match_type": "contains", "pattern": "x", "set_value": "v", "mode": "fill_empty"} | kw


def test_rules(spark):
    df = spark.createDataFrame([("a (x)", "Соусы", None), ("b", "Мыло", "old"), (None, "Соусы", " ")], "SKU string, `Категория` string, `Тип` string")
    got = lambda *r, **kw: [x["Тип"] for x in rules.apply(df, rules.compiled(r), **kw).collect()]
    assert got(rule(pattern="(X)")) == ["v", "old", " "]
    assert got(rule(match_type="not_contains", pattern="a")) == [None, "old", "v"]
    assert got(rule(match_type="otherwise", pattern="", mode="overwrite")) == ["v", "old", "v"]
    assert got(rule(match_type="startswith", pattern="A")) == [None, "old", " "]
    assert got(rule(match_type="equals", pattern=" B ", mode="overwrite")) == [None, "v", " "]
    assert got(rule(category="соусы|другое", match_type="otherwise")) == ["v", "old", "v"]
    moved = rule(target_column="Категория", match_type="equals", pattern="b", set_value="Новая", mode="overwrite")
    assert got(moved, rule(priority="2", category="новая", match_type="otherwise", set_value="n", mode="overwrite"), rule(priority="2", category="новая", match_type="contains", pattern="b", set_value="n", mode="overwrite"))[1] == "n"
    chain = json.dumps([{"join_with_prev": "or", "match_field": "SKU", "match_type": "equals", "pattern": "b"}, {"join_with_prev": "and", "match_field": "Категория", "match_type": "equals", "pattern": "Соусы"}])
    assert got(rule(pattern="a", conditions_json=chain, mode="overwrite")) == ["v", "old", " "]
    numbers = spark.createDataFrame([("10,5 шт", None), ("9", None)], "SKU string, `Тип` string").withColumn("Категория", F.lit("c"))
    assert [x["Тип"] for x in rules.apply(numbers, rules.compiled([rule(match_type="gt", pattern="9,5")])).collect()] == ["v", None]
    with pytest.raises(ValueError, match="mode"):
        rules.compiled([rule(mode="other")])
    many = [rule(priority=str(k), pattern=f"p{k}", set_value=str(k)) for k in range(150)]
    assert got(*many) == [None, "old", " "]


def test_rules_of_a_slice_give_the_same(spark):
    df = spark.createDataFrame([("b", "Мыло", None)], "SKU string, `Категория` string, `Тип` string")
    r = rules.compiled([rule(category="Соусы", pattern="b", set_value="no"), rule(category="Мыло", target_column="Категория", set_value="Гели", pattern="b", mode="overwrite"), rule(priority="2", category="Гели", pattern="b", set_value="yes")])
    kept, reached = rules.reachable(r, "Мыло", "Категория")
    assert len(kept) == 2 and reached == {"мыло", "гели"}
    assert rules.apply(df, r, slice_category="Мыло").first()["Тип"] == rules.apply(df, r).first()["Тип"] == "yes"


def test_overrides_and_audit(spark):
    df = spark.createDataFrame([("t1", "77"), ("t2", "78")], "SKU string, `Артикул` string")
    out = rules.override(df, [{"match_field": "SKU", "match_value": "77", "target_column": "Тип", "set_value": "fix", "mode": "overwrite", "priority": ""}])
    assert [r["Тип"] for r in out.orderBy("Артикул").collect()] == ["fix", None]
    found = rules.audit(rules.compiled([rule(), rule(), rule(match_type="otherwise", priority="2"), rule(priority="3", pattern="abc")]))
    assert {w.split()[0] for _, w in found} >= {"duplicate", "unreachable", "short"}


def test_leiden_splits_cliques_with_a_bridge(spark):
    edges = [(f"a{i}", f"a{j}", 0.99) for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}", 0.99) for i in range(5) for j in range(i)] + [("a0", "b0", 0.92)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    parts = graph.communities(Scratch(spark, "t"), df, "x", 0.1).collect()
    assert {frozenset(r.node for r in parts if r.component == c) for c in {r.component for r in parts}} == {frozenset(f"a{i}" for i in range(5)), frozenset(f"b{i}" for i in range(5))}
    whole = graph.components(Scratch(spark, "t"), df, "y").select("component").distinct().count()
    assert whole == 1


def test_top_k_finds_what_a_full_search_finds(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], "s" if i % 3 else "") for i in range(60)], "node long, vector array<float>, sub string")
    near = identity.top_k(identity.blocks(df, F.col("sub")), 4, tile=7).collect()
    for i in range(60):
        peers = [j for j in range(60) if bool(j % 3) == bool(i % 3)]
        best = sorted(peers, key=lambda j: (-float(v[i].astype(float) @ v[j].astype(float)), j))[:5]
        assert {r.other for r in near if r.node == i} == set(best) - {i}


def test_groups_keep_their_ids(spark):
    nodes = spark.createDataFrame([(f"n{i}", 0.5, 0.5, 1.0, float(i), 1.0, f"t{i}") for i in range(4)], "node_id string, unit_amount double, total_amount double, multipack_count double, sales_volume double, revenue double, sku string")
    parts = spark.createDataFrame([("n0", "n0"), ("n1", "n0"), ("n2", "n2"), ("n3", "n3")], "node string, component string")
    edges = spark.createDataFrame([("n0", "n1", 0.95, True)], "node_id_a string, node_id_b string, score double, predicted boolean")
    previous = spark.createDataFrame([("n2", "mlfam_000007", "mlpack_000009", 0.5)], "node_id string, ml_family_id string, ml_pack_id string, confidence_score double")
    manual = spark.createDataFrame([("n3", "mlfam_manual_x", "mlpack_manual_x")], "node_id string, target_family_id string, target_pack_id string")
    out = {r.node_id: r for r in identity.grouped(nodes, parts, edges, previous, manual).collect()}
    assert (out["n0"].mlfam_id, out["n1"].mlfam_id, out["n2"].mlfam_id, out["n3"].mlfam_id) == ("mlfam_000008", "mlfam_000008", "mlfam_000007", "mlfam_manual_x")
    assert (out["n0"].canonical_node_id, out["n0"].component_size, out["n0"].status, out["n0"].confidence) == ("n1", 2, "auto_grouped", 0.95)
    assert (out["n3"].status, out["n3"].confidence, out["n2"].status) == ("manual_singleton", None, "singleton")


def test_only_misses_are_scored(spark):
    pairs = spark.createDataFrame([("a", "b", "x", "y"), ("a", "c", "x", "z")], "node_id_a string, node_id_b string, text_a string, text_b string")
    cache = pairs.limit(1).withColumn("pair_hash", identity.pair_hash(F.col("text_a"), F.col("text_b"))).select("node_id_a", "node_id_b", "pair_hash", F.lit(0.7).alias("score"))
    every, new = identity.scored(pairs, lambda a, b: np.full(len(a), 0.2), cache)
    assert sorted(r.score for r in every.collect()) == [0.2, 0.7] and new.count() == 1


def test_splits_do_not_leak(spark):
    pairs = spark.createDataFrame([(f"r{i}", f"r{i + 1 if i % 4 else i + 2}") for i in range(0, 80)], "a string, b string")
    out = rs.component_split(pairs, {"train": 0.6, "dev": 0.2, "test": 0.2})
    assert out.count() == 80 and rs.leaking(out).count() == 0


def test_title_similarity(spark):
    df = spark.createDataFrame([("Соус чили Heinz", "чили Heinz соус 350 г"), ("a", None)], "x string, y string")
    a, b = [r[0] for r in df.select(rs.title_similarity(F.col("x"), F.col("y"))).collect()]
    assert a == 1.0 and b == 0.0


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿SKU;Название\n1;\"а;б\"\n2\n".encode())
    (tmp_path / "b.csv").write_bytes("SKU,Название\n1,я\n".encode("cp1251"))
    assert [f.rsplit("/", 1)[1] for f in files.list_csv(spark, f"file://{tmp_path}")] == ["a.csv", "b.csv"]
    a = files.read_any_csv(spark, f"file://{tmp_path}/a.csv")
    assert a.columns == ["SKU", "Название"] and [tuple(r) for r in a.collect()] == [("1", "а;б"), ("2", None)]
    assert files.read_any_csv(spark, f"file://{tmp_path}/b.csv").first()["Название"] == "я"
    files.write_csv(a, f"file://{tmp_path}/out")
    [part] = list((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes().startswith("﻿SKU;Название\n".encode())
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("in.csv", "a;b\n")
    assert [(r.name, bytes(r.content)) for r in files.zipped_csv(spark, [f"file://{tmp_path}/z.zip"]).collect()] == [("in.csv", b"a;b\n")]
    with sqlite3.connect(tmp_path / "s.db") as con:
        con.execute("CREATE TABLE row_states (row_index INTEGER, status TEXT, final_label TEXT, updated_at TEXT)")
        con.execute("INSERT INTO row_states VALUES (1, 'done', 'same', 'now')")
    assert files.label_states(spark, str(tmp_path / "s.db")).first().final_label == "same"


def test_combo_stream_resets_at_the_gap(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    rows_ = [("t", "2024-01-01 00:00:00", 1, 1), ("t", "2024-01-01 00:05:00", 2, 2), ("t", "2024-01-01 00:09:59", 3, 3)]
    df = spark.createDataFrame(rows_, "team string, at string, amount long, id long").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(folder)
    stream = streams.combo_updates(spark.readStream.schema(df.schema).parquet(folder))
    query = stream.writeStream.outputMode("update").format("memory").queryName("combos").option("checkpointLocation", f"{shared_folder(spark)}/combos").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.combo, r.amount, r.answers) for r in spark.table("combos").collect()) == [(1, 1, 1), (2, 5, 2)]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert entry.entry(spark).columns[0] == "period"


def test_filter_language():
    from tallyforge.operators.records import filter_model

    assert filter_model(" ") is None
    assert filter_model("'a'") == {"filterType": "text", "type": "contains", "filter": "a"}
    assert filter_model("'a' | NOT 'b'")["operator"] == "OR"
    for bad in ("a", "'a' & 'b' | 'c'", "'a' 'b'"):
        with pytest.raises(ValueError, match="filter"):
            filter_model(bad)


def test_records_keep_order_and_case(spark):
    from tallyforge.operators.records import product_records

    data = [("Ozon", "1", " ", "B", "x", 1.0, 1), ("ozon ", "1", "T", None, "X", 2.0, 2), ("Ozon", "1", "U", "C", "y", 3.0, 3)]
    r = product_records(spark.createDataFrame(data, "marketplace string, sku string, title string, brand string, subcategory string, units double, o int"), "o").first()
    assert (r.raw_record_id, r.title, r.brand, r.subcategories, r.units, r.n_rows) == ("ozon::1", "T", "B", "x|y", 6.0, 3)
