"""Queries read their whole tables: rows against the queries' SQL with its slices taken out here, or against brute force."""

from functools import cache

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: What the SQL keeps of a table besides what the operator asks for.
SLICES = (
    " WHERE vec_id < 300", " WHERE vec_id < 200", " WHERE vec_id < 150", " AND node % 3 <> 0",
    " WHERE o_orderkey % 400 = 1", " WHERE ok <= 100", " AND ok <= 100", " WHERE ok < 2000", " WHERE p_partkey % 3 > 0", " WHERE y = 1995", " WHERE y = 1999", " WHERE y = 2001", " WHERE y = 1996 AND mo = 2", " WHERE y = 1997 AND mo = 3",
    " LIMIT 200", " LIMIT 300",
)


def whole(sql: str) -> str:
    for x in SLICES:
        sql = sql.replace(x, "")
    return sql


def same(got, expected) -> None:
    """The same rows in any order; floats, which some queries round to three places, within one of the third."""
    split = lambda rows: sorted((repr([x for x in r if not isinstance(x, float)]), [x for x in r if isinstance(x, float)]) for r in rows)
    a, b = split(tuple(r) for r in got), split(expected)
    assert a and [k for k, _ in a] == [k for k, _ in b]
    assert np.allclose([x for _, f in a for x in f], [x for _, f in b for x in f], rtol=1e-12, atol=1.1e-3)


def expected(name: str, folder: str = FOLDER) -> list:
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "orders", "part", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(whole(entry.oracle_sql()[name])).fetchall()


@cache
def vectors() -> tuple[list[int], np.ndarray, list[int]]:
    t = pq.read_table(f"{FOLDER}/embeddings.parquet").sort_by("vec_id")
    return t["vec_id"].to_pylist(), np.array(t["embedding"].to_pylist(), float), t["label"].to_pylist()


def near(k: int) -> set[tuple[int, int]]:
    """(node, other): the k + 1 best of the same label, self among them but left out."""
    ids, v, label = vectors()
    score = v @ v.T
    best = {i: sorted((j for j in range(len(ids)) if label[j] == label[i]), key=lambda j: (-score[i, j], j))[: k + 1] for i in range(len(ids))}
    return {(ids[i], ids[j]) for i, js in best.items() for j in js if i != j}


@pytest.mark.parametrize("name", ["j17_topk_join", "m4_candidate_pairs", "m31_cosine", "m12_connected_components", "a31_component_sizes", "j13_component_map", "m15_modularity", "a49_node_score_stats", "m5_scoped_topk"])
def test_vector_queries_read_all_vectors(spark, name):
    same(entry.queries()[name](spark, FOLDER).collect(), expected(name))


def test_top_k_of_all_vectors_by_brute_force(spark):
    assert {(r.node, r.other) for r in entry.queries()["j17_topk_join"](spark, FOLDER).collect()} == near(5)


def test_groups_of_all_vectors(spark):
    pairs = {(min(p), max(p)) for p in near(2)}
    split = [(r.a, r.b) for r in entry.queries()["m30_component_split"](spark, FOLDER).collect()]
    assert len(split) == len(pairs) and set(split) == pairs
    for name, edges in (("m13_leiden_families", near(5)), ("m14_label_propagation", pairs)):
        parts = entry.queries()[name](spark, FOLDER).collect()
        assert sorted(r.node for r in parts) == sorted({x for p in edges for x in p})


@pytest.mark.parametrize("name", ["a41_monthly_dynamics", "f7_hash_exclusion", "a20_graph_report", "p12_row_hash", "w9_group_size", "p11_visible_columns", "k2_decimal_comma", "k4_typed_export"])
def test_queries_read_all_orders_parts_and_cube_rows(spark, name):
    same(entry.queries()[name](spark, FOLDER).collect(), expected(name))


def test_titles_of_all_articles(spark):
    folder = "/root/testdata/sf0.01"  # the first orders of smaller tables hold all articles
    same(entry.queries()["x14_family_title"](spark, folder).collect(), expected("x14_family_title", folder))


@pytest.mark.parametrize("name", ["o1_report_order", "o2_export_order"])
def test_orders_place_all_rows(spark, name):
    assert [tuple(r) for r in entry.queries()[name](spark, FOLDER).collect()] == expected(name)
