"""The pipeline on odd tables: nulls, repeated rows, empty tables, columns whose names operators use."""

import random

import pytest

import corpus_pipeline
from test_operators import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone string, probability double, topic string, node long"


def _write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, SCHEMA).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, extra string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def _row(i, text, lang="en", source="src0"):
    return (i, text, lang, source, None if text is None else len(text), "g", 0.5, "t", 7)


@pytest.mark.parametrize("empty", ["none", "labels", "benchmark", "documents", "all"])
def test_pipeline_on_odd_tables(spark, tmp_path, empty):
    rng = random.Random(6)
    rows = [_row(i, words(rng, 40, 900)) for i in range(40)]
    twice = words(rng, 30, 900)
    rows += [_row(100, None), _row(101, ""), _row(102, " \n "), _row(None, words(rng, 20)), _row(103, "é ü", None, None), _row(104, twice), _row(104, twice), _row(104, words(rng, 30, 900)), _row(105, words(rng, 20_000, 9000))]
    labels = [(i, 1, 0, "x") for i in range(20)] + [(None, 1, 0, "x"), (3, None, None, None), (999, 0, 1, "x")]
    items = [(1, words(rng, 20, 900)), (None, "a b c"), (2, None), (3, "")]
    folder = f"file://{tmp_path}"
    _write(spark, folder, [] if empty in ("documents", "all") else rows, [] if empty in ("labels", "all") else labels, [] if empty in ("benchmark", "all") else items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert docs.columns[: len(columns)] == columns
        if k < 4:
            assert docs.columns == columns
            if empty == "labels" and k == 0:
                assert docs.count() == len(rows)
    assert (docs.count() > 0) == (empty not in ("documents", "all"))
