"""Fingerprints over ranges: any number of ranges gives the same rows, and one doc_id of many texts is dealt out."""

import random

from pyspark.sql import functions as F

from tallyforge.llm import op06_fingerprints as op06


def test_ranges_do_not_change_rows(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abcdef ") for _ in range(rng.randrange(60)))
    rows = [(rng.choice([None, -(1 << 63), 5, 5, 5, 5, *range(40)]), text()) for _ in range(300)] + [(5, "the same")] * 50 + [(7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    one, many = ([tuple(r) for r in op06.fingerprints(docs, rows_per_range=n).collect()] for n in (1000, 3))
    assert len(one) == len(rows) and sorted(map(repr, one)) == sorted(map(repr, many))


def test_one_id_of_many_texts_has_many_ranges(spark):
    docs = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    keyed = docs.withColumn("h", F.xxhash64("text"))
    sizes = [r["count"] for r in op06._placed(keyed, op06._cuts(keyed, 100, 400), 8).groupBy("part").count().collect()]
    assert len(sizes) > 80 and max(sizes) < 20
