"""A cube made of the test tables, so that the engine's operators run on data of any scale; and the same in SQL."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import storage
from tallyforge.functions.numbers import with_numbers
from tallyforge.operators.cube import NUMBERS, with_hashes

PROJECT = "demo"
SOURCE_COLUMNS = ("Маркетплейс", "Категория", "Артикул", "SKU", "Бренд", "Подкатегория", "Продажи, шт", "Выручка, руб", "Объем, кг", "Вес, кг (ед.)", "Вес, кг")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SOURCES = ("lineitem", "orders", "part", "supplier", "nation", "region")
#: Goes up whenever loaded rows would differ.
VERSION = 1


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube of a folder's tables, as it is loaded once and then read: partitioned by year and month, ordered by
    category within a file, with typed twins of number columns. A folder whose tables change is loaded again."""
    stamp = "|".join(str(x) for x in (VERSION, sf_dir, *(storage.stamp(spark, f"{sf_dir}/{t}.parquet") for t in SOURCES)))
    folder = f"{storage.shared_folder(spark)}/tallyforge-cube-{hashlib.sha1(stamp.encode()).hexdigest()[:16]}"
    rows = with_numbers(sales(spark, sf_dir), NUMBERS)
    if not storage.exists(spark, f"{folder}/_SUCCESS"):
        stage = f"{folder}.stage-{uuid.uuid4().hex}"
        rows.repartition("__year", "__month").sortWithinPartitions("__year", "__month", "__category_key").write.partitionBy("__year", "__month").parquet(stage)
        try:
            if not storage.exists(spark, folder):
                storage.move(spark, stage, folder)
        except OSError:
            if not storage.exists(spark, f"{folder}/_SUCCESS"):
                raise
        #: Another session may have been first: some stores then refuse to move, others move into the folder.
        storage.delete(spark, stage)
        storage.delete(spark, f"{folder}/{stage.rsplit('/', 1)[1]}")
    return spark.read.schema(rows.schema).parquet(folder).select(*(f"`{c}`" for c in rows.columns))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as sales: the month of the order, the supplier's region as marketplace, the part's type as category.
    Numbers are text with decimal commas, as reports bring them. Small tables are joined by size, not by hint."""
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(place.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    comma = lambda e: F.replace(F.expr(e).cast("string"), F.lit("."), F.lit(","))
    return rows.select(
        F.lit(PROJECT).alias("__project_name"),
        F.year("o_orderdate").alias("__year"),
        F.month("o_orderdate").alias("__month"),
        F.lower("r_name").alias("__marketplace_code"),
        F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))).alias("__category_key"),
        F.lit("category").alias("__source_type"),
        F.lit("run-1").alias("__run_id"),
        F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("__row_hash"),
        F.col("r_name").alias("Маркетплейс"),
        F.col("p_type").alias("Категория"),
        F.col("l_partkey").cast("string").alias("Артикул"),
        F.col("p_name").alias("SKU"),
        F.col("p_brand").alias("Бренд"),
        F.concat(F.lit("size "), F.expr("p_size div 10").cast("string")).alias("Подкатегория"),
        comma("cast(l_quantity as decimal(12,2))").alias("Продажи, шт"),
        comma("cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))").alias("Выручка, руб"),
        comma("cast(l_quantity as decimal(12,2)) * p_size / 1000").alias("Объем, кг"),
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as an import stages them: text columns only, with a hash of each."""
    df = sales(spark, sf_dir)
    shown = [c for c in df.columns if not c.startswith("__")]
    return with_hashes(df.drop("__row_hash"), shown)


CUBE = """cube AS (SELECT 'demo' AS project, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo, lower(r_name) AS mp, r_name AS market, p_type AS cat,
 lower(replace(p_type, ' ', '_')) AS ck, CAST(l_partkey AS VARCHAR) AS art, p_name AS sku, p_brand AS brand, 'size ' || CAST(p_size // 10 AS VARCHAR) AS sub,
 CAST(l_quantity AS DECIMAL(12,2)) AS qty, CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS rev,
 CAST(CAST(l_quantity AS DECIMAL(12,2)) * p_size * 0.001 AS DECIMAL(18,6)) AS kg, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid, l_orderkey AS ok, l_linenumber AS ln
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
