"""Small summaries that reports, research and state share: counts, profiles, pivots, latest rows and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import exact_sum, number_of
from tallyforge.operators.reports import period_index
from tallyforge.schema import REVENUE, SALES, need, q


def task_summary(cube: DataFrame) -> DataFrame:
    """How many categories, months and marketplaces there are."""
    return cube.agg(F.countDistinct("__category_key").alias("categories"), F.countDistinct(period_index(F.col("__year"), F.col("__month"))).alias("months"), F.countDistinct("__marketplace_code").alias("marketplaces"))


def group_totals(cube: DataFrame, by: Mapping[str, str]) -> DataFrame:
    """n_rows, units and revenue by columns, given as name: column."""
    units, money = (number_of(cube, need(cube.columns, c)) for c in (SALES, REVENUE))
    return cube.groupBy(*(F.col(q(c)).alias(n) for n, c in by.items())).agg(F.count(F.lit(1)).alias("n_rows"), exact_sum(units).alias("units"), exact_sum(money).alias("revenue"))


def latest(df: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """The value of the latest row of each key, and when that was."""
    return df.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def plan_lookup(registry: DataFrame, count: str = "rows_count") -> DataFrame:
    """Every month of a category in every marketplace that there is, with the rows that the cube holds of it. The
    marketplaces are one row with a list, so plan rows multiply without meeting each other."""
    keys = ["__year", "__month", "__marketplace_code", "__category_key"]
    places = registry.agg(F.collect_set("__marketplace_code").alias("_places"))
    plan = registry.select("__year", "__month", "__category_key").distinct().crossJoin(places).withColumn("__marketplace_code", F.explode("_places"))
    return plan.select(*keys).join(registry.select(*keys, count), keys, "left").select(*keys, F.col(count).isNotNull().alias("in_cube"), count)


def quantiles(df: DataFrame, by: Sequence[str], value: Column, wanted: Mapping[str, float]) -> DataFrame:
    """Exact quantiles, linear between ranks, by group."""
    return df.groupBy(*by).agg(*(F.percentile(value, F.lit(p)).alias(n) for n, p in wanted.items()))


def group_size(df: DataFrame, by: Sequence[str], name: str = "size") -> DataFrame:
    """``df`` with the number of rows of each row's group."""
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*(q(b) for b in by))))


def family_candidates(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums, number of nodes and first brand of families, by further columns."""
    return nodes.groupBy(*by).agg(exact_sum(F.col("revenue")).alias("revenue"), exact_sum(F.col("sales_volume")).alias("units"), F.count(F.lit(1)).alias("nodes"), F.min("brand").alias("brand"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of each row value by the column's named values, 0 where there are none."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def pivoted(df: DataFrame, row: str, column: str, values: Sequence[str], metric: Column) -> DataFrame:
    """A metric of each row value by the column's named values, NULL where there is none."""
    return df.groupBy(row).pivot(column, list(values)).agg(metric)


def flag_counts(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """How many rows each condition holds for."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in flags.items()))


def record_profile(cube: DataFrame, article: str = "Артикул", marketplace: str = "__marketplace_code") -> DataFrame:
    """raw_rows, records (articles of a marketplace), articles, and those that several marketplaces share."""
    x = cube.groupBy(q(article)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(marketplace).alias("m"))
    return x.agg(F.sum("n").alias("raw_rows"), F.sum("m").alias("records"), F.count(F.lit(1)).alias("articles"), F.count_if(F.expr("m > 1")).alias("shared"))


def described(df: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """n, lo, hi and quantiles of a value by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), *(F.percentile(value, F.lit(p)).alias(n) for n, p in wanted.items()))


def top_values(df: DataFrame, value: Column, name: str, n: int) -> DataFrame:
    """The most frequent values, ties by value."""
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)


def largest(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The rows of the largest values, ties by key."""
    return df.orderBy(F.desc(value), key).limit(n)


def duplicates(df: DataFrame, by: Sequence[str], least: int = 2) -> DataFrame:
    """Values that at least so many rows have, with their number."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def dictionary_sums(df: DataFrame, names: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Rows and sum of a value by the name that a dictionary (key, name) gives their key."""
    return df.join(names, key).groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"), exact_sum(F.col(value)).alias(value))


def same(a: Column, b: Column) -> Column:
    """Equal, where NULL equals NULL; never NULL."""
    return a.eqNullSafe(b)
