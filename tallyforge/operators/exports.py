"""Filtered exports: predicates, order, paging and columns of what leaves the cube."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbers import filter_num
from tallyforge.functions.text import decimal_comma
from tallyforge.schema import SEARCHED, q, visible

MATCHES = ("contains", "not_contains", "startswith", "equals", "gt", "gte", "lt", "lte")
# Columns that keep their decimal points.
POINT_COLUMNS = frozenset("дата sku продавец категория бренд год месяц подкатегория тип".split())
DEFAULT_ORDER = ("__year", "__month", "Категория", "Маркетплейс", "Бренд", "SKU")


def column_filter(column: str, match: str, value: str) -> Column:
    """A filter as users write it; ``%`` and ``_`` in it are wildcards. Unknown matches mean ``contains``."""
    c = F.col(q(column)).cast("string")
    if match in ("gt", "gte", "lt", "lte"):
        try:
            n = float(value.strip().replace(",", "."))
        except ValueError:
            raise ValueError(f"{value!r} is no number") from None
        x = filter_num(c)
        return {"gt": x > n, "gte": x >= n, "lt": x < n, "lte": x <= n}[match]
    if match == "equals":
        return c == value
    text = value.lower()
    if match == "startswith":
        return F.lower(c).like(f"{text}%")
    if match == "not_contains":
        return ~F.coalesce(F.lower(c).like(f"%{text}%"), F.lit(False))
    return F.lower(c).like(f"%{text}%")


def filtered(df: DataFrame, filters: Sequence[Mapping[str, str]] = (), excluded_hashes: Sequence[str] = ()) -> DataFrame:
    """All filters hold. A blank value, a column that isn't there or a hidden one is no filter. Excluding hashes also
    drops rows without one."""
    for f in filters:
        column, value = f.get("column", ""), str(f.get("value", ""))
        if value.strip() and column in df.columns and not column.startswith("__"):
            df = df.where(column_filter(column, f.get("match", "contains"), value))
    if excluded_hashes:
        df = df.where(~F.col("__row_hash").isin(list(excluded_hashes)))
    return df


def search(df: DataFrame, text: str | None = None, columns: Sequence[str] = SEARCHED) -> DataFrame:
    """Rows with the text in any of the columns, in any case."""
    there = [c for c in columns if c in df.columns]
    if not text or not text.strip() or not there:
        return df
    found = F.lit(False)
    for c in there:
        found = found | F.coalesce(F.lower(F.col(q(c)).cast("string")).like(f"%{text.strip().lower()}%"), F.lit(False))
    return df.where(found)


def ordered(df: DataFrame, by: str | None = None, descending: bool = False, ties: Sequence[str] = ("__row_hash",)) -> DataFrame:
    """By a visible column, NULLs last, else by the default columns that are there; ``ties`` make it total."""
    direct = lambda c: F.col(q(c)).desc_nulls_last() if descending and c == by else F.col(q(c)).asc_nulls_last()
    keys = [by] if by in visible(df.columns) else [c for c in DEFAULT_ORDER if c in df.columns]
    return df.orderBy(*(direct(c) for c in [*keys, *(t for t in ties if t in df.columns)]))


def page(df: DataFrame, limit: int = 100, offset: int = 0, most: int = 500) -> DataFrame:
    return df.offset(max(0, offset)).limit(max(1, min(most, limit)))


def projected(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(*(F.col(q(c)) for c in visible(df.columns, columns)))


def with_decimal_commas(df: DataFrame) -> DataFrame:
    """Every column as text; numbers with decimal commas but in the columns that keep points."""
    return df.select(*((F.col(q(c)).cast("string") if c.strip().lower() in POINT_COLUMNS else decimal_comma(F.col(q(c)))).alias(c) for c in df.columns))


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns cast as named: integer, double, timestamp, date (as text); what doesn't parse is NULL."""
    from tallyforge.functions.numbers import num

    def cast(c: str) -> Column:
        x, kind = F.col(q(c)), types.get(c)
        if kind == "integer":
            return F.floor(num(x)).cast("long")
        if kind == "double":
            return num(x)
        if kind == "timestamp":
            return F.try_to_timestamp(x.cast("string"))
        if kind == "date":
            return F.date_format(x.cast("string").try_cast("date"), "yyyy-MM-dd")
        return x.cast("string")

    return df.select(*(cast(c).alias(c) for c in df.columns))


#: Columns that a search of grouped products reads.
GROUPED_SEARCHED = ("normalized_sku", "canonical_sku", "sku", "brand", "article", "category_name", "marketplace")


def grouped_products(rows: DataFrame, project: str, category: str | None = None, groups: DataFrame | None = None, level: str = "all", text: str | None = None) -> DataFrame:
    """Grouped products of a project by category, level and a text in any case in any of seven columns.

    ``groups``: group_key, source_key of categories that are grouped together. A group's key also finds its sources'
    rows; a source's key finds its own rows and its group's. ``level``: ``canonical`` for canonical rows alone.
    """
    out = rows.where(F.col("project_name") == project)
    if category is not None and category.strip():
        key = category.strip()
        wanted = rows.sparkSession.createDataFrame([(key,)], "category_key string")
        if groups is not None:
            wanted = wanted.union(groups.where(F.col("group_key") == key).select("source_key")).union(groups.where(F.col("source_key") == key).select("group_key"))
        out = out.join(wanted.distinct(), "category_key", "left_semi")
    if level == "canonical":
        out = out.where("row_level = 'canonical'")
    if text and text.strip():
        needle, found = F.lit(text.strip().casefold()), F.lit(False)
        for c in GROUPED_SEARCHED:
            found = found | F.coalesce(F.lower(F.col(q(c)).cast("string")).contains(needle), F.lit(False))
        out = out.where(found)
    return out


def with_groups(cube: DataFrame, groups: DataFrame, enabled: bool = True) -> DataFrame:
    """The cube with its identity columns; rows stay as many as they are.

    ``groups`` has project_name, category_key, marketplace_code, article and the columns to attach; its key must be
    unique, which is checked on keys alone. The article of a row is its own column, else a hash of the row.
    """
    if not enabled:
        return cube
    keys = ["project_name", "category_key", "marketplace_code", "article"]
    twice = groups.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"an article has two groups: {twice[0][:4]}")
    own = [F.nullif(F.trim(F.col(q(c)).cast("string")), F.lit("")) for c in ("Артикул", "__business_row_hash", "__row_hash") if c in cube.columns]
    article = F.coalesce(*own)
    sides = [F.col("__project_name") == groups["project_name"], F.col("__category_key") == groups["category_key"], F.col("__marketplace_code") == groups["marketplace_code"], article == groups["article"]]
    return cube.join(groups, sides, "left").drop(*(groups[k] for k in keys))
