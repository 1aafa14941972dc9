"""Reports over the cube: periods by marketplace, category and further dimensions.

A report is planned from the columns that are there and becomes one aggregation. Its distinct count of titles is folded
into the same shuffle by Catalyst; partial aggregation runs before it. Sums are exact, so results don't depend on the
order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbers import exact_sum, num, number_of, safe_div
from tallyforge.functions.text import dimension
from tallyforge.schema import CLASS_DIMENSIONS, NOT_FILLED, REVENUE, SALES, VOLUME_KG, VOLUME_T, first_of, need, q, require_metadata

KINDS = ("category_month", "brand_month", "classification_month", "top_sku")
GROUPS = ("ML-группа товара", "ML-группа фасовки", "ML-канонический SKU", "ML-dedup статус")
ORDER = ("Год", "Месяц", "Категория", "Маркетплейс", "Бренд", "Тип", "Подкатегория", *GROUPS)
METRICS = ("Строк", "SKU, шт", "Продажи, шт", "Выручка, руб", "Объем, кг", "Средняя цена, руб", "Цена за кг, руб")
TOP_LEAST, TOP_MOST = 100, 100_000


@dataclass(frozen=True)
class ReportSpec:
    """kind; project; categories (None: all); first and last period as year * 12 + month; rows of a top report."""

    kind: str
    project: str
    categories: tuple[str, ...] | None = None
    first: int | None = None
    last: int | None = None
    rows: int = 10_000

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"no report is called {self.kind!r}; there are {', '.join(KINDS)}")
        if self.first is not None and self.last is not None and self.first > self.last:
            raise ValueError("the first period is after the last")
        object.__setattr__(self, "rows", max(TOP_LEAST, min(TOP_MOST, self.rows)))


def period_label(year: Column, month: Column) -> Column:
    return F.format_string("%04d-%02d", year.cast("int"), month.cast("int"))


def period_index(year: Column, month: Column) -> Column:
    return (year.cast("int") * 12 + month.cast("int")).cast("int")


def index_label(index: Column) -> Column:
    """The label of a period index."""
    return F.format_string("%04d-%02d", F.floor((index - 1) / 12).cast("int"), (F.pmod(index - 1, F.lit(12)) + 1).cast("int"))


def in_scope(df: DataFrame, project: str, categories: Sequence[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of a project, of categories and periods; the conditions reach the partitions of the cube's files."""
    df = df.where(F.col("__project_name") == project)
    if categories is not None:
        df = df.where(F.col("__category_key").isin(list(categories)))
    index = period_index(F.col("__year"), F.col("__month"))
    if first is not None:
        df = df.where((F.col("__year") >= (first - 1) // 12) & (index >= first))
    if last is not None:
        df = df.where((F.col("__year") <= (last - 1) // 12) & (index <= last))
    return df


def volume_kg(columns: Sequence[str]) -> Column:
    """Kilograms: their own column, else tonnes, else zero."""
    if c := first_of(columns, VOLUME_KG):
        return F.coalesce(num(F.col(q(c))), F.lit(0.0))
    if c := first_of(columns, VOLUME_T):
        return F.coalesce(num(F.col(q(c))) * 1000.0, F.lit(0.0))
    return F.lit(0.0)


def _volume(df: DataFrame) -> Column:
    """As ``volume_kg``, of typed columns where there are any."""
    c = first_of(df.columns, VOLUME_KG)
    return F.coalesce(number_of(df, c), F.lit(0.0)) if c else volume_kg(df.columns)


def _dimensions(df: DataFrame, kind: str) -> dict[str, Column]:
    have = lambda c: F.col(q(c)) if c in df.columns else None
    out = {
        "Период": period_label(F.col("__year"), F.col("__month")),
        "Год": F.col("__year").cast("int"),
        "Месяц": F.col("__month").cast("int"),
        "Маркетплейс": dimension(have("Маркетплейс"), F.col("__marketplace_code")),
        "Категория": dimension(have("Категория"), F.col("__category_key")),
    }
    if kind == "brand_month":
        out["Бренд"] = dimension(have("Бренд"))
    elif kind == "classification_month":
        out |= {c: dimension(have(c)) for c in CLASS_DIMENSIONS if c in df.columns}
    elif kind == "top_sku":
        out |= {c: dimension(have(c)) for c in ("SKU", "Название", "Бренд", "Тип", "Подкатегория") if c in df.columns}
        out |= {c: F.coalesce(F.col(q(c)).cast("string"), F.lit("")) for c in GROUPS if c in df.columns}
    return out


def metrics(df: DataFrame) -> dict[str, Column]:
    """The report's aggregates, by name."""
    sku = F.nullif(F.trim(F.col(q(first_of(df.columns, ("SKU", "Название", "Артикул")) or "__row_hash")).cast("string")), F.lit(""))
    sales = exact_sum(F.coalesce(number_of(df, need(df.columns, SALES)), F.lit(0.0)))
    revenue = first_of(df.columns, REVENUE)
    money = exact_sum(F.coalesce(number_of(df, revenue), F.lit(0.0))) if revenue else F.lit(0.0)
    kg = exact_sum(_volume(df))
    values = (F.count(F.lit(1)), F.countDistinct(sku), sales, money, kg, safe_div(money, sales), safe_div(money, kg))
    return dict(zip(METRICS, values, strict=True))


def report(cube: DataFrame, spec: ReportSpec) -> DataFrame:
    """The report's rows, without order; see ``ordered``."""
    require_metadata(cube)
    rows = in_scope(cube, spec.project, spec.categories, spec.first, spec.last)
    dims = _dimensions(rows, spec.kind)
    return rows.groupBy(*(c.alias(n) for n, c in dims.items())).agg(*(c.alias(n) for n, c in metrics(rows).items()))


def places(rows: DataFrame) -> list[Column]:
    """The order of a report's rows by period and dimensions."""
    first = [c for c in ORDER if c in rows.columns]
    return [F.col(q(c)).asc_nulls_last() for c in [*first, *(c for c in rows.columns if c not in METRICS and c not in first)]]


def ordered(rows: DataFrame, spec: ReportSpec) -> DataFrame:
    """A report in its order: a top report by revenue and sales, limited; the others by period and dimensions, NULLs
    last. All dimensions break ties."""
    dims = places(rows)
    if spec.kind == "top_sku":
        return rows.orderBy(F.col(q("Выручка, руб")).desc_nulls_last(), F.col(q("Продажи, шт")).desc_nulls_last(), *dims).limit(spec.rows)
    return rows.orderBy(*dims)


def breakdown(cube: DataFrame, project: str, categories: Sequence[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows by year, month, category and marketplace, with their smallest names."""
    rows = in_scope(cube, project, categories, first, last)
    name = lambda c, key: F.min(dimension(F.col(q(c)) if c in rows.columns else None, F.col(key)))
    keys = ("__year", "__month", "__category_key", "__marketplace_code")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), name("Категория", "__category_key").alias("category"), name("Маркетплейс", "__marketplace_code").alias("marketplace"))


def categories(cube: DataFrame, project: str) -> DataFrame:
    rows = in_scope(cube, project)
    name = lambda c, key: F.min(dimension(F.col(q(c)) if c in rows.columns else None, F.col(key)))
    return rows.groupBy("__category_key", "__marketplace_code").agg(F.count(F.lit(1)).alias("rows"), name("Категория", "__category_key").alias("category"), name("Маркетплейс", "__marketplace_code").alias("marketplace"))


def period_bounds(cube: DataFrame, project: str) -> DataFrame:
    index = period_index(F.col("__year"), F.col("__month"))
    return in_scope(cube, project).agg(F.min(index).alias("first_index"), F.max(index).alias("last_index"), F.count(F.lit(1)).alias("rows"))


__all__ = ["NOT_FILLED", "ReportSpec", "breakdown", "categories", "in_scope", "index_label", "metrics", "ordered", "period_bounds", "period_index", "period_label", "report", "volume_kg"]
