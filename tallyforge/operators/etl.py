"""From marketplace reports to one standard table: columns, names in files, merging and cleaning."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import num_or_zero
from tallyforge.functions.weights import dayfirst_date
from tallyforge.operators import rules
from tallyforge.operators.cube import sales_quantile
from tallyforge.schema import CANON, SALES, need, q

# Month labels, service columns, and the names that merged files change.
MONTHS = ("янв.", "фев.", "мар.", "апр.", "май", "июн.", "июл.", "авг.", "сен.", "окт.", "ноя.", "дек.")
SERVICE = ("Вес, кг сырой", "Вес аномалия", "Вес причина", "Объем, кг")
MERGE_NAMES = {"Продажи": "Продажи, шт", "Средняя цена": "Средняя цена, руб", "Выручка": "Выручка, руб"}
ENGLISH = {
    "Бренд": ("brand",),
    "Название": ("name",),
    "Продажи": ("sales",),
    "Продавец": ("seller",),
    "Выручка": ("revenue",),
    "Средняя цена": ("average price", "average_price", "final_price_average", "price"),
}
MOST_SALES = 40_000.0

_DATES = ((re.compile(r"((?:20|19)\d{2})[._-](\d{2})[._-](\d{2})"), (1, 2, 3)), (re.compile(r"(\d{2})[._-](\d{2})[._-]((?:20|19)\d{2})"), (3, 2, 1)), (re.compile(r"\b((?:19|20)\d{2})(\d{2})(\d{2})\b"), (1, 2, 3)))


def filename_date(name: str) -> date | None:
    """The earliest valid date in a file's name; of forms at one place, year first wins."""
    found = []
    for rank, (form, (y, m, d)) in enumerate(_DATES):
        for match in form.finditer(name):
            try:
                found.append((match.start(), rank, datetime(int(match[y]), int(match[m]), int(match[d])).date()))
            except ValueError:
                continue
    return min(found)[2] if found else None


def filename_marketplace(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("ozon"), "Ozon")
        .when(low.contains("wildberries") | low.rlike(r"(^|[\s_-])wb([\s_-]|$)"), "Wildberries")
        .when(low.contains("яндекс") | low.contains("yandex") | low.contains("маркет") | low.contains("ym"), "Яндекс.Маркет")
        .otherwise("Unknown")
    )


def filename_category(name: Column) -> Column:
    """What follows the last double underscore, without the extension."""
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    tail = F.substring_index(stem, "__", -1)
    return F.when(name.contains("__") & (tail != ""), tail).otherwise("Unknown")


def upsert_column(df: DataFrame, name: str, value: object, position: int, replace: bool) -> DataFrame:
    """A constant column at a position; one that is there stays, or is replaced in its new place."""
    if name in df.columns and not replace:
        return df
    rest = [c for c in df.columns if c != name]
    order = rest[:position] + [name] + rest[position:]
    return df.select(*(F.lit(value).alias(name) if c == name else F.col(q(c)) for c in order))


def standardise(df: DataFrame, marketplace: str) -> DataFrame:
    """A report of ``ozon``, ``wb`` or ``ym`` with the standard columns in order; what it lacks is NULL."""
    if marketplace not in ("ozon", "wb", "ym"):
        raise ValueError(f"no marketplace is called {marketplace!r}")
    names: dict[str, str] = {}
    for c in df.columns:
        low = c.strip().lower()
        for target, words in ENGLISH.items():
            if low in words and c.strip() in (low, low.capitalize()) and not (low == "price" and marketplace != "ym"):
                names.setdefault(c, target)
        if low == ("sku" if marketplace == "ym" else "id") and c.strip() != "SKU" and "SKU" not in names.values():
            names[c] = "SKU"
        if marketplace == "ym" and c == "Продаж":
            names[c] = "Продажи"
    if marketplace == "ym":
        money = next((c for c in df.columns if c.strip().startswith("Выручка")), None)
        if money:
            names = {k: v for k, v in names.items() if v != "Выручка"} | {money: "Выручка"}
        if "Выручка" not in names.values():
            raise ValueError("the report has no revenue")
    by_target: dict[str, str] = {}
    for c in df.columns:
        by_target.setdefault(names.get(c, c), c)
    return df.select(*(F.col(q(by_target[c])).alias(c) if c in by_target else F.lit(None).cast("string").alias(c) for c in CANON))


def renamed_for_merge(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in MERGE_NAMES.items() if a in df.columns and b not in df.columns})


def sales_range(df: DataFrame, least: float = 0.0, most: float = MOST_SALES) -> DataFrame:
    x = num_or_zero(F.col(q(need(df.columns, SALES))))
    return df.where((x > 0) & (x >= least) & (x < most))


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by a total order."""
    w = Window.partitionBy(*(q(k) for k in keys)).orderBy(*(q(o) for o in order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge(files: Sequence[DataFrame], least: float = 15.0, quantile: float | None = None, keys: Sequence[str] | None = None, most: float = MOST_SALES) -> tuple[DataFrame, DataFrame]:
    """(merged rows, counts of each file: rows in, kept). A file is a DataFrame with ``_row``, its row's number.

    Columns are those of the files in the order in which they are first seen; rows are filtered file by file, and of
    rows that agree in ``keys`` (all columns by default) the first, by file and row, stays. Its place is in ``_file``
    and ``_row``.
    """
    parts, counts = [], []
    for k, f in enumerate(files):
        f = renamed_for_merge(f)
        counted = f.agg(F.count(F.lit(1)).alias("rows_in"))
        kept = sales_range(f, least if quantile is None else 0.0, most)
        if quantile is not None:
            kept = sales_quantile(kept, quantile, least)
        parts.append(kept.withColumn("_file", F.lit(k)))
        counts.append(counted.withColumn("file", F.lit(k)).crossJoin(kept.agg(F.count(F.lit(1)).alias("rows_kept"))).select("file", "rows_in", "rows_kept"))
    rows, count = parts[0], counts[0]
    for p, n in zip(parts[1:], counts[1:], strict=True):
        rows, count = rows.unionByName(p, allowMissingColumns=True), count.union(n)
    own = [c for c in rows.columns if c not in ("_file", "_row")]
    return first_of_each(rows, list(keys or own), ["_file", "_row"]), count


def month_label(c: Column) -> Column:
    return F.element_at(F.array(*(F.lit(m) for m in MONTHS)), F.month(dayfirst_date(c)))


def prepared_for_rules(df: DataFrame) -> DataFrame:
    """Undo the swap of names after classification."""
    if "Название" in df.columns:
        return df
    if {"SKU", "Артикул"} <= set(df.columns):
        return df.withColumnsRenamed({"SKU": "Название", "Артикул": "SKU"})
    raise KeyError("rules need the column Название, or SKU and Артикул")


def postprocessed(df: DataFrame) -> DataFrame:
    """After classification: no service columns, the month after the date, the title called SKU and the id Артикул."""
    out = df.drop(*SERVICE)
    if "Дата" in out.columns:
        rest = [c for c in out.columns if c != "месяц"]
        at = rest.index("Дата") + 1
        out = out.select(*(F.col(q(c)) for c in rest[:at]), month_label(F.col("Дата")).alias("месяц"), *(F.col(q(c)) for c in rest[at:]))
    return out.select(*(F.col(q(c)).alias({"SKU": "Артикул", "Название": "SKU"}.get(c, c)) for c in out.columns))


@dataclass(frozen=True)
class Classified:
    """The classified rows; rows written by each rule; which columns went and which changed their names."""

    rows: DataFrame
    report: DataFrame
    dropped: tuple[str, ...]
    renamed: dict[str, str]


def classify(df: DataFrame, rule_rows: Iterable[Mapping[str, object]], fill: Mapping[str, str] | None = None, overrides: Iterable[Mapping[str, object]] = (), slice_category: str | None = None, category: str = "Категория") -> Classified:
    """A parsed report through rules, cleaning and manual overrides, in that order. ``slice_category`` leaves out rules
    that can't reach rows of that category."""
    ready = prepared_for_rules(df)
    compiled = rules.compiled(rule_rows)
    done = rules.apply(ready, compiled, category, fill, slice_category, report=True)
    rows = postprocessed(done.drop("_applied", "_matched"))
    overrides = list(overrides)
    gone = tuple(c for c in SERVICE if c in ready.columns)
    renamed = {a: b for a, b in (("SKU", "Артикул"), ("Название", "SKU")) if a in ready.columns}
    return Classified(rules.override(rows, overrides) if overrides else rows, rules.rule_report(done, compiled), gone, renamed)


def weight_names(df: DataFrame) -> DataFrame:
    """Old names of the weight columns as the new ones."""
    if "Вес, кг (сумм.)" not in df.columns:
        return df
    return df.withColumnsRenamed({"Вес, кг": "Вес, кг (ед.)", "Вес, кг (сумм.)": "Вес, кг"})


def flattened(c: Column, kind: str) -> Column:
    """A nested value of an API as text: of a map its ``name``, else ``key: value`` pairs; of a list its items."""
    if kind == "map":
        return F.coalesce(F.element_at(c, "name"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; "))
    return F.array_join(c, ", ")

