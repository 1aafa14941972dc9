"""Columns of reports and of the cube, and how a query finds them.

Sources name the same thing differently, so operators ask for a role and take the first column that is there.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

# Column names of the marketplace reports and of the cube.
SALES = ("Продажи, шт", "Продажи", "sales")
REVENUE = ("Выручка, руб", "Выручка", "revenue")
VOLUME = ("Объем, кг", "Объём, кг", "Объем, т", "Объём, т", "Объем", "Объём", "volume", "volume_kg", "volume_t")
VOLUME_KG = ("Объем, кг", "Объём, кг", "volume_kg")
VOLUME_T = ("Объем, т", "Объём, т", "volume_t")
CLASS_DIMENSIONS = ("Тип", "Подкатегория", "Вид", "Вид мяса", "Сегмент")
SEARCHED = ("SKU", "Название", "Бренд", "Артикул", "Категория")
CANON = ("Дата", "Маркетплейс", "Категория", "SKU", "Бренд", "Название", "Продажи", "Продавец", "Средняя цена", "Выручка")
METADATA = (
    "__run_id",
    "__source_file",
    "__imported_at",
    "__project_name",
    "__year",
    "__month",
    "__marketplace_code",
    "__source_type",
    "__category_key",
    "__row_hash",
    "__business_row_hash",
)
REQUIRED = ("__project_name", "__year", "__month", "__marketplace_code", "__source_type", "__category_key", "__row_hash", "__run_id")
SLICE_KEY = ("__project_name", "__year", "__month", "__marketplace_code", "__category_key")
NOT_FILLED = "Не заполнено"


def first_of(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that is among the columns."""
    there = set(columns)
    return next((c for c in candidates if c in there), None)


def need(columns: Iterable[str], candidates: Sequence[str]) -> str:
    found = first_of(columns, candidates)
    if found is None:
        raise ValueError(f"none of the columns {', '.join(candidates)} is there")
    return found


def q(name: str) -> str:
    """A quoted column reference."""
    return "`" + name.replace("`", "``") + "`"


def visible(columns: Iterable[str], requested: Sequence[str] | None = None) -> list[str]:
    """Columns that users see (none that start with two underscores); the requested ones of these, in their order, or
    all if none is left."""
    shown = [c for c in columns if not c.startswith("__")]
    return [c for c in dict.fromkeys(requested or ()) if c in shown] or shown


def require_metadata(df: DataFrame) -> None:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"the cube lacks {', '.join(missing)}")


def identifier(name: str) -> str:
    """A table name that may stand in SQL unquoted."""
    import re

    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is no table name")
    return name
