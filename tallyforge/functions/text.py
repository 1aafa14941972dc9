"""Text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a product of the first category that was studied, and its flavours.
STOP_TOKENS = (
    "соус", "соусы", "соуса", "для", "без", "на", "и", "в", "с", "из", "по", "от", "до", "под", "г", "гр", "кг", "мл", "л", "шт", "штук", "уп", "упак", "упаковка", "бутылка", "стекло", "пэт", "x", "х",
)
FLAVOR_TOKENS = (
    "соевый", "соевого", "паста", "чили", "острый", "острая", "остро", "уксус", "уксусный", "томатный", "томатная", "натуральный", "натуральная", "сладкий", "сладкая", "бальзамический", "бальзамическая", "мяса",
)


def clean(c: Column) -> Column:
    """White space of any kind becomes single spaces, none at the ends; NULL is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))


def norm(c: Column) -> Column:
    """Cleaned, lower case, ё as е."""
    return F.translate(F.lower(clean(c)), "ё", "е")


def weight_text(c: Column) -> Column:
    """For weight parsing: lower case, no-break spaces as spaces, decimal commas as points."""
    s = F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\\u00A0", " ")))
    return F.regexp_replace(s, r"(?<=\d),(?=\d)", ".")


def title(c: Column) -> Column:
    """Letters and digits of Latin and Cyrillic, else spaces."""
    s = F.translate(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^0-9a-zа-я]+", " "), " +", " "))


def tokens(c: Column) -> Column:
    t = title(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def meaningful_tokens(c: Column, stop: Iterable[str] = STOP_TOKENS, keep_numeric: bool = False) -> Column:
    """Distinct tokens of two characters and more that are no stop tokens and, unless kept, no numbers."""
    stop = F.array(*(F.lit(s) for s in stop))
    keep = lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t) & (F.lit(keep_numeric) | ~t.rlike("^[0-9]+$"))
    return F.array_distinct(F.filter(tokens(c), keep))


def flavors(c: Column, vocabulary: Iterable[str] = FLAVOR_TOKENS) -> Column:
    return F.array_sort(F.array_intersect(meaningful_tokens(c), F.array(*(F.lit(v) for v in vocabulary))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller set that is in the other; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))).otherwise(F.lit(0.0))


def sku_text(c: Column) -> Column:
    """An article number without the ``.0`` that spreadsheets add."""
    return F.regexp_replace(F.trim(c.cast("string")), r"^(\d+)\.0+$", "$1")


def marketplace_key(c: Column) -> Column:
    k = F.lower(clean(c))
    return F.when(k == "", F.lit("unknown_marketplace")).otherwise(k)


def relation(a: Column, b: Column) -> Column:
    """``unknown`` if either is empty, else ``same`` or ``different`` after normalisation."""
    x, y = norm(a), norm(b)
    return F.when((x == "") | (y == ""), F.lit("unknown")).when(x == y, F.lit("same")).otherwise(F.lit("different"))


def is_empty(c: Column) -> Column:
    return c.isNull() | (F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " ")) == "")


def dimension(c: Column | None, fallback: Column | None = None, unknown: str = "Не заполнено") -> Column:
    """A report's dimension: trimmed, the fallback where empty, a fixed word where that is empty too."""
    filled = lambda x: F.nullif(F.trim(x.cast("string")), F.lit(""))
    return F.coalesce(*(filled(x) for x in (c, fallback) if x is not None), F.lit(unknown))


def decimal_comma(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"([0-9])\.([0-9])", "$1,$2")


def labelled(**parts: Column) -> Column:
    """``label: value`` of the parts that aren't empty, joined by `` | ``."""
    return F.concat_ws(" | ", *(F.when(~is_empty(c), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in parts.items()))


def filename_safe(name: str) -> str:
    """A name for files: what isn't a letter, digit, point, dash or underscore becomes one underscore."""
    import re

    return re.sub(r"_+", "_", re.sub(r"[^\w.-]+", "_", name.strip())).strip("_.") or "file"
