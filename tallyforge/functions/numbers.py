"""Numbers as column expressions. Dirty text never fails: what is no number is NULL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^[ \t\n\r]*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?[ \t\n\r]*$"
MONEY = "decimal(38,6)"


def _double(text: Column) -> Column:
    """Text to double, or NULL; unlike a plain cast it takes no type suffixes."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def num(c: Column) -> Column:
    """A number with a decimal comma or point and with spaces or no-break spaces between digits."""
    return _double(F.translate(c.cast("string"), ",\u00a0 ", "."))


#: What a typed twin of a text column is called: its numbers, parsed once when rows are loaded.
TYPED = "__num:"
_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


def number_of(df: DataFrame, name: str) -> Column:
    """The numbers of a column: those of its typed twin, the column itself if it holds numbers, else parsed text."""
    if TYPED + name in df.columns:
        return F.col(f"`{TYPED}{name}`")
    kind = next(t for c, t in df.dtypes if c == name)
    return F.col(f"`{name}`").cast("double") if kind.startswith(_NUMERIC) else num(F.col(f"`{name}`"))


def with_numbers(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` with a typed twin of each of the text columns that are there."""
    return df.withColumns({TYPED + n: num(F.col(f"`{n}`")) for n in names if dict(df.dtypes).get(n) == "string" and TYPED + n not in df.columns})


def num_or_zero(c: Column) -> Column:
    return F.coalesce(num(c), F.lit(0.0))


def filter_num(c: Column) -> Column:
    """As export filters read numbers: a decimal comma is allowed, spaces between digits are not."""
    return _double(F.replace(c.cast("string"), F.lit(","), F.lit(".")))


def num_in_text(c: Column) -> Column:
    """The first signed number inside a text; a comma counts as a decimal point."""
    return F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit(".")), r"([-+]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def positive(c: Column) -> Column:
    """The number if it is finite and above zero, else NULL."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf")), x)


def close(a: Column, b: Column, abs_tol: float, rel_tol: float) -> Column:
    """Both positive and no further apart than the larger of the two tolerances; never NULL."""
    a, b = positive(a), positive(b)
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(abs_tol), rel_tol * F.greatest(a, b)), F.lit(False))


def multipack(unit: Column, total: Column) -> Column:
    """Packs in a listing: total over unit weight, rounded half to even; zero is NULL."""
    n = F.bround(positive(total) / positive(unit), 0)
    return F.when(n > 0, n)


def multipack_at_least_one(unit: Column, total: Column) -> Column:
    n = F.bround(positive(total) / positive(unit), 0)
    return F.when(n.isNotNull(), F.greatest(n, F.lit(1.0)))


def safe_div(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, or the default where b isn't above zero."""
    return F.when(b > 0, a / b).otherwise(F.lit(default).cast("double"))


def exact_sum(c: Column) -> Column:
    """A sum that doesn't depend on the order of rows: of numbers of six places, given as double; NULL of none.

    Whole parts, in two halves so that no sum of less than 2^31 rows can overflow, and millionths are summed as longs,
    which stay in generated code. Numbers beyond the range of longs, and no numbers, are summed as doubles.
    """
    x = c.cast("double")
    fits = F.abs(x) < F.lit(9.2e18)
    whole = F.when(fits, F.floor(x))
    millionths = F.when(fits, F.floor((x - F.floor(x).cast("double")) * 1e6 + 0.5))
    high, low, small = F.sum(F.shiftright(whole, 32)), F.sum(whole.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(millionths)
    units = high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(20,0)")
    exact = (units.cast("decimal(31,0)") + (small.cast("decimal(20,0)") * F.expr("0.000001BD")).cast("decimal(26,6)")).cast("double")
    rest = F.sum(F.when(~fits, x))
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def pair_weight(a: Column, b: Column) -> Column:
    """log1p of the larger sales of a pair; negative and missing sales count as zero."""
    at_least_zero = lambda c: F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.log1p(F.greatest(at_least_zero(a), at_least_zero(b)))


def next_above(c: Column) -> Column:
    """A double just above a positive one."""
    return c * F.lit(1 + 2.0**-52)


def hash_fraction(value: Column, seed: int) -> Column:
    """A number in [0, 1) from the SHA-256 of ``seed:value``: its first twelve hexadecimal digits over 16^12."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256), 1, 12)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**12))
