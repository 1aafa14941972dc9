"""Classification by rules that users write: compiled to column expressions.

Rules run in order of priority; each sees what earlier ones wrote. They fold into one expression for each target, and a
projection is cut only where a rule reads a column that has been written since the last cut, so plans stay flat however
many rules there are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbers import num_in_text
from tallyforge.functions.text import is_empty
from tallyforge.schema import q

MATCHES = ("contains", "not_contains", "regex", "equals", "startswith", "gt", "gte", "lt", "lte", "otherwise")
MODES = ("fill_empty", "overwrite")
NEEDED = ("active", "priority", "category", "target_column", "match_field", "match_type", "pattern", "set_value", "mode")
LAST_PRIORITY = 9999
#: Rules between two projections: bounds the depth of an expression.
MOST_FOLDED = 40


@dataclass(frozen=True)
class Condition:
    match_field: str
    match_type: str
    pattern: str
    join: str = "and"


@dataclass(frozen=True)
class Rule:
    number: int
    priority: int
    categories: tuple[str, ...]
    target: str
    value: str
    mode: str
    conditions: tuple[Condition, ...] = field(default=())

    @property
    def otherwise(self) -> bool:
        return any(c.match_type == "otherwise" for c in self.conditions)

    def reads(self, category: str) -> set[str]:
        return {c.match_field for c in self.conditions if c.match_type != "otherwise"} | ({category} if self.categories else set())


def _true(x: object) -> bool:
    return str(x).strip().lower() in ("1", "true", "yes", "да", "y", "истина")


def _blank(x: object) -> bool:
    return x is None or x != x or not str(x).strip()


def compiled(rows: Iterable[Mapping[str, object]]) -> list[Rule]:
    """Validate rules and sort them; inactive ones are left out."""
    out = []
    for number, row in enumerate(rows, 1):
        missing = [c for c in NEEDED if c not in row]
        if missing:
            raise ValueError(f"rule {number} lacks {', '.join(missing)}")
        if not _true(row["active"]):
            continue
        text = lambda k, row=row: "" if _blank(row.get(k)) else str(row[k])
        mode = text("mode").strip() or "fill_empty"
        if mode not in MODES:
            raise ValueError(f"rule {number}: no mode is called {mode!r}")
        if not text("target_column").strip():
            raise ValueError(f"rule {number} has no target")
        conditions = [Condition(text("match_field").strip(), text("match_type").strip(), text("pattern"))]
        for extra in json.loads(text("conditions_json") or "[]"):
            join = str(extra.get("join_with_prev", "and")).strip().lower()
            if join not in ("and", "or"):
                raise ValueError(f"rule {number}: conditions join with and or or")
            conditions.append(Condition(str(extra.get("match_field", "")).strip(), str(extra.get("match_type", "")).strip(), str(extra.get("pattern", "")), join))
        for c in conditions:
            if c.match_type not in MATCHES:
                raise ValueError(f"rule {number}: no match is called {c.match_type!r}")
            if c.match_type == "regex":
                re.compile(c.pattern)
            if c.match_type in ("gt", "gte", "lt", "lte") and not re.search(r"[-+]?\d", c.pattern):
                raise ValueError(f"rule {number}: {c.pattern!r} is no number")
        try:
            priority = int(float(text("priority"))) if text("priority").strip() else LAST_PRIORITY
        except ValueError:
            priority = LAST_PRIORITY
        categories = tuple(p for x in re.split(r"[|;]", text("category")) if (p := x.strip().lower()))
        out.append(Rule(number, priority, () if "*" in categories else categories, text("target_column").strip(), text("set_value"), mode, tuple(conditions)))
    return sorted(out, key=lambda r: (r.priority, r.number))


def _matches(c: Condition, columns: Sequence[str]) -> Column:
    if c.match_type == "otherwise":
        return F.lit(True)
    if c.match_field not in columns:
        raise KeyError(f"a rule reads {c.match_field!r}, which isn't there")
    x = F.coalesce(F.col(q(c.match_field)).cast("string"), F.lit(""))
    if c.match_type == "contains":
        return F.lower(x).contains(c.pattern.lower())
    if c.match_type == "not_contains":
        return ~F.lower(x).contains(c.pattern.lower())
    if c.match_type == "regex":
        return x.rlike(f"(?iuU){c.pattern}")
    if c.match_type == "equals":
        return F.lower(F.trim(x)) == c.pattern.strip().lower()
    if c.match_type == "startswith":
        return x.startswith(c.pattern)
    n = float(re.search(r"[-+]?\d+(?:\.\d+)?", c.pattern.replace(",", "."))[0])
    v = num_in_text(x)
    found = {"gt": v > n, "gte": v >= n, "lt": v < n, "lte": v <= n}[c.match_type]
    return F.coalesce(found, F.lit(False))


def _mask(rule: Rule, columns: Sequence[str], category: str) -> Column:
    """Conditions join from left to right, without precedence; then the scope."""
    mask = _matches(rule.conditions[0], columns)
    for c in rule.conditions[1:]:
        mask = mask & _matches(c, columns) if c.join == "and" else mask | _matches(c, columns)
    if rule.otherwise:
        mask = F.lit(True)
    if rule.categories:
        mask = mask & F.lower(F.trim(F.coalesce(F.col(q(category)).cast("string"), F.lit("")))).isin(list(rule.categories))
    return mask


def reachable(rules: Sequence[Rule], start: str, category: str) -> tuple[list[Rule], set[str]]:
    """The rules that can apply to rows that start in one category, and the categories that they may reach."""
    seen = {start.strip().lower()}
    while True:
        now = seen | {r.value.strip().lower() for r in rules if r.target == category and (not r.categories or seen & set(r.categories))}
        if now == seen:
            return [r for r in rules if not r.categories or seen & set(r.categories)], seen
        seen = now


def apply(df: DataFrame, rules: Sequence[Rule], category: str = "Категория", fill: Mapping[str, str] | None = None, slice_category: str | None = None, report: bool = False) -> DataFrame:
    """The classified rows. ``fill`` names values for targets that stay empty. With ``report``, ``_applied`` lists the
    numbers of the rules that wrote to a row, ``_matched`` of those that matched it."""
    if slice_category is not None:
        rules, _ = reachable(rules, slice_category, category)
    for t in dict.fromkeys(r.target for r in rules):
        if t not in df.columns:
            df = df.withColumn(t, F.lit(None).cast("string"))
    columns = df.columns
    #: By target, what is folded since the last projection: first rules that fill, then rules that overwrite.
    fills: dict[str, list[tuple[Column, Rule]]] = {}
    overs: dict[str, list[tuple[Column, Rule]]] = {}

    def chain(pairs: Sequence[tuple[Column, Column]], rest: Column) -> Column:
        out = None
        for mask, value in pairs:
            out = F.when(mask, value) if out is None else out.when(mask, value)
        return rest if out is None else out.otherwise(rest)

    def cut(df: DataFrame) -> DataFrame:
        new, marks, met = {}, [], []
        for t in dict.fromkeys([*fills, *overs]):
            now = F.col(q(t)).cast("string")
            first, last = fills.get(t, []), overs.get(t, [])
            filled = F.when(is_empty(now), chain([(m, F.lit(r.value)) for m, r in first], now)).otherwise(now) if first else now
            new[t] = chain([(m, F.lit(r.value)) for m, r in reversed(last)], filled)
            if report:
                marks += [F.when(is_empty(now), chain([(m, F.lit(r.number)) for m, r in first], F.lit(None).cast("int")))] if first else []
                marks += [F.when(m, F.lit(r.number)) for m, r in last]
                met += [F.when(m, F.lit(r.number)) for m, r in (*first, *last)]
        if marks:
            new["_applied"] = F.concat(F.col("_applied"), F.array_compact(F.array(*marks)))
            new["_matched"] = F.concat(F.col("_matched"), F.array_compact(F.array(*met)))
        fills.clear()
        overs.clear()
        return df.withColumns(new) if new else df

    if report:
        df = df.withColumns({c: F.array().cast("array<int>") for c in ("_applied", "_matched")})
    for rule in rules:
        fills_only = rule.mode == "fill_empty" or rule.otherwise
        written = set(fills) | set(overs)
        if rule.reads(category) & written or fills_only and rule.target in overs or sum(map(len, (*fills.values(), *overs.values()))) >= MOST_FOLDED:
            df = cut(df)
        if fills_only and not rule.value.strip():
            continue  # it would leave the cell empty
        (fills if fills_only else overs).setdefault(rule.target, []).append((_mask(rule, columns, category), rule))
    df = cut(df)
    for t, value in (fill or {}).items():
        if t in df.columns:
            df = df.withColumn(t, F.when(is_empty(F.col(q(t))), F.lit(value)).otherwise(F.col(q(t))))
    return df


def rule_report(classified: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that each rule wrote, from ``apply(…, report=True)``; rules without any are there too."""
    spark = classified.sparkSession
    names = spark.createDataFrame([(r.number, r.target) for r in rules], "rule int, target string")
    n = classified.select(F.explode("_applied").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("applied"))
    return names.join(n, "rule", "left").select("rule", "target", F.coalesce("applied", F.lit(0)).cast("long").alias("applied"))


def sample_audit(df: DataFrame, rules: Sequence[Rule], category: str = "Категория", often: float = 0.8) -> DataFrame:
    """rule, matched, applied and what is odd about it on these rows: never matched, matched but never applied, or
    matching most rows without being an ``otherwise``. Pass a sample or all rows; matches are those of ``apply``."""
    done = apply(df, rules, category, report=True)
    n = F.count(F.lit(1))
    counts = done.select(F.explode(F.concat(F.transform("_matched", lambda r: F.struct(r.alias("rule"), F.lit(0).alias("a"))), F.transform("_applied", lambda r: F.struct(r.alias("rule"), F.lit(1).alias("a"))))).alias("x"))
    counts = counts.groupBy("x.rule").agg(F.count_if(F.col("x.a") == 0).alias("matched"), F.count_if(F.col("x.a") == 1).alias("applied"))
    names = df.sparkSession.createDataFrame([(r.number, r.otherwise) for r in rules], "rule int, otherwise boolean")
    rows = names.join(counts, "rule", "left").na.fill(0, ["matched", "applied"]).crossJoin(df.agg(n.alias("_n")))
    odd = F.when(F.col("matched") == 0, "never_matched_sample").when(F.col("applied") == 0, "matched_but_never_applied_sample").when(~F.col("otherwise") & (F.col("matched") >= often * F.greatest("_n", F.lit(1))), "matches_too_many_rows_sample")
    return rows.select("rule", F.col("matched").cast("long").alias("matched"), F.col("applied").cast("long").alias("applied"), odd.alias("reason"))


def empty_share(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """The share of empty cells of each target."""
    return df.agg(*((F.count_if(is_empty(F.col(q(t)))) / F.count(F.lit(1))).alias(t) for t in targets))


def override(df: DataFrame, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    """Manual corrections, in order of priority: an exact match (trimmed, in any case) of a field sets a target. A SKU
    that no row has is looked up as Артикул."""
    chosen = sorted((dict(r) | {"_n": k} for k, r in enumerate(rows) if _true(r.get("active", True))), key=lambda r: (int(float(r.get("priority") or LAST_PRIORITY)), r["_n"]))
    for r in chosen:
        target, value = str(r["target_column"]), str(r["set_value"])
        wanted = str(r["match_value"]).strip().lower()
        hit = lambda c: F.lower(F.trim(F.coalesce(F.col(q(c)).cast("string"), F.lit("")))) == wanted  # noqa: B023, E731
        field_ = str(r["match_field"])
        if field_ not in df.columns and not (field_ == "SKU" and "Артикул" in df.columns):
            continue
        mask = hit(field_) if field_ in df.columns else F.lit(False)
        if field_ == "SKU" and "Артикул" in df.columns and (field_ not in df.columns or not df.where(mask).take(1)):
            mask = hit("Артикул")
        if target not in df.columns:
            df = df.withColumn(target, F.lit(None).cast("string"))
        if r.get("mode") == "fill_empty":
            mask = mask & is_empty(F.col(q(target)))
        df = df.withColumn(target, F.when(mask, F.lit(value)).otherwise(F.col(q(target))))
    return df


def audit(rules: Sequence[Rule]) -> list[tuple[int, str]]:
    """(rule, what is odd about it): duplicates, never reached, too broad, short patterns, expensive expressions."""
    out, seen, closed = [], {}, set()
    for r in rules:
        key = (r.categories, r.target, r.value, r.mode, r.conditions)
        if key in seen:
            out.append((r.number, f"duplicate of rule {seen[key]}"))
        seen.setdefault(key, r.number)
        if r.mode == "fill_empty" and (r.target, ()) in closed or (r.target, r.categories) in closed and r.mode == "fill_empty":
            out.append((r.number, "unreachable after otherwise"))
        if r.otherwise:
            closed.add((r.target, r.categories))
        for c in r.conditions:
            if c.match_type in ("contains", "startswith", "regex") and 0 < len(c.pattern.strip()) < 3:
                out.append((r.number, f"short pattern {c.pattern!r}"))
            if c.match_type in ("contains", "regex") and not c.pattern.strip("^$.* "):
                out.append((r.number, "matches everything"))
            if c.match_type == "regex" and re.search(r"(\.\*.*){3}|\([^)]*[+*]\)[+*]", c.pattern):
                out.append((r.number, "expensive expression"))
    return out


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many cells of each column differ between two outputs, by a key that numbers rows alike."""
    columns = [c for c in left.columns if c in right.columns and c != key]
    both = left.alias("l").join(right.alias("r"), key, "full")
    counts = both.agg(*(F.count_if(~F.col(f"l.{q(c)}").eqNullSafe(F.col(f"r.{q(c)}"))).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(q(c)).alias("differences")) for c in columns))).alias("x")).select("x.*")
