"""Aggregates over operational state: runs, tasks, plans and projects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.schema import q


def run_counts(tasks: DataFrame, failed: str = "failed", done: str = "done") -> DataFrame:
    return tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == failed).alias("failed"), F.count_if(F.col("status") == done).alias("done"))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows repeat a key, and how many keys do: extra_rows, repeated."""
    return df.groupBy(*(q(k) for k in keys)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.sum(F.col("_n") - 1).alias("extra_rows"), F.count(F.lit(1)).alias("repeated"))


def single_value(column: str) -> Column:
    """The smallest value of a group if all are the same after trimming and case, else NULL."""
    c = F.col(q(column))
    return F.when(F.countDistinct(F.lower(F.trim(c))) == 1, F.min(c))


def active_in(df: DataFrame, month: Column) -> DataFrame:
    """Rows whose bounds active_from and active_to (``YYYY-MM``, either may be missing) hold the month."""
    return df.where((F.col("active_from").isNull() | (F.col("active_from") <= month)) & (F.col("active_to").isNull() | (F.col("active_to") >= month)))


def month_plan(categories: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Each category with each month of a range, as year, month and period. The months come from the bounds, so this
    multiplies rows by their number and shuffles nothing."""
    if first > last:
        raise ValueError("the first month is after the last")
    months = F.sequence(F.make_date(F.lit(first[0]), F.lit(first[1]), F.lit(1)), F.make_date(F.lit(last[0]), F.lit(last[1]), F.lit(1)), F.expr("interval 1 month"))
    rows = categories.withColumn("_m", F.explode(months))
    return rows.withColumns({"year": F.year("_m"), "month": F.month("_m"), "period": F.date_format("_m", "yyyy-MM")}).drop("_m")


def month_iter(first: tuple[int, int], last: tuple[int, int]) -> list[tuple[int, int]]:
    """The (year, month) pairs of a range, both ends included."""
    if first > last:
        raise ValueError("the first month is after the last")
    return [(k // 12, k % 12 + 1) for k in range(first[0] * 12 + first[1] - 1, last[0] * 12 + last[1])]


def next_month(year: int, month: int) -> tuple[int, int]:
    return month_iter((year, month), (year + 1, month))[1]


def months_by_year(first: tuple[int, int], last: tuple[int, int]) -> dict[int, tuple[int, ...]]:
    """The months of a range by their year."""
    months = month_iter(first, last)
    return {y: tuple(m for x, m in months if x == y) for y in dict.fromkeys(y for y, _ in months)}


def task_status() -> Column:
    """How far a task has come, by its steps; saving is open again."""
    return F.expr("CASE WHEN classify_status = 'classified' THEN 'classified' WHEN process_status = 'processed' THEN 'processed' WHEN download_status = 'downloaded' THEN 'downloaded' ELSE 'pending' END")


def slices_deleted(tasks: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Tasks after slices of the cube are gone: those of a deleted slice are to be saved again and fall back to the step
    before; others stay. Also without an error."""
    gone = tasks.join(keys.select(*on).distinct().withColumn("_gone", F.lit(True)), list(on), "left")
    hit = F.coalesce("_gone", F.lit(False))
    return gone.withColumns({"status": F.when(hit, task_status()).otherwise(F.col("status")), "save_status": F.when(hit, "pending").otherwise(F.col("save_status")), "error_message": F.when(~hit, F.col("error_message"))}).drop("_gone")


def without_runs(children: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of runs that stay: those of the runs listed are deleted with them."""
    return children.join(runs.select("run_id").distinct(), "run_id", "left_anti")


def project_summary(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row for each project that any part names. A part has ``project`` and its own aggregated columns, one row a
    project; what a part doesn't know is NULL."""
    names = None
    for part in parts.values():
        own = part.select("project")
        names = own if names is None else names.union(own)
    out = names.where("project is not null").distinct()
    for part in parts.values():
        out = out.join(part, "project", "left")
    return out


def filtered_tasks(tasks: DataFrame, view: str) -> DataFrame:
    """errors, not_downloaded, not_processed, not_saved, ready or all."""
    conditions = {
        "errors": "status = 'failed'",
        "not_downloaded": "download_status <> 'done'",
        "not_processed": "download_status = 'done' and process_status <> 'done'",
        "not_saved": "process_status = 'done' and save_status <> 'done'",
        "ready": "save_status = 'done'",
        "all": "true",
    }
    if view not in conditions:
        raise ValueError(f"no view is called {view!r}")
    return tasks.where(conditions[view])
