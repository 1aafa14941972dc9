"""The cube as a small warehouse: hashes, idempotent slice imports, registry, maintenance.

A cube is a folder of Parquet partitioned by project, year, month, marketplace and category: a slice is a partition, so
replacing one never rewrites another. A slice is staged first and moved into place, the registry is written last; a
failed import leaves what was there.
"""

from __future__ import annotations

import calendar
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import storage
from tallyforge.functions.numbers import number_of, with_numbers
from tallyforge.schema import METADATA, REVENUE, SALES, SLICE_KEY, VOLUME, first_of, q

MIN_SALES = 15.0
#: Columns that get a typed twin when they are loaded.
NUMBERS = (*SALES, *REVENUE, *VOLUME)
HEAVY_SLICE, HEAVY_CATEGORY = 250_000, 1_000_000


class DuplicateSliceError(ValueError):
    """The slice is in the cube already and may not be replaced."""


def _hash(columns: Sequence[str], *lead: Column) -> Column:
    """SHA-1 over the leading values and the columns in their order; NULL counts as a word of its own."""
    return F.sha1(F.concat_ws("|", *lead, *(F.coalesce(F.col(q(c)).cast("string"), F.lit("<NULL>")) for c in columns)))


def with_hashes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row hash and business hash (without the category) of the source columns, in the source's order."""
    lead = [F.col(c).cast("string") for c in SLICE_KEY]
    return df.withColumns({"__row_hash": _hash(columns, *lead), "__business_row_hash": _hash(columns, *lead[:-1])})


def positive_rows(df: DataFrame) -> DataFrame:
    """Rows with sales and volume above zero, of the columns that are there; text that is no number drops the row."""
    for c in (first_of(df.columns, SALES), first_of(df.columns, VOLUME)):
        if c:
            df = df.where(number_of(df, c) > 0)
    return df


def min_sales(df: DataFrame, least: float = MIN_SALES) -> DataFrame:
    c = first_of(df.columns, SALES)
    return df.where(number_of(df, c) >= least) if c else df


def sales_quantile(df: DataFrame, quantile: float | None, least: float = MIN_SALES, by: Sequence[str] = ()) -> DataFrame:
    """Rows of at least the quantile of positive sales (linear between ranks), in each group, and of ``least``. The
    quantile is an aggregate that is joined back, so no group is gathered."""
    c = first_of(df.columns, SALES)
    rows = df.withColumn("_sales", number_of(df, c)).where("_sales > 0")
    if quantile is None:
        return rows.where(F.col("_sales") >= least).drop("_sales")
    if not 0 <= quantile < 1:
        raise ValueError("a quantile lies in [0, 1)")
    cut = rows.groupBy(*(q(b) for b in by)).agg(F.percentile("_sales", F.lit(quantile)).alias("_cut"))
    rows = rows.join(cut, list(by), "inner") if by else rows.crossJoin(cut)
    return rows.where(F.col("_sales") >= F.greatest(F.col("_cut"), F.lit(least))).drop("_sales", "_cut")


def unseen(stage: DataFrame, cube: DataFrame, business: bool = False) -> DataFrame:
    """Staged rows that the cube doesn't hold: one of each row hash, by row hash or by business hash within the month."""
    keys = ["__project_name", "__year", "__month", "__marketplace_code", "__business_row_hash"] if business else ["__row_hash"]
    return stage.dropDuplicates(["__row_hash"]).join(cube.select(*keys).distinct(), keys, "left_anti")


def merged_schema(cube: DataFrame, stage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with one schema: new columns are added, and a column whose types differ becomes text; metadata never does."""
    types = dict(cube.dtypes)
    for name, kind in stage.dtypes:
        if name in types and types[name] != kind:
            if name in METADATA:
                stage = stage.withColumn(name, F.col(q(name)).cast(types[name]))
            else:
                cube, stage = cube.withColumn(name, F.col(q(name)).cast("string")), stage.withColumn(name, F.col(q(name)).cast("string"))
    return cube, stage


def backfilled(cube: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The cube with missing business hashes computed."""
    lead = [F.col(c).cast("string") for c in SLICE_KEY[:-1]]
    return cube.withColumn("__business_row_hash", F.coalesce(F.nullif(F.col("__business_row_hash"), F.lit("")), _hash(columns, *lead)))


@dataclass(frozen=True)
class Slice:
    project: str
    year: int
    month: int
    marketplace: str
    category_key: str
    category_name: str | None = None
    source_type: str = "category"


class Cube:
    """A cube in a folder, with its registry and its journal of loads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, part: str) -> DataFrame | None:
        path = f"{self.folder}/{part}"
        return self.spark.read.option("mergeSchema", True).parquet(path) if storage.exists(self.spark, path) else None

    def rows(self) -> DataFrame | None:
        return self._read("rows")

    def registry(self) -> DataFrame | None:
        """The newest entry of each slice; removed slices are left out."""
        log = self._read("registry")
        if log is None:
            return None
        return newest(log, SLICE_KEY, "saved_at").where("not removed").drop("removed")

    def journal(self) -> DataFrame | None:
        return self._read("journal")

    def _append(self, part: str, row: Mapping[str, object], schema: str) -> None:
        self.spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{part}")

    def _partition(self, s: Slice) -> str:
        def escaped(v) -> str:
            return self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(v))

        return "/".join(f"{k}={escaped(v)}" for k, v in zip(SLICE_KEY, (s.project, s.year, s.month, s.marketplace, s.category_key), strict=True))

    def import_slice(self, source: DataFrame, s: Slice, run_id: str, source_file: str = "", overwrite: bool = False, least_sales: float = MIN_SALES) -> int:
        """Load a slice and give the number of rows that were new. A slice of the same key or of the same category name
        (in its month and marketplace) may only be replaced with ``overwrite``; the same rows under another source type
        aren't loaded twice."""
        there = self.registry()
        month = (F.col("__project_name") == s.project) & (F.col("__year") == s.year) & (F.col("__month") == s.month) & (F.col("__marketplace_code") == s.marketplace)
        old = there.where(month & ((F.col("__category_key") == s.category_key) | (F.col("category_name") == s.category_name))).collect() if there is not None else []
        same = [r for r in old if r["__category_key"] == s.category_key]
        if old and not overwrite and not (same and same[0]["source_type"] != s.source_type):
            if not (same and same[0]["source_file"] == source_file):
                raise DuplicateSliceError(f"{s.category_name or s.category_key} of {s.year}-{s.month:02d} is in the cube already")
        columns = source.columns
        stage = min_sales(positive_rows(source), least_sales)
        keys = dict(zip(SLICE_KEY, (F.lit(s.project), F.lit(s.year), F.lit(s.month), F.lit(s.marketplace), F.lit(s.category_key)), strict=True))
        stage = with_hashes(stage.withColumns(keys), columns).dropDuplicates(["__row_hash"])
        stage = with_numbers(stage, NUMBERS).withColumns({"__run_id": F.lit(run_id), "__source_file": F.lit(source_file), "__imported_at": F.current_timestamp(), "__source_type": F.lit(s.source_type)})
        cube = self.rows()
        kept = cube.where(month & (F.col("__category_key") == s.category_key)) if cube is not None and not overwrite else None
        if kept is not None:
            kept, stage = merged_schema(backfilled(kept, [c for c in columns if c in kept.columns]), stage)
            stage = unseen(stage, kept, business=True)
        staged = f"{self.folder}/.stage-{uuid.uuid4().hex}"
        whole = stage if kept is None else kept.unionByName(stage, allowMissingColumns=True)
        whole.drop(*SLICE_KEY).write.parquet(f"{staged}/new")
        total = self.spark.read.parquet(f"{staged}/new").count()
        new = self.spark.read.parquet(f"{staged}/new").where(F.col("__run_id") == run_id).count()
        target = f"{self.folder}/rows/{self._partition(s)}"
        gone = [target] + [f"{self.folder}/rows/{self._partition(Slice(s.project, s.year, s.month, s.marketplace, r['__category_key']))}" for r in old if r["__category_key"] != s.category_key and overwrite]
        back = []
        try:
            for k, path in enumerate(gone):
                if storage.exists(self.spark, path):
                    storage.move(self.spark, path, f"{staged}/old-{k}")
                    back.append((f"{staged}/old-{k}", path))
            storage.move(self.spark, f"{staged}/new", target)
        except Exception:
            for kept_at, path in back:
                storage.move(self.spark, kept_at, path)
            raise
        for r in old if overwrite else []:
            if r["__category_key"] != s.category_key:
                self._register(Slice(s.project, s.year, s.month, s.marketplace, r["__category_key"], r["category_name"], r["source_type"]), 0, "", removed=True)
        self._register(s, total, source_file)
        self._append("journal", {"run_id": run_id, "source_file": source_file, "rows": new, "loaded_at": None}, "run_id string, source_file string, rows long, loaded_at timestamp")
        storage.delete(self.spark, staged)
        return new

    def _register(self, s: Slice, rows: int, source_file: str, removed: bool = False) -> None:
        from datetime import UTC, datetime

        row = {**dict(zip(SLICE_KEY, (s.project, s.year, s.month, s.marketplace, s.category_key), strict=True)), "category_name": s.category_name or s.category_key, "rows_count": rows, "source_type": s.source_type, "source_file": source_file, "saved_at": datetime.now(UTC), "removed": removed}
        self._append("registry", row, "__project_name string, __year int, __month int, __marketplace_code string, __category_key string, category_name string, rows_count long, source_type string, source_file string, saved_at timestamp, removed boolean")

    def delete_slices(self, slices: Sequence[Slice]) -> int:
        """Remove slices and give how many were there."""
        n = 0
        for s in slices:
            path = f"{self.folder}/rows/{self._partition(s)}"
            if storage.exists(self.spark, path):
                storage.delete(self.spark, path)
                self._register(s, 0, "", removed=True)
                n += 1
        return n


def newest(log: DataFrame, keys: Sequence[str], at: str, *ties: str) -> DataFrame:
    """An upsert as a view of a log: the newest row of each key."""
    w = Window.partitionBy(*(q(k) for k in keys)).orderBy(F.col(at).desc(), *(F.col(t).desc() for t in ties))
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upserted(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with rows of the same key replaced by the changes (one a key) and new ones added."""
    return table.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def replaced_run(table: DataFrame, rows: DataFrame, run_id: str) -> DataFrame:
    """The table with a run's rows replaced."""
    return table.where(F.col("run_id") != run_id).unionByName(rows, allowMissingColumns=True)


def without_slices(cube: DataFrame, keys: DataFrame) -> DataFrame:
    """The cube without the slices whose keys are listed."""
    return cube.join(keys.select(*SLICE_KEY).distinct(), list(SLICE_KEY), "left_anti")


def heavy_flags(registry: DataFrame, slice_limit: int = HEAVY_SLICE, category_limit: int = HEAVY_CATEGORY) -> DataFrame:
    """is_heavy and heavy_reason of each slice: by its own rows or by its category's in the project."""
    total = F.sum("rows_count").over(Window.partitionBy("__project_name", "__category_key"))
    rows = registry.withColumn("category_rows", total)
    big, whole = F.col("rows_count") >= slice_limit, F.col("category_rows") >= category_limit
    reason = F.concat_ws("; ", F.when(big, F.concat(F.lit("slice rows "), F.col("rows_count").cast("string"))), F.when(whole, F.concat(F.lit("category rows "), F.col("category_rows").cast("string"))))
    return rows.withColumns({"is_heavy": big | whole, "heavy_reason": F.nullif(reason, F.lit(""))})


def heavy_summary(flags: DataFrame, by: Sequence[str] = ("__category_key",)) -> DataFrame:
    return flags.groupBy(*by).agg(F.count(F.lit(1)).alias("slices"), F.sum("rows_count").alias("rows"), F.max("rows_count").alias("largest"), F.bool_or("is_heavy").alias("is_heavy"))


def day_coverage(year: int, month: int, today: date) -> tuple[int, int, date | None]:
    """(days loaded, days in the month, last day covered): all of a past month, up to today of the current, none later."""
    days = calendar.monthrange(year, month)[1]
    loaded = days if (year, month) < (today.year, today.month) else today.day if (year, month) == (today.year, today.month) else 0
    return loaded, days, date(year, month, loaded) if loaded else None


def day_coverage_columns(year: Column, month: Column, today: Column) -> tuple[Column, Column]:
    """days_loaded and days_in_month as columns."""
    first = F.make_date(year, month, F.lit(1))
    days = F.dayofmonth(F.last_day(first))
    this = F.trunc(today, "month")
    return F.when(first < this, days).when(first == this, F.dayofmonth(today)).otherwise(F.lit(0)).cast("int"), days.cast("int")


# How a task stands, the best first, and what is to be done then.
PLAN_ACTIONS = {"failed": "retry", "stale": "process", "incomplete": "download", "missing": "download", "ready": "none"}


def plan_status(error: Column, has_raw: Column, has_classified: Column, in_cube: Column, file_newer: Column, complete: Column) -> Column:
    """failed, stale, incomplete, ready or missing."""
    return (
        F.when(error, "failed")
        .when(in_cube & has_classified & file_newer, "stale")
        .when(in_cube & ~complete, "incomplete")
        .when(in_cube, "ready")
        .when(has_classified | has_raw, "incomplete")
        .otherwise("missing")
    )


def task_status(in_cube: Column, classified: Column, processed: Column, raw: Column) -> Column:
    """The furthest that a task has come."""
    return F.when(in_cube, "saved").when(classified, "classified").when(processed, "processed").when(raw, "downloaded").otherwise("pending")


def run_status(failed: Column, open_: Column) -> Column:
    return F.when(open_ > 0, "paused").when(failed > 0, "completed_with_errors").otherwise("succeeded")


def stale_failed(runs: DataFrame) -> DataFrame:
    """Runs that were queued or running when the process ended are failed."""
    stuck = F.col("status").isin("queued", "running")
    return runs.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def latest_runs(runs: DataFrame, status: str, keys: Sequence[str] = ("project", "category")) -> DataFrame:
    """The latest run of a status by key."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("finished_at", "created_at").desc(), F.col("created_at").desc(), F.col("run_id").desc())
    return runs.where(F.col("status") == status).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def prunable_runs(runs: DataFrame, keys: Sequence[str] = ("project", "category")) -> DataFrame:
    """Failed runs but the last of each key."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("finished_at", "created_at").desc(), F.col("created_at").desc(), F.col("run_id").desc())
    return runs.where("status = 'failed'").withColumn("_r", F.row_number().over(w)).where("_r > 1").drop("_r")


def due(schedules: DataFrame, now: Column) -> DataFrame:
    return schedules.where(F.col("enabled") & (F.col("next_run_at") <= now))
