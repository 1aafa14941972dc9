"""A paged HTTP report as a Spark data source: a partition for each task and month, pages until the total is reached.

Requests are made by a fetcher that the options name (``module:function``), so any client, and a fake in tests, can
stand behind it. It takes (task, year, month, start, size) and gives ``{"total": n, "data": [row, …]}``, rows as
dictionaries of text. A page that fails is asked again, with growing pauses.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallyforge.operators.state import month_iter

PAGE = 1000


class Month(InputPartition):
    def __init__(self, task: str, year: int, month: int):
        super().__init__((task, year, month))
        self.task, self.year, self.month = task, year, month


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = [f.name for f in schema.fields][3:]
        self.options = options

    def partitions(self) -> Sequence[Month]:
        first, last = (tuple(map(int, self.options[k].split("-"))) for k in ("first", "last"))
        return [Month(t, y, m) for t in json.loads(self.options["tasks"]) for y, m in month_iter(first, last)]

    def read(self, partition: Month) -> Iterator[tuple]:
        module, name = self.options["fetcher"].split(":")
        fetch: Callable = getattr(importlib.import_module(module), name)
        size, start = int(self.options.get("page", PAGE)), 0
        while True:
            page = self._page(fetch, partition, start, size)
            rows = page.get("data") or []
            for row in rows:
                yield (partition.task, partition.year, partition.month, *(None if row.get(n) is None else str(row[n]) for n in self.names))
            start += len(rows)
            if not rows or start >= int(page.get("total") or 0):
                return

    def _page(self, fetch: Callable, p: Month, start: int, size: int) -> dict:
        tries, pause = int(self.options.get("tries", 3)), float(self.options.get("pause", 2.0))
        for k in range(tries):
            try:
                return fetch(p.task, p.year, p.month, start, size)
            except OSError:
                if k + 1 == tries:
                    raise
                time.sleep(pause * 2**k)
        raise ValueError("tries must be at least 1")


class PagedSource(DataSource):
    """Options: fetcher, tasks (a JSON list), first and last (``YYYY-MM``), columns (a JSON list), page, tries, pause."""

    @classmethod
    def name(cls) -> str:
        return "paged_report"

    def schema(self) -> str:
        return "task string, year int, month int" + "".join(f", `{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def read_paged(spark: SparkSession, fetcher: str, tasks: Sequence[str], first: str, last: str, columns: Sequence[str], **options: object) -> DataFrame:
    """task, year, month and the columns of all pages of all tasks and months."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged_report").options(fetcher=fetcher, tasks=json.dumps(list(tasks)), first=first, last=last, columns=json.dumps(list(columns)))
    return reader.options(**{k: str(v) for k, v in options.items()}).load()
