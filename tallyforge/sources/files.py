"""Files in and out: sniffed and fixed CSV, archives, label states, catalogs, CSV sinks.

Only a file's head and its name are read on the driver; rows are read by Spark. Optional formats say what they lack.
"""

from __future__ import annotations

import csv
import io
import json
import sqlite3
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyforge import storage
from tallyforge.schema import q

# What reports are separated by and encoded in, and the row limit of a spreadsheet.
SEPARATORS = (",", ";", "\t", "|")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251")
SHEET_ROWS = 1_048_575
#: How many files a split by category makes unasked, and at all.
MOST_FILES, MOST_CATEGORIES = 10, 10_000
HEAD = 50_000


def sniff(head: bytes) -> tuple[str, str]:
    """(encoding, separator) of a CSV file by its first bytes; the most frequent separator where sniffing fails."""
    text = None
    for encoding in ENCODINGS:
        if encoding == "utf-8-sig" and not head.startswith(b"\xef\xbb\xbf"):
            continue
        try:
            text = head.decode(encoding)
            break
        except UnicodeDecodeError as e:
            # a cut in the last character is the reader's, not the file's
            if encoding != "cp1251" and e.start >= len(head) - 4:
                text = head[: e.start].decode(encoding)
                break
    else:
        encoding, text = "utf-8", head.decode("utf-8", "replace")
    try:
        return encoding, csv.Sniffer().sniff(text, "".join(SEPARATORS)).delimiter
    except csv.Error:
        return encoding, max(SEPARATORS, key=lambda s: (text.count(s), -SEPARATORS.index(s)))


def head_of(spark: SparkSession, path: str, n: int = HEAD) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = min(n, store.getFileStatus(p).getLen())
    with_ = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    stream = store.open(p)
    try:
        return bytes(with_.toByteArray(stream, int(size)))
    finally:
        stream.close()


def _header(head: bytes, encoding: str, sep: str) -> list[str]:
    row = next(csv.reader(io.StringIO(head.decode(encoding, "ignore")), delimiter=sep), [])
    return [c.lstrip("﻿") for c in row]


def read_text_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = "utf-8-sig") -> DataFrame:
    """A CSV file with all columns as text; a malformed row is an error, a short one is filled with NULLs. Rows don't
    move: ``_metadata`` gives the file."""
    names = _header(head_of(spark, path), encoding, sep)
    schema = StructType([StructField(n, StringType()) for n in names])
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    if encoding != "cp1251":
        return reader.option("encoding", "UTF-8").csv(path)
    #: Spark reads no cp1251: bytes are read as Latin-1, one character each, and its upper half is mapped.
    high = bytes(range(128, 256))
    df = reader.option("encoding", "ISO-8859-1").csv(path)
    return df.select(*(F.translate(F.col(q(n)), high.decode("latin-1"), high.decode("cp1251", "replace")).alias(n) for n in names))


def read_any_csv(spark: SparkSession, path: str) -> DataFrame:
    encoding, sep = sniff(head_of(spark, path))
    return read_text_csv(spark, path, sep, encoding)


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """The folder's CSV files, sorted by name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in store.listStatus(p) if s.isFile() and s.getPath().getName().lower().endswith(".csv"))


def count_csv(spark: SparkSession, path: str) -> int:
    return read_any_csv(spark, path).count()


def zipped_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, name, content of the first CSV member of each ZIP file; a file that is no archive is its own content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = path.rsplit("/", 1)[-1]
                if content.startswith(b"PK"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                        if name is None:
                            raise ValueError(f"{path} holds no CSV file")
                        content = z.read(name)
                rows.append((path, name, content))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["path", "name", "content"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, "path string, name string, content binary")


def label_states(spark: SparkSession, path: str, table: str = "row_states") -> DataFrame:
    """row_index, status, final_label, updated_at of a labelling bot's SQLite file: state of one bot, read on the driver."""
    from tallyforge.schema import identifier

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        rows = con.execute(f"SELECT row_index, status, final_label, updated_at FROM {identifier(table)}").fetchall()
    return spark.createDataFrame(rows, "row_index long, status string, final_label string, updated_at string")


def catalog_tasks(df: DataFrame) -> DataFrame:
    """One row for each path of a category: Путь and Путь2 with their filters, those that aren't empty."""
    have = lambda c: F.col(q(c)) if c in df.columns else F.lit(None).cast("string")
    pairs = F.array(*(F.struct(F.trim(have(p)).alias("path"), F.trim(have(f)).alias("filter"), F.lit(k).alias("slot")) for k, (p, f) in enumerate((("Путь", "Фильтр"), ("Путь2", "Фильтр2")))))
    keep = [c for c in df.columns if c not in ("Путь", "Путь2", "Фильтр", "Фильтр2")]
    return df.select(*(F.col(q(c)) for c in keep), F.explode(pairs).alias("x")).select(*(F.col(q(c)) for c in keep), "x.*").where("path <> ''")


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """One CSV file with a byte order mark, in the order of ``df``; values pass through one task, as one file needs."""
    names = [f"﻿{c}" if k == 0 else c for k, c in enumerate(df.columns)]
    df.toDF(*names).coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", "").csv(path)


def write_by_category(df: DataFrame, path: str, column: str = "__category_key", confirmed: bool = False, sep: str = ";", most_rows: int = SHEET_ROWS) -> list[str]:
    """A folder of CSV files for each category, without rows of none; gives the categories. More than ``MOST_FILES``
    need to be ``confirmed``. A file holds at most ``most_rows`` rows; a large category is written by several tasks."""
    there = df.where(F.trim(F.col(q(column)).cast("string")) != "")
    names = sorted(str(r[0]) for r in there.select(F.col(q(column))).distinct().limit(MOST_CATEGORIES + 1).collect())
    if len(names) > MOST_CATEGORIES or len(names) > MOST_FILES and not confirmed:
        raise ValueError(f"that makes more than {min(len(names), MOST_CATEGORIES) - 1} files; confirm it")
    there.withColumn("_to", F.col(q(column))).write.mode("overwrite").partitionBy("_to").option("maxRecordsPerFile", most_rows).option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return names


def read_strict(spark: SparkSession, paths: Sequence[str], sep: str = ";", encoding: str = "utf-8-sig") -> DataFrame:
    """CSV files one after the other, all columns as text, with ``_file`` (place in ``paths``) and ``_row`` (from 1, in
    the file's order). Columns are those of all files, NULL where a file lacks one. A short row is filled with NULLs; one
    of too many fields is an error."""
    out = None
    for k, path in enumerate(paths):
        names = _header(head_of(spark, path), encoding, sep)
        more = "_more" + "_" * max(map(len, names))
        schema = StructType([StructField(n, StringType()) for n in [*names, more]])
        #: A file of quoted line breaks is read as one split, so the row's number is its place in that split.
        reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("enforceSchema", True)
        rows = reader.option("encoding", "ISO-8859-1" if encoding == "cp1251" else "UTF-8").csv(path)
        rows = rows.where(F.when(F.col(q(more)).isNull(), F.lit(True)).otherwise(F.raise_error(F.lit(f"{path}: a row has over {len(names)} fields")).cast("boolean"))).drop(more)
        if encoding == "cp1251":
            high = bytes(range(128, 256))
            rows = rows.select(*(F.translate(F.col(q(n)), high.decode("latin-1"), high.decode("cp1251", "replace")).alias(n) for n in names))
        rows = rows.withColumns({"_file": F.lit(k), "_row": F.monotonically_increasing_id() + 1})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that rules run on: a spreadsheet by its name's ending, else a sniffed CSV file."""
    from tallyforge.sources.sheets import read_sheet

    return read_sheet(spark, path) if path.lower().endswith((".xlsx", ".xlsm")) else read_any_csv(spark, path)


def file_stats(spark: SparkSession, root: str, parts: Sequence[str]) -> DataFrame:
    """project, and for each of ``parts`` (folders inside a project's folder) the number and the bytes of its files."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for s in store.listStatus(p):
        if s.isDirectory():
            row: list[object] = [s.getPath().getName()]
            for part in parts:
                inner = jvm.org.apache.hadoop.fs.Path(s.getPath(), part)
                found = store.getContentSummary(inner) if store.exists(inner) else None
                row += [found.getFileCount() if found else 0, found.getLength() if found else 0]
            rows.append(tuple(row))
    return spark.createDataFrame(rows, "project string" + "".join(f", {q(f'{x}_files')} long, {q(f'{x}_bytes')} long" for x in parts))


def sheet_guard(rows: int) -> None:
    if rows > SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS} rows; there are {rows}")


def manifest(values: Mapping[str, object]) -> str:
    return json.dumps(values, ensure_ascii=False, sort_keys=True, default=str)


def write_manifest(spark: SparkSession, path: str, values: Mapping[str, object]) -> str:
    """A manifest as a JSON file, which appears whole or not at all; gives its text."""
    text = manifest(values)
    storage.write_text(spark, path, text)
    return text
