"""Spreadsheets (XLSX) in and out, by the format's own parts: a ZIP archive of XML.

A sheet is written by one task as a stream, since a file is one archive; the format's row limit bounds it, and a table
of any size is a folder of sheets. Sheets are read by one task each.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from tallyforge import storage
from tallyforge.storage import Scratch

# The parts of the format.
SHEET_ROWS = 1_048_575
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELATIONS}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) < 1 << 53 or isinstance(value, float) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_FORBIDDEN.sub("", str(value)))}</t></is></c>'


def _values(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _store(columns: Sequence[str], rows: Iterable[Sequence], path: str, most_rows: int) -> int:
    """One file of a header and ``rows``; more than ``most_rows`` are an error, and no file. Gives their number."""
    import tempfile

    from pyarrow import fs

    n = 0
    with tempfile.TemporaryFile() as file:
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for name, part in _PARTS.items():
                z.writestr(name, _HEAD + part)
            with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                write = lambda values: sheet.write(f"<row>{''.join(map(_cell, values))}</row>".encode())
                sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                write(columns)
                for n, values in enumerate(rows, 1):
                    if n > most_rows:
                        raise ValueError(f"a sheet holds {most_rows} rows; there are more")
                    write(values)
                sheet.write(b"</sheetData></worksheet>")
        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        file.seek(0)
        with store.open_output_stream(place) as out:
            while part := file.read(1 << 20):
                out.write(part)
    return n


def write_sheet(df: DataFrame, path: str) -> int:
    """One XLSX file with a header, in the order of ``df``; more rows than a sheet holds are an error, and no file. Gives
    the number of rows. ``path`` is of a store that pyarrow opens."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_store(columns, _values(batches), path, SHEET_ROWS)], pa.int64())], ["rows"])

    #: One task as one file needs; a limit over the sheet's stops larger tables early, and the task refuses them.
    written = df.limit(SHEET_ROWS + 1).coalesce(1).mapInArrow(run, "rows long").first()
    if written is None:  # a table that is known to be empty runs no task
        written = df.sparkSession.range(0, 1, 1, 1).mapInArrow(lambda _: run(iter(())), "rows long").first()
    return written["rows"]


def write_sheets(df: DataFrame, path: str, most_rows: int | None = None) -> int:
    """A folder of XLSX files for a table of any size: ``df`` in its order, cut after every ``most_rows`` rows (a sheet's
    limit unasked), so ``sheet-00001.xlsx`` has the first. Each has the header and is written by one task; an empty table
    is one file. The folder appears whole, in place of an older one. Gives the number of rows."""
    spark, columns, path = df.sparkSession, df.columns, path.rstrip("/")
    most = SHEET_ROWS if most_rows is None else most_rows
    if not 1 <= most <= SHEET_ROWS:
        raise ValueError(f"a sheet holds 1 to {SHEET_ROWS} rows, not {most}")
    scratch, part = Scratch(spark, "sheets"), f"{path}.part-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in groupby(_values(batches), lambda row: row[0]):
            n = _store(columns, (row[1:] for row in rows), f"{part}/sheet-{k + 1:05d}.xlsx", most)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["rows"])

    try:
        #: Columns by place, as a sheet's may have any names; Parquet holds none without a type.
        plain = df.toDF(*(f"_{k}" for k in range(len(columns))))
        plain = plain.select(*(F.col(f.name).cast("string") if isinstance(f.dataType, NullType) else F.col(f.name) for f in plain.schema))
        #: The id is the partition, in its upper bits, and the place in it: written once, so that both reads see the same.
        kept = scratch.keep(plain.withColumn("at", F.monotonically_increasing_id()), "rows").withColumn("p", F.shiftright("at", 33))
        sizes = sorted(tuple(r) for r in kept.groupBy("p").count().collect())
        ends = list(accumulate(n for _, n in sizes))
        if not ends:
            _store(columns, (), f"{part}/sheet-00001.xlsx", most)
        else:
            base = spark.createDataFrame([(p, end - n) for (p, n), end in zip(sizes, ends, strict=True)], "p long, base long")
            numbered = kept.join(F.broadcast(base), "p").withColumn("sheet", F.expr(f"cast((base + (at & {(1 << 33) - 1})) div {most} as int)"))
            dealt = numbered.repartitionById(-(-ends[-1] // most), F.col("sheet")).sortWithinPartitions("sheet", "at")
            written = sum(r[0] for r in dealt.select("sheet", *plain.columns).mapInArrow(run, "rows long").collect())
            if written != ends[-1]:
                raise RuntimeError(f"{written} rows of {ends[-1]} are in sheets")
        storage.delete(spark, path)
        storage.move(spark, part, path)
    finally:
        storage.delete(spark, part)
        storage.delete(spark, scratch.root)
    return ends[-1] if ends else 0


def _texts(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    with archive.open("xl/sharedStrings.xml") as part:
        return ["".join(t.text or "" for t in e.iter(f"{{{_MAIN}}}t")) for _, e in ElementTree.iterparse(part) if e.tag == f"{{{_MAIN}}}si"]


def _place(reference: str | None, after: int) -> int:
    if not reference:
        return after
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows_of(content) -> Iterator[list[str | None]]:
    """The rows of the first sheet of a file, as text."""
    with zipfile.ZipFile(content) as z:
        shared = _texts(z)
        name = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))
        with z.open(name) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{{{_MAIN}}}row":
                    continue
                out: list[str | None] = []
                for c in row.iter(f"{{{_MAIN}}}c"):
                    at = _place(c.get("r"), len(out))
                    out += [None] * (at - len(out))
                    if c.get("t") == "inlineStr":
                        out.append("".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t")))
                    else:
                        v = c.find(f"{{{_MAIN}}}v")
                        out.append(None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text)
                row.clear()
                yield out


def read_sheet(spark: SparkSession, path: str, header: Sequence[str] | None = None) -> DataFrame:
    """The first sheet of a file, or of each file of a folder, all columns as text, short rows filled with NULLs; the
    first row names the columns, and files of other names are an error. Rows of a file keep their order."""
    import io

    files = spark.read.format("binaryFile").load(path).select("content")
    named = lambda row: [x or f"_{k}" for k, x in enumerate(row)]

    if header is None:

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array([next(rows_of(io.BytesIO(content.as_py())), [])], pa.list_(pa.string()))], ["r"])

        names = named(files.mapInArrow(first, "r array<string>").first()["r"])
    else:
        names = list(header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                part: list[list[str | None]] = []
                rows = rows_of(io.BytesIO(content.as_py()))
                if header is None and (found := named(next(rows, []))) != names:
                    raise ValueError(f"files of one table have one header, not {names} and {found}")
                for row in rows:
                    part.append(row)
                    if len(part) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], ["r"])
                        part = []
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], ["r"])

    rows = files.mapInArrow(run, "r array<string>")
    return rows.select(*(F.get("r", F.lit(k)).alias(n) for k, n in enumerate(names)))
