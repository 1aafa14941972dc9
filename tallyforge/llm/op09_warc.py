"""WARC archives: writer, monolithic gzip normaliser, and reader.

A crawl's archive may come as one gzip stream over the whole file, in which no record can be reached without inflating
all before it. The normaliser inflates such a file once, in pieces, and rewrites every record as a gzip member of its
own beside a sidecar index of offsets, so that any record is one seek away.

Files are deterministic and named by what they hold; they are written under another name and moved, so a task that runs
again after a lost executor leaves the same file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import Scratch, bloom, in_bloom, mix_keys

PIECE = 1 << 18
_DATE = "2024-01-01T00:00:00Z"


@dataclass
class Record:
    """A WARC record: its named fields, in order, and its block."""

    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def encoded(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.fields.items() if k != "Content-Length")
        return f"WARC/1.0\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block + b"\r\n\r\n"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def _header(value: str) -> str:
    """A header's value: line ends and what isn't plain are escaped as in JSON."""
    return json.dumps(value)[1:-1]


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Record:
    """A response with the page as HTTP body, or a revisit without body. Both name the full payload's digest and size."""
    digest = _digest(payload)
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _id(page_id, url, digest), "WARC-Date": _DATE}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        fields["WARC-Target-URI"] = _header(url)
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    fields["X-Payload-Length"] = str(len(payload))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return Record(fields, head + payload)
    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "X-Refers-To-Page-Id": str(refers_to)}
    return Record(fields, head)


def records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Records of a stream of bytes; holds one record and a piece."""
    data = bytearray()
    more = iter(pieces)

    def need(n: int) -> bool:
        while len(data) < n:
            piece = next(more, None)
            if piece is None:
                return False
            data.extend(piece)
        return True

    while True:
        at, seen = -1, 0
        while at < 0:
            at = data.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(data)
            if at < 0 and not need(len(data) + 1):
                if bytes(data).strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        first, *lines = bytes(data[:at]).decode().lstrip("\r\n").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {first[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        if not need(at + 4 + n):
            raise ValueError("an archive ends inside a record's block")
        yield Record(fields, bytes(data[at + 4 : at + 4 + n]))
        need(at + 8 + n)
        del data[: at + 8 + n]


def inflate(source) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in pieces."""
    z = zlib.decompressobj(31)
    while piece := source.read(PIECE):
        while piece:
            out = z.decompress(piece, 4 * PIECE)
            if out:
                yield out
            piece = z.unconsumed_tail
            if z.eof:
                piece, z = z.unused_data, zlib.decompressobj(31)
    rest = z.flush()
    if rest:
        yield rest


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class MonolithicWriter:
    """One gzip stream over a whole archive. ``close`` names it by its contents."""

    def __init__(self, folder: str, level: int = 3):
        self.store, self.folder = _store(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.temporary = f"{self.folder}/.{uuid.uuid4().hex}"
        self.out, self.z = self.store.open_output_stream(self.temporary, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
        self.sum, self.count, self.bytes = hashlib.sha1(), 0, 0

    def write(self, record: Record) -> None:
        data = record.encoded()
        self.sum.update(hashlib.sha1(data).digest())
        self.count, self.bytes = self.count + 1, self.bytes + len(data)
        self.out.write(self.z.compress(data))

    def close(self) -> str:
        self.out.write(self.z.flush())
        self.out.close()
        name = f"{self.folder}/{self.sum.hexdigest()}-{self.count}.warc.gz"
        self.store.move(self.temporary, name)
        return name.rsplit("/", 1)[1]


def normalise(source_folder: str, name: str, folder: str, level: int = 3) -> int:
    """Rewrite a monolithic archive record by record, with its index (``name`` and ``.idx``: offset, length, record id in
    a line), and give the number of records. The source is inflated once and stays."""
    store, path = _store(source_folder)
    target, to = _store(folder)
    target.create_dir(to, recursive=True)
    temporary = f"{to}/.{uuid.uuid4().hex}"
    at, lines = 0, []
    with store.open_input_stream(f"{path}/{name}", compression=None) as source, target.open_output_stream(temporary, compression=None) as out:
        for record in records(inflate(source)):
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = z.compress(record.encoded()) + z.flush()
            out.write(member)
            lines.append(f"{at} {len(member)} {record.fields['WARC-Record-ID']}\n")
            at += len(member)
    with target.open_output_stream(f"{temporary}.idx", compression=None) as out:
        out.write("".join(lines).encode())
    target.move(f"{temporary}.idx", f"{to}/{name}.idx")
    target.move(temporary, f"{to}/{name}")
    return len(lines)


def read_index(folder: str, name: str) -> list[tuple[int, int, str]]:
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/{name}.idx", compression=None) as f:
        return [(int(a), int(b), c) for a, b, c in (x.split(" ", 2) for x in f.read().decode().splitlines())]


def read_archive(folder: str, name: str) -> Iterator[Record]:
    """The records of a normalised archive, each from its own member by the index."""
    store, path = _store(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        for at, length, record_id in read_index(folder, name):
            f.seek(at)
            [record] = records(iter([zlib.decompress(f.read(length), 31)]))
            if record.fields["WARC-Record-ID"] != record_id:
                raise ValueError(f"{name}: the index doesn't fit at {at}")
            yield record


def _types(pages: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """page_id, digest, refers_to of the pages that are revisits: equal payloads, the smallest page_id is the response."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.where("page_id is not null").select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= least)
    known = scratch.keep(known.select("page_id", "digest"), "digests")
    first = known.groupBy("digest").agg(F.count("*").alias("c"), F.min("page_id").alias("refers_to")).where("c > 1")
    return scratch.keep(known.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")


def _write(batches: Iterator[pa.RecordBatch], folder: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    writer = None

    def closed():
        return pa.RecordBatch.from_arrays([pa.array([writer.close()]), pa.array([writer.count], pa.int64())], ["archive", "count"])

    for batch in batches:
        for page_id, url, page, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
            writer = writer or MonolithicWriter(folder)
            writer.write(page_record(page_id, url, (page or "").encode("utf-8", "surrogatepass"), refers_to))
            if writer.bytes >= most_bytes:
                yield closed()
                writer = None
    if writer:
        yield closed()


def write_archives(pages: DataFrame, folder: str, least: int = 0, most_bytes: int = 1 << 28) -> DataFrame:
    """Write all rows of ``pages`` to monolithic archives of about ``most_bytes`` in ``folder``; (archive, count) of each.

    Pages that can't be revisits, by a Bloom filter of fixed size, are written where they are read; only the others
    pass a join. Each row is a record: repeated rows of the first page_id are all responses. A null page_id is always a
    response and never referred to; a null html is empty, a null url has no target. Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc-types")
    pages = pages.select("page_id", "url", "html")
    revisits = _types(pages, scratch, least)
    table = scratch.send(bloom(revisits, ["page_id"]))

    def part(wanted: bool):
        def run(it):
            for batch in it:
                ids = batch.column("page_id")
                hit = in_bloom(table.value, mix_keys(ids.fill_null(-1).to_numpy(zero_copy_only=False))) & ids.is_valid().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(hit == wanted))
                if wanted:
                    if batch.num_rows:
                        yield batch
                else:
                    yield batch.append_column("refers_to", pa.nulls(batch.num_rows, pa.int64()))

        return run

    def sure(it):
        yield from _write(part(False)(it), folder, most_bytes)

    def rest(it):
        yield from _write(it, folder, most_bytes)

    asked = pages.mapInArrow(part(True), "page_id long, url string, html string").withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    asked = asked.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    one, two = pages.mapInArrow(sure, "archive string, count long"), asked.mapInArrow(rest, "archive string, count long")
    #: Same records, same name: a task that ran twice has written one file.
    out = scratch.keep(one.union(two), "archives")
    scratch.release()
    return out


def normalise_archives(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """Normalise each archive in a task of its own; (archive, count) again."""

    def run(it):
        for batch in it:
            names = batch.column("archive").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([normalise(source, n, folder) for n in names], pa.int64())], ["archive", "count"])

    return Scratch(archives.sparkSession, "warc-normal").keep(_spread(archives).mapInArrow(run, "archive string, count long"), "archives")


def _spread(archives: DataFrame) -> DataFrame:
    n = max(1, archives.count())
    return archives.repartition(n)


def read_pages(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, url, html (null for a revisit), payload_bytes, payload_digest, record_type, refers_to of each record."""
    schema = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(it):
        for batch in it:
            for name in batch.column("archive").to_pylist():
                rows, held = [], 0
                for r in read_archive(folder, name):
                    f = r.fields
                    body = r.block.split(b"\r\n\r\n", 1)[1]
                    digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                    if f["WARC-Type"] == "response" and (len(body) != size or _digest(body) != digest):
                        raise ValueError(f"{name}: a payload doesn't fit its digest")
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    url = json.loads(f'"{f["WARC-Target-URI"]}"') if "WARC-Target-URI" in f else None
                    rows.append((number("X-Page-Id"), url, body.decode("utf-8", "surrogatepass") if f["WARC-Type"] == "response" else None, size, digest, f["WARC-Type"], number("X-Refers-To-Page-Id")))
                    held += len(body)
                    if held > 4 * PIECE or len(rows) >= 5000:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return _spread(archives).mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op9_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written as monolithic archives, normalised, and read back by the index."""
    scratch = Scratch(spark, "warc")
    whole, single = scratch.path("monolithic"), scratch.path("normalised")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), whole)
    archives = normalise_archives(archives, whole, single)
    scratch.drop("monolithic")
    return read_pages(archives, single).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS m FROM d GROUP BY h),
x AS (SELECT d.*, m, list_transform(range(40), lambda i: instr('0123456789abcdef', h[i + 1]) - 1) AS v FROM d JOIN f USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(list_sum(list_transform(range(5), lambda j:
    ((v[(5 * k + j) // 4 + 1] >> (3 - (5 * k + j) % 4)) & 1) << (4 - j))) AS INTEGER) + 1]), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
FROM x
"""
