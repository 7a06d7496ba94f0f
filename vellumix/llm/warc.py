"""WARC archives in which repeated payloads are revisit records, and their resolution.

``write_archives`` shuffles headers (id, digest, length; no payloads) by payload digest, makes the
record with the largest id of each digest the response and the others revisits that name it, and
writes WARC 1.1 files with fresh headers through Spark's own writer and commit protocol, to any file
system. Every record is a gzip member of its own, so that readers can begin at any; files are cut at
``FILE_BYTES`` of records (one record more at most) and begin with a warcinfo record each. Spark names
them as text; what they hold, after names of its choice, is what a ``.warc.gz`` file holds.
``read_archives`` reads such files, one record at a time, and checks lengths and digests; files beyond
``LARGE`` are streamed from their file system. ``resolve`` joins revisits to the responses that they
refer to, again by digest.

A digest may be that of any share of all rows: its maximum is taken in each task first and dealt out
anew, so that the joins with it are plain equi-joins, whose large partitions Spark splits. Payloads
are shuffled once, by id.

Defined results: a null payload is an empty one and equals other empty ones; rows with the largest
id of their payload are all responses, so repeated rows of that id are; a null id is less than any
other and is written without a page id; payloads under ``min_bytes`` are all responses; a revisit
whose original isn't in the archives resolves to nulls. Damaged files raise ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumix.llm import _common

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES, ROWS_PER_FILE = 64 << 20, 16  # a file is so many rows of records put together
LARGE = 512 << 20
#: A gzip member of nothing, in ISO 8859-1: what Spark's text writer puts after every row.
NOTHING = gzip.compress(b"", mtime=0).decode("latin-1")
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, by RFC 4122


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def member(data: bytes) -> bytes:
    """A record and the line ends after it as a gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.compress(b"\r\n\r\n") + z.flush()


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None, str] | None, date: str) -> bytes:
    """A response, or a revisit of the record made for ``refers_to``; without the two line ends after it."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", "sha1:" + digest32(hashlib.sha1(payload).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers_to)), ("WARC-Refers-To-Target-URI", refers_to[1])]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", block])


def info_record(date: str) -> bytes:
    """The record that describes a file."""
    block = b"software: vellumix\r\nformat: WARC File Format 1.1\r\n"
    head = [f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMES, 'warcinfo ' + date)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}".encode()]
    return b"\r\n".join([VERSION, *head, b"", block])


class Record(NamedTuple):
    head: dict[str, str]  # names in lower case
    block: bytes


def records(stream) -> Iterator[Record]:
    """All records of an open (decompressed) file."""
    while first := stream.readline():
        if first == b"\r\n":
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not the beginning of a record: {first[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            head[name.decode().strip().lower()] = value.decode(errors="replace").strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) < n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield Record(head, block)


def http_payload(block: bytes) -> tuple[int | None, bytes]:
    """(declared length, payload) of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), payload
    return None, payload


def _decided(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(id, sha1, length, original id, original url) for each id and payload."""
    heads = pages.select("id", "url", "sha1", "n").distinct()
    # The largest id, and that record's url; a null id is less than any other.
    original = heads.groupBy("sha1", "n").agg(F.max(F.struct("id", "url")).alias("original"))
    return heads.join(_common.apart(original.where(F.col("n") >= min_bytes)), ["sha1", "n"], "left")


def rolled(made: Iterator[bytes], date: str, file_bytes: int = FILE_BYTES) -> Iterator[bytes]:
    """Records in rows of ``file_bytes`` / ``ROWS_PER_FILE`` before compression, every first one of a file after a warcinfo record."""
    row, size, rows = [member(info_record(date))], 0, 0
    for data in made:
        if size and size + len(data) > file_bytes // ROWS_PER_FILE:
            yield b"".join(row)
            rows += 1
            row, size = [] if rows % ROWS_PER_FILE else [member(info_record(date))], 0
        row.append(member(data))
        size += len(data)
    if size:
        yield b"".join(row)


def write_archives(df: DataFrame, path: str, id_column: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write a WARC record for each row, in files under ``path``; their date is that of the call where none is given."""
    _common.ship(df.sparkSession)
    date = date or now()
    pages = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), _common.text_bytes(payload).alias("data"))
    pages = pages.withColumns({"sha1": F.unhex(F.sha1("data")), "n": F.length("data")})
    decided = _decided(pages, min_bytes).select(F.col("id").alias("i"), F.col("url").alias("u"), F.col("sha1").alias("s"), "original")
    both = pages.join(decided, F.col("id").eqNullSafe(F.col("i")) & (F.col("url") == F.col("u")) & (F.col("sha1") == F.col("s")), "left")
    same = F.col("original").isNull() | F.col("id").eqNullSafe(F.col("original.id"))
    both = both.select("id", "url", "data", (~same).alias("again"), F.col("original.id").alias("to"), F.col("original.url").alias("to_url"))

    def made(batches) -> Iterator[bytes]:
        for batch in _common.slices(batches, "data"):
            columns = [batch.column(c).to_pylist() for c in ("id", "url", "data", "again", "to", "to_url")]
            for i, u, data, again, to, to_url in zip(*columns, strict=True):
                yield record(i, u, data, (to, to_url) if again else None, date)

    def run(batches):
        for row in rolled(made(batches), date, file_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["row"])

    rows = both.mapInArrow(run, "row binary").select(F.col("row").cast("string"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING).option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


_RECORDS = "file string, record_type string, record_id string, page_id long, url string, payload_digest string, refers_to_id string, payload_bytes long, payload binary"


def _opened(path: str, content: pa.Scalar):
    """A file's decompressed bytes as a stream: from its content, or where it is too large for that, from its file system."""
    if content.is_valid:
        source = pa.BufferReader(content.as_buffer())
    else:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        source = system.open_input_stream(name)
    return io.BufferedReader(gzip.GzipFile(fileobj=source), 1 << 20)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, pattern: str = "*", large: int = LARGE) -> DataFrame:
    """The response and revisit records of the files under ``path``; a revisit has no payload of its own."""
    _common.ship(spark)

    def run(batches):
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 3 + [pa.int64(), pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for r in records(_opened(file, content)):
                    kind = r.head.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    declared, payload = http_payload(r.block)
                    digest = r.head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (digest != digest32(hashlib.sha1(payload).digest()) or declared not in (None, len(payload))):
                        raise ValueError(f"{file}: {r.head['warc-record-id']} isn't what its digest and length say")
                    own = payload if kind == "response" else None
                    page = r.head.get("x-page-id")
                    rows.append((file, kind, r.head["warc-record-id"], None if page is None else int(page), r.head.get("warc-target-uri"), digest, r.head.get("warc-refers-to"), None if own is None else len(own), own if payloads else None))
                    held += len(payload) * payloads + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    small = files.where(F.col("length") <= large).select("path", "content")
    beyond = files.where(F.col("length") > large).select("path", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(beyond).mapInArrow(run, _RECORDS)


def resolve(found: DataFrame) -> DataFrame:
    """Headers of records, each revisit with the length and id of the response it refers to."""
    heads = found.drop("payload")
    original = heads.where("record_type = 'response'").groupBy("payload_digest", F.col("record_id").alias("refers_to_id")).agg(F.max("payload_bytes").alias("original_bytes"), F.max("page_id").alias("original_page"))
    joined = heads.join(_common.apart(original), ["payload_digest", "refers_to_id"], "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id",
        F.when(revisit, F.col("original_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.when(revisit, F.col("original_page")).alias("refers_to"),
        "record_id",
        "url",
    )


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """All pages through deduplicated archives and back."""
    path = _common.scratch(spark, "warc")
    write_archives(_common.read(spark, sf_dir, "pages"), path)
    return resolve(read_archives(spark, path, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, 10 * (k // 8) + 1, 10) AS BIGINT) >> (5 * (7 - k % 8))) & 31 AS INTEGER) + 1, 1) FOR k IN range(32)], '') AS digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM o
"""
