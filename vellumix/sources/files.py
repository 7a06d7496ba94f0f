"""Sources and sinks: PDF bytes, Markdown files, downloads, converters.

Libraries and services that may not be installed are given as functions.
"""

from __future__ import annotations

import contextlib
import shutil
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumix import shared
from vellumix.errors import ExtractError
from vellumix.functions import text as T
from vellumix.functions.dialect import SPARK, Dialect

PDF_MAGIC = b"%PDF-"
HTML_REACH = 256
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "webp", "svg")
PAGE_SCHEMA = "doc_id string, page_number long, text string, images array<struct<image_id:string,ext:string,data:binary>>, error string"


def looks_html(d: Dialect, head: str) -> str:
    """Whether a payload's first characters begin an HTML page."""
    return d.test(d.sub(f"lower({head})", f"^[{T.WS}]+", ""), "^(<!doctype html|<html)")


def payload_error(d: Dialect, head: str, content_type: str) -> str:
    """Why a payload isn't a PDF, or null: what its type claims, then what it looks like."""
    return f"CASE WHEN {d.starts(head, chr(39) + '%PDF-' + chr(39))} THEN NULL WHEN contains(lower(coalesce({content_type}, '')), 'pdf') THEN 'claims to be a PDF but is not' WHEN {looks_html(d, head)} THEN 'is an HTML page' ELSE 'is not a valid PDF' END"


def with_payload_error(df: DataFrame, payload: str = "payload", content_type: str = "content_type") -> DataFrame:
    """``df`` with ``is_pdf`` and ``error`` by the payload's first bytes."""
    head = F.substring(F.col(payload).cast("binary"), 1, HTML_REACH).cast("string")
    out = df.withColumn("_head", F.coalesce(head, F.lit("")))
    return out.withColumns({"is_pdf": F.startswith("_head", F.lit("%PDF-")), "error": F.expr(payload_error(SPARK, "_head", content_type))}).drop("_head")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the Markdown files under a folder, in the order of their paths."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content)"""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Paths of image files under a folder, sorted."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(*IMAGE_SUFFIXES)).orderBy("path")


Images = list[tuple[str, bytes | Callable[[], bytes]]]


def pages(files: DataFrame, parse: Callable[[bytes], list[tuple[str, Images]]], max_pages: int | None = None) -> DataFrame:
    """Pages (PAGE_SCHEMA) of PDF files by ``parse(content) -> [(text, [(ext, image)])]``; an unreadable file gives one row with an error.

    An image is its bytes or a function that reads them. Images without bytes, or that can't be read, are
    dropped, after they were numbered from 0.
    """

    def read(image) -> bytes:
        try:
            return image() if callable(image) else image
        except Exception:
            return b""

    def run(batches):
        for frame in batches:
            rows = []
            for path, content in zip(frame.path, frame.content, strict=True):
                try:
                    found = parse(bytes(content))[:max_pages]
                    if not found:
                        raise ValueError("no pages")
                except Exception as e:
                    rows.append((path, None, None, [], str(e)))
                    continue
                for n, (text, own) in enumerate(found, 1):
                    each = [(i, ext, read(image)) for i, (ext, image) in enumerate(own)]
                    rows.append((path, n, text, [{"image_id": f"p{n}_img{i}", "ext": ext, "data": data} for i, ext, data in each if data], None))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text", "images", "error"]).astype({"page_number": "Int64"})

    shared.ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def fitz_pages(content: bytes) -> list[tuple[str, Images]]:
    """A parser for ``pages``, where the library is installed."""
    try:
        import fitz
    except ImportError as e:
        raise ExtractError("reading PDF files needs the library fitz, or another parser") from e

    out = []
    with fitz.open(stream=content, filetype="pdf") as book:
        for page in book:
            own: Images = []
            for image in page.get_images(full=True):
                data = {}
                with contextlib.suppress(Exception):
                    data = book.extract_image(image[0])
                own.append((data.get("ext", "bin"), data.get("image", b"")))
            out.append((page.get_text("text") or "", own))
    return out


def download(urls: DataFrame, fetch: Callable[[str], tuple[str, bytes]], attempts: int = 3, pause_s: float = 0.6, keep: list[str] | None = None) -> DataFrame:
    """(url, base_name, content_type, payload, error), and columns to ``keep``, by ``fetch(url) -> (content type, bytes)``, tried again after failures and wrong payloads."""

    def one(url: str) -> tuple[str | None, bytes | None, str | None]:
        why = None
        for n in range(1, attempts + 1):
            try:
                kind, data = fetch(url)
                if data.startswith(PDF_MAGIC):
                    return kind, data, None
                why = "is an HTML page" if data[:HTML_REACH].lstrip().lower().startswith((b"<!doctype html", b"<html")) else "is not a valid PDF"
            except Exception as e:
                why = str(e)
            if n < attempts:
                time.sleep(pause_s * n)
        return None, None, why

    def run(batches):
        for frame in batches:
            got = [one(u) for u in frame.url]
            yield frame.assign(content_type=[x[0] for x in got], payload=[x[1] for x in got], error=[x[2] for x in got])

    shared.ship(urls.sparkSession)
    own = urls.select("url", *(keep or []))
    out = own.mapInPandas(run, ", ".join(f"{c} {k}" for c, k in own.dtypes) + ", content_type string, payload binary, error string")
    return out.withColumn("base_name", T.column(T.base_name, "url"))


def convert(files: DataFrame, converter: Callable[[bytes], str], keep: list[str] | None = None) -> DataFrame:
    """(path, text, error), and columns to ``keep``: Markdown of each file by ``converter``; the last 8,000 characters of a failure."""

    def one(content) -> tuple[str | None, str | None]:
        try:
            return converter(bytes(content)), None
        except Exception as e:
            return None, str(e)[-8000:]

    def run(batches):
        for frame in batches:
            got = [one(c) for c in frame.pop("content")]
            yield frame.assign(text=[x[0] for x in got], error=[x[1] for x in got])

    shared.ship(files.sparkSession)
    own = files.select("path", *(keep or []), "content")
    return own.mapInPandas(run, ", ".join(f"{c} {k}" for c, k in own.dtypes if c != "content") + ", text string, error string")


def stem(d: Dialect, path: str) -> str:
    """A file's name without its folders and its last extension."""
    return d.sub(d.first(path, r"[^/\\]*$"), r"([^.].*)\.[^.]*$", r"\1")


def output_name(d: Dialect, path: str) -> str:
    """The name of a file's translation, in its own folder."""
    return d.cat(d.sub(path, r"([^/\\.][^/\\]*)\.[^./\\]*$", r"\1"), "'.zh.md'")


def write_texts(docs: DataFrame, path: str) -> None:
    """A table of (name, text) under ``path``: few large files, however many texts. ``export`` makes files of them."""
    docs.select(F.col("name").cast("string"), "text").write.mode("overwrite").option("compression", "zstd").parquet(path)


def _filesystem(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def copy_inputs(inputs: DataFrame, folder: str) -> DataFrame:
    """A copy of every file (job_id, path, content) in its job's folder, under ``source``; returns (name, size)."""
    name = F.concat("job_id", F.lit("/source/"), F.element_at(F.split("path", r"[/\\\\]"), -1))
    return export(inputs.select(name.alias("name"), F.col("content").alias("text")), folder)


def export(docs: DataFrame, folder: str) -> DataFrame:
    """A file for each (name, text or bytes), where folders in ``name`` are made; returns (name, size).

    Executors write them to ``folder``, a path or URI that all of them reach, each file beside its place
    and then moved there: a task that runs again only replaces what it has written.
    """

    def run(batches):
        system, root = _filesystem(folder)
        for frame in batches:
            sizes = []
            for name, text in zip(frame.name, frame.text, strict=True):
                parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".", "..")]
                place = "/".join([root.rstrip("/"), *parts])
                system.create_dir(place.rpartition("/")[0], recursive=True)
                data, beside = text.encode() if isinstance(text, str) else bytes(text or b""), f"{place}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(beside) as out:
                    out.write(data)
                system.move(beside, place)
                sizes.append(len(data))
            yield pd.DataFrame({"name": frame.name, "size": sizes})

    shared.ship(docs.sparkSession)
    return shared.materialize(docs.select("name", "text").mapInPandas(run, "name string, size long"), "exported")[0]


def export_assets(copies: DataFrame, source: str, folder: str) -> DataFrame:
    """Copies of files (source, name) from the folder ``source`` into ``folder``; returns (source, name, error)."""

    def run(batches):
        (there, base), (system, root) = _filesystem(source), _filesystem(folder)
        for frame in batches:
            why = []
            for path, name in zip(frame.source, frame.name, strict=True):
                try:
                    system.create_dir(root, recursive=True)
                    beside = f"{root}/{name}.{uuid.uuid4().hex}.part"
                    with there.open_input_stream(f"{base.rstrip('/')}/{path}") as data, system.open_output_stream(beside) as out:
                        shutil.copyfileobj(data, out)
                    system.move(beside, f"{root}/{name}")
                    why.append(None)
                except OSError as e:
                    why.append(str(e))
            yield frame.assign(error=why)

    shared.ship(copies.sparkSession)
    return shared.materialize(copies.select("source", "name").distinct().mapInPandas(run, "source string, name string, error string"), "assets")[0]
