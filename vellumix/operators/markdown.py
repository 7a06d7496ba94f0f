"""Markdown documents: blocks, chunks, and their translation with protected fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumix.functions import ordered, protect
from vellumix.functions import text as T
from vellumix.functions.dialect import SPARK

CHUNK_CHARS = 4000
IMAGE_LINK = r"!\[[^\]]*\]\([^)]+\)"


def with_chunks(docs: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` with arrays ``blocks`` and ``chunks``, inside their rows."""
    return ordered.with_chunks(ordered.with_blocks(docs), most)


def chunks(docs: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, chunk_index, text)"""
    return with_chunks(docs, most).select("doc_id", F.posexplode("chunks").alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def fake(text: Column) -> Column:
    """The translator for tests: a fixed prefix."""
    return F.concat(F.lit("[ZH] "), text)


def translated_chunks(found: DataFrame, translate: Callable[[Column], Column] = fake, mode: str = "conservative", cache=None) -> DataFrame:
    """Chunks with ``translated`` text and ``error``; one whose placeholders the translator lost keeps its raw text, and ``intact`` says so.

    With a ``translate.Cache``, what was answered before isn't sent again. A failed chunk has an error and keeps its raw text.
    """
    from vellumix.operators import translate as requests

    out = found.withColumn("_clean", T.column(T.normalized, "text", mode=mode))
    out = protect.protected(out, "_clean")
    if cache is None:
        out = requests.answered(out, translate, F.col("protected"), "_answer")
    else:
        out = requests.remembered(out, translate, cache, "protected").withColumnRenamed("answer", "_answer")
    out = out.withColumn("_answer", T.column(T.normalized, "coalesce(_answer, '')", mode=mode)).withColumn("intact", F.col("error").isNull() & F.expr(protect.intact(SPARK, "_answer", "fragments")))
    out = out.withColumn("translated", F.when(F.col("intact"), F.expr(protect.restored(SPARK, "_answer", "fragments"))).otherwise(F.col("text")))
    return out.drop("_clean", "_answer", "protected")


def translated(docs: DataFrame, translate: Callable[[Column], Column] = fake, most: int = CHUNK_CHARS, mode: str = "conservative", cache=None) -> DataFrame:
    """(doc_id, n_chunks, text, error): documents translated chunk by chunk and put together in order; the first chunk's error, if any failed."""
    parts = translated_chunks(chunks(docs, most), translate, mode, cache)
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "translated")))
    first_error = F.min(F.when(F.col("error").isNotNull(), F.struct("chunk_index", "error")))["error"]
    out = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), ordered.alias("_parts"), first_error.alias("error"))
    texts = F.filter(F.transform("_parts", lambda p: p["translated"]), lambda t: t != "")
    return out.select("doc_id", "n_chunks", F.array_join(texts, "\n\n").alias("text"), "error")


def localized(docs: DataFrame, files: list[str], base: str = "") -> DataFrame:
    """``docs`` whose image links to listed ``files`` point to ``assets/``, and ``copies`` (source, name) to make.

    ``files`` are paths relative to ``base``. Equal stems get "-1", "-2" and so on, the first that is free.
    """
    listed = F.array(*[F.lit(f) for f in files]).cast("array<string>")
    target = lambda link: F.trim(F.regexp_extract(link, r"\]\(([^)]+)\)$", 1))
    out = docs.withColumn("_links", F.regexp_extract_all("text", F.lit(f"({IMAGE_LINK})"), F.lit(1))).withColumn("_listed", listed)
    path = lambda t: F.concat(F.lit(base), t)
    out = out.withColumn("_sources", F.array_distinct(F.filter(F.transform("_links", target), lambda t: ~F.contains(t, F.lit("://")) & F.array_contains("_listed", path(t)))))

    def named(state, source):
        name = F.regexp_extract(source, r"[^/]*$", 0)
        stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"[^A-Za-z0-9._\-]+", "-")
        suffix = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))
        stem = F.when(stem == "", "asset").otherwise(stem)
        tries = F.transform(F.sequence(F.lit(0), F.size(state)), lambda i: F.concat(stem, F.when(i == 0, "").otherwise(F.concat(F.lit("-"), i.cast("string"))), suffix))
        free = F.get(F.filter(tries, lambda t: ~F.exists(state, lambda c: c["name"] == t)), F.lit(0))
        return F.concat(state, F.array(F.struct(source.alias("source"), free.alias("name"))))

    none = F.expr("CAST(array() AS array<struct<source:string,name:string>>)")
    out = out.withColumn("copies", F.aggregate("_sources", none, named))
    # Every link is cut at its target, so that equal text elsewhere stays.
    marked = F.split(F.regexp_replace("text", r"(!\[[^\]]*\]\()([^)]+)(\))", "$1\x01$2\x01$3"), "\x01")
    swapped = F.transform(marked, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.concat(F.lit("assets/"), F.get(F.filter("copies", lambda c: c["source"] == F.trim(p)), F.lit(0))["name"]), p)).otherwise(p))
    return out.withColumn("text", F.array_join(swapped, "")).select(*docs.columns, "copies")
