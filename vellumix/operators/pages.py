"""Pages of documents: repeated headers and footers, headings, sections, OCR results.

``pages`` has (doc_id, page_number, text). What concerns one page is computed inside its row; only
repeated lines (at most eight short rows a page), sections and images are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumix import shared
from vellumix.errors import OCRError
from vellumix.functions import ordered
from vellumix.functions import text as T
from vellumix.functions.dialect import SPARK

DEFAULT_HEADING = "正文"
TITLE_LENGTH, TITLE_FALLBACK = 120, "Translated Document"
EDGE = 4
OCR_THRESHOLD = 50


def lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, line): stripped lines that aren't blank, numbered from 0."""
    own = pages.withColumn("_lines", F.expr(SPARK.keep(SPARK.map(T.lines(SPARK, "text"), "e", T.strip(SPARK, "e")), "e", "e <> ''")))
    return own.select("doc_id", "page_number", F.posexplode("_lines").alias("line_no", "line"))


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, side, key, n): keys of lines that occur twice or more among the pages' first or last four."""
    own = pages.select("doc_id", F.expr(SPARK.keep(SPARK.map(T.lines(SPARK, "text"), "e", T.strip(SPARK, "e")), "e", "e <> ''")).alias("_lines"))
    edge = lambda side, xs: own.select("doc_id", F.lit(side).alias("side"), F.explode(xs).alias("line"))
    both = edge("top", F.slice("_lines", 1, EDGE)).unionByName(edge("bottom", F.slice(F.reverse("_lines"), 1, EDGE)))
    return both.groupBy("doc_id", "side", T.column(T.repeat_key, "line").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def cleaned(pages: DataFrame, mode: str = "conservative") -> DataFrame:
    """Pages whose text is normalized, without repeated headers and footers, and with broken formulas joined."""
    repeated = repeated_lines(pages).groupBy("doc_id").agg(F.collect_set(F.when(F.col("side") == "top", F.col("key"))).alias("_top"), F.collect_set(F.when(F.col("side") == "bottom", F.col("key"))).alias("_bottom"))
    empty = F.array().cast("array<string>")
    out = pages.join(shared.apart(repeated), "doc_id", "left")  # a document may have any share of all pages.withColumns({"_top": F.coalesce("_top", empty), "_bottom": F.coalesce("_bottom", empty)})
    out = out.withColumn("_text", T.column(T.normalized, "text", mode=mode)).withColumn("_lines", F.expr(T.lines(SPARK, "_text")))
    out = out.withColumn("_lines", F.expr(SPARK.map("_lines", "e", T.strip_end(SPARK, "e"))))
    out = out.withColumn("_lines", F.expr(ordered.without_repeats("_lines", "_top", "_bottom"))).withColumn("_lines", F.expr(ordered.joined_lines("_lines")))
    return out.withColumn("text", F.expr(T.strip(SPARK, "array_join(_lines, chr(10))"))).select(pages.columns)


def units(clean: DataFrame) -> DataFrame:
    """(doc_id, page_number, unit_no, type, text) of cleaned pages; front matter of a document's first page left out."""
    first = clean.groupBy("doc_id").agg(F.min("page_number").alias("_first"))
    own = ordered.with_units(clean.where("text <> ''"), out="_units").join(shared.apart(first), "doc_id")
    matter = SPARK.map("_units", "u", f"u.type = 'bullet' OR NOT {T.front_matter(SPARK, 'u.text')}")
    begin = F.when(F.col("page_number") == F.col("_first"), F.expr(f"array_position({matter}, true)")).otherwise(F.lit(1))
    kept = F.when(begin == 0, F.slice("_units", 1, 0)).otherwise(F.slice("_units", begin.cast("int"), F.greatest(F.size("_units"), F.lit(1))))
    return own.select("doc_id", "page_number", F.posexplode(kept).alias("unit_no", "u")).select("doc_id", "page_number", "unit_no", "u.*")


def paragraphs(found: DataFrame) -> DataFrame:
    """Units with the number of their section (``raw``: 0 before any heading, else the heading's number in the document).

    Headings are counted in each page and summed over pages, so that what is ordered for a whole
    document is a row a page.
    """
    is_heading = F.when(F.col("type") == "heading", 1).otherwise(0)
    inside = F.sum(is_heading).over(Window.partitionBy("doc_id", "page_number").orderBy("unit_no"))
    by_page = found.groupBy("doc_id", "page_number").agg(F.sum(is_heading).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("doc_id").orderBy("page_number")) - F.col("_n")
    return found.withColumn("_inside", inside).join(by_page.select("doc_id", "page_number", before.alias("_before")), ["doc_id", "page_number"]).withColumn("raw", F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def outline(found: DataFrame) -> DataFrame:
    """(doc_id, raw, section_index, heading, level, page_numbers, n_paragraphs) of the sections that have paragraphs, from units with ``raw``."""
    heading = F.max(F.when(F.col("type") == "heading", F.col("text")))
    grouped = found.groupBy("doc_id", "raw").agg(heading.alias("heading"), F.sort_array(F.collect_set("page_number")).alias("page_numbers"), F.count_if(F.col("type") != "heading").alias("n_paragraphs")).where("n_paragraphs > 0")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("raw")) - 1
    level = F.when(F.col("heading").isNull(), F.lit(1).cast("long")).otherwise(T.column(T.heading_level, "heading"))
    return grouped.select("doc_id", "raw", index.cast("long").alias("section_index"), F.coalesce("heading", F.lit(DEFAULT_HEADING)).alias("heading"), level.alias("level"), "page_numbers", "n_paragraphs")


def with_default(real: DataFrame, clean: DataFrame) -> DataFrame:
    """Sections, and a default one for each document without any."""
    none = clean.select("doc_id").distinct().join(real.select("doc_id").distinct(), "doc_id", "left_anti")
    return real.unionByName(none.select("doc_id", F.lit(0).cast("long").alias("section_index"), F.lit(DEFAULT_HEADING).alias("heading"), F.lit(1).cast("long").alias("level"), F.array().cast("array<bigint>").alias("page_numbers"), F.lit(0).cast("long").alias("n_paragraphs")))


def sections(clean: DataFrame) -> DataFrame:
    """(doc_id, section_index, heading, level, page_numbers, n_paragraphs); a document without any gets a default one."""
    found, _ = shared.materialize(units(clean), "units")  # read three times
    return with_default(outline(paragraphs(found)).drop("raw"), clean)


def image_sections(images: DataFrame, found: DataFrame) -> DataFrame:
    """Images (doc_id, page_number, image_id) with the first section on their page, else the document's last."""
    on_page = found.select("doc_id", "section_index", F.explode("page_numbers").alias("page_number")).groupBy("doc_id", "page_number").agg(F.min("section_index").alias("_own"))
    last = found.groupBy("doc_id").agg(F.max("section_index").alias("_last"))
    return images.join(on_page, ["doc_id", "page_number"], "left").join(last, "doc_id", "left").select("doc_id", "page_number", "image_id", F.coalesce("_own", "_last").alias("section_index"))


def titles(pages: DataFrame, fallback: str = TITLE_FALLBACK) -> DataFrame:
    """(doc_id, title): the first line of a document that isn't blank, cut to 120 characters."""
    first = lines(pages).groupBy("doc_id").agg(F.min_by("line", F.struct("page_number", "line_no")).alias("line"))
    return pages.select("doc_id").distinct().join(first, "doc_id", "left").select("doc_id", F.coalesce(F.left("line", F.lit(TITLE_LENGTH)), F.lit(fallback)).alias("title"))


def low_text(pages: DataFrame, threshold: int = OCR_THRESHOLD) -> DataFrame:
    """Pages with fewer than ``threshold`` characters."""
    return pages.where(F.length(T.column(T.strip, "coalesce(text, '')")) < threshold)


def with_ocr(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages with OCR text (doc_id, page_number, ocr_text), stripped, where there is any that isn't blank."""
    found = F.coalesce(T.column(T.strip, "ocr_text"), F.lit("")) != ""
    text = F.when(found, T.column(T.strip, "ocr_text")).otherwise(F.col("text"))
    joined = pages.join(ocr, ["doc_id", "page_number"], "left")
    out = joined.select("doc_id", "page_number", F.col("text").alias("raw_text"), text.alias("text"), found.alias("used_ocr"))
    return out.select("doc_id", "page_number", "raw_text", "text", F.length(T.column(T.strip, "coalesce(text, '')")).cast("long").alias("text_len"), "used_ocr")


def ocr_fallback(pages: DataFrame, recognize, threshold: int = OCR_THRESHOLD, language: str = "eng") -> DataFrame:
    """Pages after ``recognize(doc_id, page_number, language) -> text`` ran for those with little text.

    Only these reach the function: they are filtered before it, not in it.
    """

    def one(doc, page):
        try:
            return recognize(doc, page, language)
        except Exception as e:
            raise OCRError(f"OCR failed for page {page}: {e}") from e

    def run(batches):
        for frame in batches:
            frame["ocr_text"] = [one(d, p) for d, p in zip(frame.doc_id, frame.page_number, strict=True)]
            yield frame

    shared.ship(pages.sparkSession)
    low = low_text(pages, threshold).select("doc_id", "page_number")
    kinds = ", ".join(f"{c} {k}" for c, k in low.dtypes)
    return with_ocr(pages, low.mapInPandas(run, f"{kinds}, ocr_text string"))
