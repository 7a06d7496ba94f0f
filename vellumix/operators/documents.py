"""Documents as titles, sections, paragraphs and spans, and their translation.

Each level is a table with the indices of those above, so that a document of any size is many rows:
sections (doc_id, section_index, ...), paragraphs (doc_id, section_index, paragraph_index, text), spans
(doc_id, section_index, paragraph_index, span_index, text, translatable).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumix import shared
from vellumix.functions import math as M
from vellumix.functions import text as T
from vellumix.operators import pages, spans, translate
from vellumix.operators.markdown import fake

BULLET = "• "
SPAN_KEYS = ["doc_id", "section_index", "paragraph_index", "span_index"]


class Model(NamedTuple):
    titles: DataFrame
    sections: DataFrame
    spans: DataFrame


def paragraphs(found: DataFrame, outline: DataFrame) -> DataFrame:
    """(doc_id, section_index, paragraph_index, text) of units with ``raw`` and their outline; bullets are marked."""
    own = found.where("type <> 'heading'").join(outline.select("doc_id", "raw", "section_index"), ["doc_id", "raw"])
    index = F.row_number().over(Window.partitionBy("doc_id", "section_index").orderBy("page_number", "unit_no")) - 1
    text = F.when(F.col("type") == "bullet", F.concat(F.lit(BULLET), "text")).otherwise(F.col("text"))
    return own.select("doc_id", "section_index", index.cast("long").alias("paragraph_index"), text.alias("text"))


def span_rows(own: DataFrame, mode: str = "conservative") -> DataFrame:
    """The spans of paragraphs that aren't blank."""
    cut = spans.with_spans(own.where(T.column(T.strip, "text") != ""), mode=mode)
    each = cut.select("doc_id", "section_index", "paragraph_index", F.posexplode("spans").alias("span_index", "s"))
    return each.select("doc_id", "section_index", "paragraph_index", F.col("span_index").cast("long").alias("span_index"), "s.*")


def titles(sections: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(doc_id, title): the given one (doc_id, title), else the first section's heading, else a constant."""
    own = sections.groupBy("doc_id").agg(F.min_by("heading", "section_index").alias("_first"))
    if given is not None:
        own = own.join(given.select("doc_id", F.col("title").alias("_given")), "doc_id", "left")
    else:
        own = own.withColumn("_given", F.lit(None).cast("string"))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return own.select("doc_id", F.coalesce(some("_given"), some("_first"), F.lit(pages.TITLE_FALLBACK)).alias("title"))


def model(clean: DataFrame, given: DataFrame | None = None, mode: str = "conservative") -> Model:
    """The model of cleaned pages."""
    found, _ = shared.materialize(pages.paragraphs(shared.materialize(pages.units(clean), "units")[0]), "paragraphs")
    outline, _ = shared.materialize(pages.outline(found), "outline")
    sections = pages.with_default(outline.drop("raw"), clean)
    own, _ = shared.materialize(span_rows(paragraphs(found, outline), mode), "spans")
    return Model(titles(sections, given), sections, own)


def translated(document: Model, translator: translate.Translator = fake, mode: str = "conservative", concurrency: int | None = None, quality: tuple[translate.Translator, translate.Translator] | None = None) -> Model:
    """The model with everything normalized, headings worth it and spans translated; a title is not."""
    clean = lambda df, c: shared.fenced(df.withColumn(c, T.column(T.normalized, c, mode=mode)))
    sections = clean(document.sections, "heading").withColumn("_worth", T.column(M.worth_translating, "heading"))
    sections, _ = shared.materialize(sections, "headings")
    said = clean(translate.answered(sections.where("_worth"), translator, F.col("heading"), "heading").drop("error"), "heading")
    sections = sections.where("NOT _worth").unionByName(said).drop("_worth")
    own = translate.translated_spans(clean(document.spans, "text"), SPAN_KEYS, translator, concurrency, quality)
    return Model(clean(document.titles, "title"), sections, own)


def paragraph_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, section_index, paragraph_index, text): spans put together."""
    parts = F.sort_array(F.collect_list(F.struct("span_index", "text")))
    return rows.groupBy(SPAN_KEYS[:-1]).agg(parts.alias("p")).select(*SPAN_KEYS[:-1], F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))


def span_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, n_translatable, n_passthrough)"""
    return rows.groupBy("doc_id").agg(F.count_if("translatable").alias("n_translatable"), F.count_if(~F.col("translatable")).alias("n_passthrough"))


def control_counts(document: Model) -> DataFrame:
    """(doc_id, n_control): control characters in a document's title, headings and spans."""
    each = [df.select("doc_id", T.column(T.control_count, c).alias("n")) for df, c in ((document.titles, "title"), (document.sections, "heading"), (document.spans, "text"))]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("doc_id").agg(F.sum("n").alias("n_control"))
