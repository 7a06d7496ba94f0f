"""All queries of the library, with the DuckDB SQL that checks them.

Queries run over the whole tables, through the views of ``plans.views`` where the tables' own text
would leave a rule without work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumix import settings, shared
from vellumix.functions import arrays, ordered, protect
from vellumix.functions import math as M
from vellumix.functions import text as T
from vellumix.functions.dialect import DUCK, SPARK, Dialect
from vellumix.operators import documents, jobs, markdown, pages, spans, translate
from vellumix.plans import views
from vellumix.sources import files
from vellumix.streaming import chunks as stream

Query = Callable[[SparkSession, str], DataFrame]
CAP = 400  # characters of a chunk in the checks: small, so that documents have several
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return put


def _rules(name: str, view: str, keys: tuple[str, ...], **rules: Callable[[Dialect], str]) -> None:
    """A query that shows row-local rules beside a view's keys."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.frame(spark, sf_dir, view).select(*keys, *[F.expr(r(SPARK)).alias(n) for n, r in rules.items()])

    _add(name, f"SELECT {', '.join(keys)}, " + ", ".join(f"{r(DUCK)} AS {n}" for n, r in rules.items()) + f" FROM {views.sql(view)}")(run)


def _lines_of(view: str) -> str:
    """DuckDB: the view's lines (doc_id, n, line) as they are."""
    return f"(SELECT doc_id, i AS n, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, {T.lines(DUCK, 'text')} AS ls FROM {views.sql(view)})))"


def _line_rules(name: str, view: str, **rules: Callable[[Dialect], str]) -> None:
    """As ``_rules``, for each line of the view's texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = views.frame(spark, sf_dir, view).select("doc_id", F.posexplode(F.expr(T.lines(SPARK, "text"))).alias("n", "line"))
        return own.select("doc_id", F.col("n").cast("long").alias("n"), *[F.expr(r(SPARK)).alias(k) for k, r in rules.items()])

    _add(name, "SELECT doc_id, n, " + ", ".join(f"{r(DUCK)} AS {k}" for k, r in rules.items()) + f" FROM {_lines_of(view)}")(run)


# Scalars and predicates.
_rules("q_basename", "urls", ("id",), base_name=lambda d: T.base_name(d, "url"))
_rules("q_url_validate", "urls", ("id",), error=lambda d: T.url_error(d, "url"), upload_error=lambda d: T.upload_error(d, "url"), upload_name=lambda d: T.upload_name(d, "url"))
_rules("q_normalize_off", "dirty_docs", ("doc_id",), text=lambda d: T.normalized(d, "text", "off"))
_rules("q_normalize_symbols", "dirty_docs", ("doc_id",), text=lambda d: T.symbols_repaired(d, T.without_controls(d, "text")))
_rules("q_normalize_cons", "dirty_docs", ("doc_id",), text=lambda d: T.normalized(d, "text"))
_rules("q_control_count", "dirty_docs", ("doc_id",), n_control=lambda d: T.control_count(d, "text"))
_line_rules("q_repeat_key", "conv_pages", key=lambda d: T.repeat_key(d, "line"))
_line_rules("q_heading", "conv_pages", is_heading=lambda d: T.heading(d, "line"), level=lambda d: T.heading_level(d, "line"), title_case=lambda d: T.title_case(d, T.strip(d, "line")), front_matter=lambda d: T.front_matter(d, "line"))
_line_rules("q_heading_worth", "math_docs", worth=lambda d: M.worth_translating(d, "line"))
_rules("q_math_like", "math_docs", ("doc_id",), **{f"{n}_{c}": (lambda d, r=r, c=c: r(d, c)) for c in ("formula", "text") for n, r in (("math", M.math_like), ("formulaish", M.formulaish), ("words", M.force_translatable), ("signals", M.signal_score), ("sums", M.has_sum_or_product))})
_rules("q_math_layout", "math_docs", ("doc_id",), collapsed=lambda d: M.collapsed(d, "formula"), layout=lambda d: M.sum_layout(d, "'∑ n  i = 1  i2 + formula'"), squares=lambda d: M.squares(d, "formula"), fraction=lambda d: M.set_fraction(d, "formula"), inline=lambda d: M.inline_squares(d, "formula"), tied=lambda d: M.tied_relations(d, "formula"))
_rules("q_section_count", "md_docs", ("doc_id",), n_sections=lambda d: T.markdown_sections(d, "text"))


@_add("q_long_split", f"SELECT doc_id, {arrays.long_split(DUCK, 'text', '(' + M.math_like(DUCK, 'text') + ')')} AS parts FROM {views.sql('math_docs')}")
def _long_split(spark, sf_dir):
    return ordered.with_long_split(views.frame(spark, sf_dir, "math_docs"), "text", T.column(M.math_like, "text"), "parts").select("doc_id", "parts")


_rules("q_quality_retry", "translations", ("doc_id",), english=lambda d: T.english_words(d, "translated"), chinese=lambda d: T.cjk_characters(d, "translated"), retry=lambda d: T.needs_retry(d, f"({M.math_like(d, 'source')})", "translated"))
_rules("q_retry_better", "translations", ("doc_id",), better=lambda d: T.retry_better(d, "source", "translated"))
_rules("q_residual", "translations", ("doc_id",), residual=lambda d: T.residual_english(d, f"({M.math_like(d, 'source')})", "translated"))
_rules("q_boundaries", "translations", ("doc_id",), text=lambda d: T.restore_boundaries(d, "source", "translated"))
_rules("q_fake_translate", "translations", ("doc_id",), text=lambda d: T.fake_translation(d, "source"))
_rules("q_cache_key", "translations", ("doc_id",), key=lambda d: T.cache_key(d, "'model-a'", T.fingerprint(d, "'prompt'", f"'{translate.POLICY}'"), "source"))


@_add("q_md_blocks", f"SELECT doc_id, {arrays.blocks(DUCK, 'text')} AS blocks FROM {views.sql('md_docs')}")
def _md_blocks(spark, sf_dir):
    return ordered.with_blocks(views.frame(spark, sf_dir, "md_docs")).select("doc_id", "blocks")


@_add("q_payloads", f"SELECT id, starts_with(payload, '%PDF-') AS is_pdf, {files.payload_error(DUCK, 'payload', 'content_type')} AS error FROM {views.sql('payloads')}")
def _payloads(spark, sf_dir):
    return files.with_payload_error(views.frame(spark, sf_dir, "payloads")).select("id", "is_pdf", "error")


# Pages: of conversations (short, with headers, headings and bullets), and of sources (long, and very many).
_STRIPPED = DUCK.keep(DUCK.map(T.lines(DUCK, "text"), "e", T.strip(DUCK, "e")), "e", "e <> ''")
PAGE_VIEWS = {"": "conv_pages", "doc_": "doc_pages"}


def _nonblank(view: str) -> str:
    return f"(SELECT doc_id, page_number, {_STRIPPED} AS ls FROM {views.sql(view)})"


def _repeated_sql(view: str) -> str:
    return f"""SELECT doc_id, side, {T.repeat_key(DUCK, 'line')} AS key, count(*) AS n FROM (
  SELECT doc_id, 'top' AS side, unnest(ls[1:4]) AS line FROM {_nonblank(view)}
  UNION ALL SELECT doc_id, 'bottom', unnest(list_reverse(ls)[1:4]) FROM {_nonblank(view)}) GROUP BY ALL HAVING count(*) >= 2"""


def _page_queries(prefix: str, view: str) -> None:
    of = lambda rule: lambda spark, sf_dir: rule(views.frame(spark, sf_dir, view))
    _add(f"q_{prefix}lines", f"SELECT doc_id, page_number, CAST(i AS INTEGER) AS line_no, ls[i + 1] AS line FROM (SELECT *, unnest(range(len(ls))) AS i FROM {_nonblank(view)})")(of(pages.lines))
    _add(f"q_{prefix}repeated_lines", _repeated_sql(view))(of(pages.repeated_lines))
    _add(f"q_{prefix}strip_headers", _cleaned_sql(view) + " SELECT doc_id, page_number, text FROM clean")(of(lambda df: pages.cleaned(df).select("doc_id", "page_number", "text")))
    _add(f"q_{prefix}title", f"SELECT doc_id, coalesce(left(arg_min(ls[1], page_number) FILTER (len(ls) > 0), 120), 'Translated Document') AS title FROM {_nonblank(view)} GROUP BY doc_id")(of(pages.titles))
    _add(f"q_{prefix}units", _units_sql(view) + " SELECT * FROM units")(of(lambda df: pages.units(pages.cleaned(df))))
    _add(f"q_{prefix}sections", _sections_sql(view) + " SELECT * FROM sections")(of(lambda df: pages.sections(pages.cleaned(df))))
    _add(f"q_{prefix}page_count", f"SELECT doc_id, count(*) AS n_pages FROM {views.sql(view)} GROUP BY doc_id")(of(lambda df: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))))


def _as_pages(spark, sf_dir):
    return views.frame(spark, sf_dir, "conv_pages")


def _cleaned_sql(view: str) -> str:
    rstrip = DUCK.map(T.lines(DUCK, "norm"), "e", DUCK.sub("e", f"[{T.WS}]+$", ""))
    return f"""
WITH rep AS ({_repeated_sql(view)}),
sets AS (SELECT doc_id, coalesce(list(key) FILTER (side = 'top'), []) AS top, coalesce(list(key) FILTER (side = 'bottom'), []) AS bottom FROM rep GROUP BY doc_id),
p AS (SELECT v.doc_id, page_number, {T.normalized(DUCK, 'text')} AS norm, coalesce(top, []) AS top, coalesce(bottom, []) AS bottom FROM {views.sql(view)} v LEFT JOIN sets USING (doc_id)),
l AS (SELECT *, {rstrip} AS ls FROM p),
w AS (SELECT *, {arrays.without_repeats(DUCK, 'ls', 'top', 'bottom')} AS kept FROM l),
clean AS (SELECT doc_id, page_number, {T.strip(DUCK, f"array_to_string({arrays.joined_lines(DUCK, 'kept')}, chr(10))")} AS text FROM w)"""


def _units_sql(view: str) -> str:
    matter = DUCK.map("us", "u", f"u.type = 'bullet' OR NOT {T.front_matter(DUCK, 'u.text')}")
    return (
        _cleaned_sql(view)
        + f""",
u0 AS (SELECT doc_id, page_number, {arrays.units(DUCK, 'text')} AS us, min(page_number) OVER (PARTITION BY doc_id) AS first FROM clean),
u1 AS (SELECT doc_id, page_number, CASE WHEN page_number > first THEN us WHEN list_position({matter}, true) IS NULL THEN [] ELSE us[list_position({matter}, true):] END AS us FROM u0 WHERE len(us) > 0),
units AS (SELECT doc_id, page_number, CAST(i AS INTEGER) AS unit_no, us[i + 1].type AS type, us[i + 1].text AS text FROM (SELECT *, unnest(range(len(us))) AS i FROM u1))"""
    )


def _sections_sql(view: str) -> str:
    return (
        _units_sql(view)
        + f""",
raws AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, unit_no) AS raw FROM units),
g AS (SELECT doc_id, raw, max(text) FILTER (type = 'heading') AS heading, list_sort(list(DISTINCT page_number)) AS page_numbers, count(*) FILTER (type <> 'heading') AS n_paragraphs FROM raws GROUP BY doc_id, raw),
real AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS BIGINT) AS section_index, coalesce(heading, '正文') AS heading, CASE WHEN heading IS NULL THEN 1 ELSE {T.heading_level(DUCK, 'heading')} END AS level, page_numbers, n_paragraphs FROM g WHERE n_paragraphs > 0),
sections AS (SELECT * FROM real UNION ALL SELECT DISTINCT doc_id, CAST(0 AS BIGINT), '正文', CAST(1 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM clean WHERE doc_id NOT IN (SELECT doc_id FROM real))"""
    )


for _prefix, _view in PAGE_VIEWS.items():
    _page_queries(_prefix, _view)


_SECTIONS = _sections_sql("conv_pages")


@_add(
    "q_image_section",
    _SECTIONS
    + """,
img AS (SELECT doc_id, page_number, concat('p', CAST(page_number AS VARCHAR), '_img1') AS image_id FROM clean),
own AS (SELECT doc_id, page_number, min(section_index) AS s FROM (SELECT doc_id, section_index, unnest(page_numbers) AS page_number FROM sections) GROUP BY ALL),
last AS (SELECT doc_id, max(section_index) AS l FROM sections GROUP BY doc_id)
SELECT doc_id, page_number, image_id, coalesce(s, l) AS section_index FROM img LEFT JOIN own USING (doc_id, page_number) LEFT JOIN last USING (doc_id)""",
)
def _images(spark, sf_dir):
    clean = pages.cleaned(_as_pages(spark, sf_dir))
    own = clean.select("doc_id", "page_number", F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("_img1")).alias("image_id"))
    return pages.image_sections(own, pages.sections(clean))


# The document model: paragraphs, headings and titles; its spans are Python's and have tests of their own.
_TEXTS = (
    _SECTIONS
    + """,
raw_of AS (SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS section_index FROM g WHERE n_paragraphs > 0),
paragraphs AS (SELECT doc_id, section_index, row_number() OVER (PARTITION BY doc_id, section_index ORDER BY page_number, unit_no) - 1 AS paragraph_index, CASE WHEN type = 'bullet' THEN concat('• ', text) ELSE text END AS text FROM raws JOIN raw_of USING (doc_id, raw) WHERE type <> 'heading')"""
)


def _found(spark, sf_dir):
    clean = pages.cleaned(_as_pages(spark, sf_dir))
    return clean, shared.materialize(pages.paragraphs(shared.materialize(pages.units(clean), "units")[0]), "paragraphs")[0]


@_add("q_paragraphs", _TEXTS + " SELECT doc_id, section_index, paragraph_index, text FROM paragraphs")
def _paragraphs(spark, sf_dir):
    _, found = _found(spark, sf_dir)
    return documents.paragraphs(found, pages.outline(found))


@_add("q_model_titles", _SECTIONS + " SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Given' ELSE arg_min(heading, section_index) END AS title FROM sections GROUP BY doc_id")
def _model_titles(spark, sf_dir):
    clean, found = _found(spark, sf_dir)
    given = clean.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 3 == 0, "Given").when(F.col("doc_id") % 3 == 1, "").alias("title"))
    return documents.titles(pages.with_default(pages.outline(found).drop("raw"), clean), given)


@_add("q_model_headings", _SECTIONS + f" SELECT doc_id, section_index, CASE WHEN {M.worth_translating(DUCK, 'heading')} THEN concat('[ZH] ', heading) ELSE heading END AS heading FROM sections")
def _model_headings(spark, sf_dir):
    return documents.translated(documents.model(pages.cleaned(_as_pages(spark, sf_dir)))).sections.select("doc_id", "section_index", "heading")


@_add("q_model_texts")
def _model_texts(spark, sf_dir):
    """Paragraphs of translated documents; spans to translate are marked."""
    return documents.paragraph_texts(documents.translated(documents.model(pages.cleaned(_as_pages(spark, sf_dir)))).spans)


def _doc_pages(spark, sf_dir):
    return shared.spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.lit(1).cast("long").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


_DOC_LENGTH = f"length({T.strip(DUCK, chr(34) + 'text' + chr(34))})"


@_add("q_low_text", f"SELECT doc_id, text FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE {_DOC_LENGTH} < 50")
def _low(spark, sf_dir):
    return pages.low_text(_doc_pages(spark, sf_dir)).select("doc_id", "text")


_OCR = "CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE concat(' OCR of ', CAST(doc_id AS {s}), chr(10)) END"


@_add(
    "q_ocr_merge",
    f"""SELECT doc_id, text, length({T.strip(DUCK, 'text')}) AS text_len, used_ocr FROM (
SELECT doc_id, used_ocr, CASE WHEN used_ocr THEN concat('OCR of ', CAST(doc_id AS VARCHAR)) ELSE t END AS text FROM (
SELECT doc_id, coalesce(text, '') AS t, length({T.strip(DUCK, "coalesce(text, '')")}) < 50 AND doc_id % 3 <> 0 AS used_ocr FROM documents))""",
)
def _ocr(spark, sf_dir):
    own = _doc_pages(spark, sf_dir)
    read = pages.low_text(own).select("doc_id", "page_number", F.expr(_OCR.format(s="STRING")).alias("ocr_text"))
    return pages.with_ocr(own, read).select("doc_id", "text", "text_len", "used_ocr")


# Markdown.
_CHUNKS = f"(SELECT doc_id, {arrays.chunks(DUCK, 'blocks', CAP)} AS chunks FROM (SELECT doc_id, {arrays.blocks(DUCK, 'text')} AS blocks FROM {views.sql('md_docs')}))"
_CHUNK_ROWS = f"(SELECT doc_id, i AS chunk_index, chunks[i + 1] AS text FROM (SELECT *, unnest(range(len(chunks))) AS i FROM {_CHUNKS}))"


@_add("q_chunks", f"SELECT doc_id, chunk_index, text FROM {_CHUNK_ROWS}")
def _chunks(spark, sf_dir):
    return markdown.chunks(views.frame(spark, sf_dir, "md_docs"), CAP)


@_add("q_chunk_stats", f"SELECT doc_id, count(*) AS n_chunks, max(length(text)) AS longest, sum(CASE WHEN length(text) > {CAP} THEN 1 ELSE 0 END)::BIGINT AS n_over FROM {_CHUNK_ROWS} GROUP BY doc_id")
def _chunk_stats(spark, sf_dir):
    own = markdown.with_chunks(views.frame(spark, sf_dir, "md_docs"), CAP)
    size = F.transform("chunks", lambda c: F.length(c).cast("long"))
    return own.select("doc_id", F.size("chunks").cast("long").alias("n_chunks"), F.array_max(size).alias("longest"), F.size(F.filter(size, lambda n: n > CAP)).cast("long").alias("n_over"))


_PROTECTED = protect.protected_sql(f"SELECT doc_id, chunk_index, text FROM {_CHUNK_ROWS}", "text")


@_add("q_protect", f"SELECT doc_id, chunk_index, protected, {DUCK.map('fragments', 'f', 'f.token')} AS tokens, {DUCK.map('fragments', 'f', 'f.value')} AS parts FROM ({_PROTECTED})")
def _protect(spark, sf_dir):
    own = protect.protected(markdown.chunks(views.frame(spark, sf_dir, "md_docs"), CAP), "text")
    return own.select("doc_id", "chunk_index", "protected", F.expr("fragments.token AS tokens"), F.expr("fragments.value AS parts"))


@_add("q_restore", f"SELECT doc_id, chunk_index, {protect.intact(DUCK, 'protected', 'fragments')} AS intact, {protect.restored(DUCK, 'protected', 'fragments')} AS restored FROM ({_PROTECTED})")
def _restore(spark, sf_dir):
    own = protect.protected(markdown.chunks(views.frame(spark, sf_dir, "md_docs"), CAP), "text")
    return own.select("doc_id", "chunk_index", F.expr(protect.intact(SPARK, "protected", "fragments")).alias("intact"), F.expr(protect.restored(SPARK, "protected", "fragments")).alias("restored"))


def _translate_sql(mapped: str) -> str:
    ready = protect.protected_sql(f"SELECT doc_id, chunk_index, text, {T.normalized(DUCK, 'text')} AS norm FROM {_CHUNK_ROWS}", "norm")
    return f"""WITH a AS (SELECT doc_id, chunk_index, text, fragments, {mapped} AS said FROM ({ready})),
b AS (SELECT *, {T.normalized(DUCK, 'said')} AS answer FROM a),
c AS (SELECT doc_id, chunk_index, {protect.intact(DUCK, 'answer', 'fragments')} AS intact, CASE WHEN {protect.intact(DUCK, 'answer', 'fragments')} THEN {protect.restored(DUCK, 'answer', 'fragments')} ELSE text END AS translated FROM b)"""


@_add("q_translate_md", _translate_sql("concat('[ZH] ', protected)") + " SELECT doc_id, count(*) AS n_chunks, coalesce(string_agg(translated, chr(10) || chr(10) ORDER BY chunk_index) FILTER (translated <> ''), '') AS text FROM c GROUP BY doc_id")
def _translate_md(spark, sf_dir):
    return markdown.translated(views.frame(spark, sf_dir, "md_docs"), most=CAP).drop("error")


@_add("q_translate_fallback", _translate_sql("CASE WHEN doc_id % 3 = 0 THEN replace(protected, 'URL', 'url') ELSE protected END") + " SELECT doc_id, chunk_index, intact, translated FROM c")
def _fallback(spark, sf_dir):
    lossy = lambda x: F.when(F.col("doc_id") % 3 == 0, F.replace(x, F.lit("URL"), F.lit("url"))).otherwise(x)
    return markdown.translated_chunks(markdown.chunks(views.frame(spark, sf_dir, "md_docs"), CAP), lossy).select("doc_id", "chunk_index", "intact", "translated")


_FILES = [f"img/p{k}.png" for k in range(5)]


@_add("q_assets", f"SELECT doc_id, regexp_replace(text, '(!\\[[^\\]]*\\]\\()img/(p[0-4]\\.png\\))', '\\1assets/\\2', 'g') AS text FROM {views.sql('md_docs')}")
def _assets(spark, sf_dir):
    return markdown.localized(views.frame(spark, sf_dir, "md_docs"), _FILES).select("doc_id", "text")


_DOC_CHUNKS = _CHUNKS.replace(views.sql("md_docs"), "(SELECT doc_id, coalesce(text, '') AS text FROM documents)")


@_add("q_stream_chunks", f"SELECT doc_id, i AS chunk_index, chunks[i + 1] AS text FROM (SELECT *, unnest(range(len(chunks))) AS i FROM {_DOC_CHUNKS})")
def _stream(spark, sf_dir):
    """The chunks of ``documents``, read as a stream of files."""
    folder = shared.scratch(spark, "chunk-stream")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    stream.chunk_stream(spark, source.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), f"{folder}/out", f"{folder}/checkpoint", CAP)
    return spark.read.schema("doc_id long, chunk_index long, text string").parquet(f"{folder}/out")


# Formulas and spans.
def _math(spark, sf_dir):
    return views.frame(spark, sf_dir, "math_docs").select("doc_id", "text")


@_add("q_math_spans")
def _formulas(spark, sf_dir):
    return spans.with_formulas(_math(spark, sf_dir)).select("doc_id", "formulas")


@_add("q_math_restore", f"SELECT doc_id, text AS restored, CAST([] AS VARCHAR[]) AS missing, CAST([] AS VARCHAR[]) AS unexpected FROM {views.sql('math_docs')}")
def _math_restore(spark, sf_dir):
    """What is put behind tokens comes back whole."""
    return spans.restored(spans.protected(_math(spark, sf_dir)), "protected").select("doc_id", "restored", "missing", "unexpected")


# Read off the samples by hand: (sample, formulas as start, end, kind), and (sample, spans; those passed through in brackets).
_FORMULAS = {
    0: ((5, 24, "sum_product"),),
    1: ((8, 23, "set_builder"), (40, 61, "set_builder")),
    2: ((4, 17, "set_literal"),),
    3: ((8, 17, "union_intersection"),),
}
_SPANS = {
    0: ("Then ", "[∑n i=1 i2]", " = 6 holds, where ", "[n2 + n]", " is even."),
    1: ("The set {x ∈ Z ", "[| x > 0} is infinite ]", "and", "[ {a b |]", " a, b integers} is not."),  # bars are cut first
    2: ("Let ", "[S = {1, 2, 3}]", " be given with ", "[n = k + 1]", " in a ", "non-zero", " case."),
    3: ("We know ", "[A ∩ B = ∅]", " and x ∈ A or y ∉ B."),
    4: ("[α + β = γ]",),
    5: ("symbol = denoted", " by x ≤ y"),
}


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows) + ")"


_FORMULA_ROWS = _values([(k, i, a, z, kind) for k, found in _FORMULAS.items() for i, (a, z, kind) in enumerate(found)])
_SPAN_ROWS = _values([(k, i, t[1:-1] if t[0] == "[" and t[-1] == "]" else t, t[0] != "[") for k, found in _SPANS.items() for i, t in enumerate(found)])


def _samples(spark, sf_dir):
    return views.frame(spark, sf_dir, "math_docs").select("doc_id", F.col("formula").alias("text"))


@_add("q_formula_kinds", f"SELECT doc_id, CAST(v.a AS INTEGER) AS start, CAST(v.z AS INTEGER) AS \"end\", kind FROM {views.sql('math_docs')} d JOIN {_FORMULA_ROWS} v(k, i, a, z, kind) ON d.doc_id % 6 = v.k")
def _formula_kinds(spark, sf_dir):
    return spans.with_formulas(_samples(spark, sf_dir)).select("doc_id", F.explode("formulas").alias("f")).select("doc_id", "f.start", "f.end", "f.kind")


@_add("q_formula_spans", f"SELECT doc_id, CAST(v.i AS BIGINT) AS span_index, v.t AS text, v.ok AS translatable FROM {views.sql('math_docs')} d JOIN {_SPAN_ROWS} v(k, i, t, ok) ON d.doc_id % 6 = v.k")
def _formula_spans(spark, sf_dir):
    return spans.span_rows(spans.with_spans(_samples(spark, sf_dir)))


_FORMULA_TRANSLATED = f"""SELECT doc_id, string_agg(CASE WHEN v.ok AND trim(v.t) <> '' THEN concat(regexp_extract(v.t, '^ *'), '[ZH] ', v.t) ELSE v.t END, '' ORDER BY v.i) AS text
FROM {views.sql('math_docs')} d JOIN {_SPAN_ROWS} v(k, i, t, ok) ON d.doc_id % 6 = v.k GROUP BY doc_id"""


@_add("q_formula_translated", _FORMULA_TRANSLATED)
def _formula_translated(spark, sf_dir):
    return translate.documents(spans.span_rows(spans.with_spans(_samples(spark, sf_dir))))


@_add("q_formula_counts", f"SELECT doc_id, count(*) FILTER (v.ok) AS n_translatable, count(*) FILTER (NOT v.ok) AS n_passthrough FROM {views.sql('math_docs')} d JOIN {_SPAN_ROWS} v(k, i, t, ok) ON d.doc_id % 6 = v.k GROUP BY doc_id")
def _formula_counts(spark, sf_dir):
    return documents.span_counts(spans.span_rows(spans.with_spans(_samples(spark, sf_dir))))


def _losing(lost):
    """A translator that loses tokens where ``lost``, unless it is asked for them again."""
    asked_again = F.lit(translate.RECOVERY)
    return lambda x: F.when(lost & ~F.startswith(x, asked_again), F.regexp_replace(x, r"\[\[MATH_\d+\]\]", "")).otherwise(F.replace(x, asked_again, F.lit("")))


@_add("q_formula_recovery", f"SELECT doc_id, formula AS translated, CASE WHEN doc_id % 6 IN (0, 3) THEN 'recovered' ELSE 'kept' END AS outcome FROM {views.sql('math_docs')}")
def _formula_recovery(spark, sf_dir):
    return translate.keeping_formulas(_samples(spark, sf_dir), _losing(F.col("doc_id") % 3 == 0)).select("doc_id", "translated", "outcome")


@_add("q_math_stable")
def _stable(spark, sf_dir):
    return spans.stable_layout(_math(spark, sf_dir)).select("doc_id", "stable")


@_add("q_spans")
def _spans(spark, sf_dir):
    return spans.span_rows(spans.with_spans(_math(spark, sf_dir)))


@_add("q_span_counts")
def _span_counts(spark, sf_dir):
    own = spans.with_spans(_math(spark, sf_dir))
    return own.select("doc_id", F.size(F.filter("spans", lambda s: s["translatable"])).alias("n_translatable"), F.size(F.filter("spans", lambda s: ~s["translatable"])).alias("n_passthrough"), F.aggregate("spans", F.lit(0), lambda a, s: a + F.regexp_count(s["text"], F.lit(T.CONTROL))).alias("n_control"))


@_add("q_translate_spans")
def _translate_spans(spark, sf_dir):
    return translate.documents(spans.span_rows(spans.with_spans(_math(spark, sf_dir))))


@_add("q_placeholder_recovery")
def _recovery(spark, sf_dir):
    return translate.keeping_formulas(_math(spark, sf_dir), _losing(F.col("doc_id") % 3 == 0)).select("doc_id", "translated", "outcome")


@_add("q_quality_rounds")
def _rounds(spark, sf_dir):
    shorter = lambda x: F.concat(F.lit("译文"), F.regexp_replace(x, r"(?s)^.*\n\n|[a-z]{2,}", ""))
    return translate.improved(views.frame(spark, sf_dir, "translations"), shorter, shorter).select("doc_id", "translated")


# Cache.
_MODEL, _PRINT = "model-a", "0123456789abcdef"
_KEYED = f"(SELECT doc_id, coalesce(text, '') AS text, {T.cache_key(DUCK, f'{chr(39)}{_MODEL}{chr(39)}', f'{chr(39)}{_PRINT}{chr(39)}', 'coalesce(text, ' + chr(39) * 2 + ')')} AS key FROM documents)"
_CACHE = f"(SELECT key, min(CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('[ZH] ', text) END) AS value FROM {_KEYED} WHERE doc_id % 2 = 0 GROUP BY key)"


def _keyed(spark, sf_dir):
    docs = shared.spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = translate.with_keys(docs, _MODEL, _PRINT)
    cache = own.where("doc_id % 2 = 0").groupBy("key").agg(F.min(F.when(F.col("doc_id") % 4 == 0, "").otherwise(markdown.fake(F.col("text")))).alias("value"))
    return own, cache


@_add("q_cache_hits", f"SELECT doc_id, k.key, value, value IS NOT NULL AS hit FROM {_KEYED} k LEFT JOIN {_CACHE} c ON k.key = c.key")
def _hits(spark, sf_dir):
    own, cache = _keyed(spark, sf_dir)
    return translate.cached(own, cache).select("doc_id", "key", "value", "hit")


@_add("q_cache_misses", f"SELECT key, min(text) AS text FROM {_KEYED} WHERE key NOT IN (SELECT key FROM {_CACHE}) GROUP BY key")
def _misses(spark, sf_dir):
    return translate.misses(*_keyed(spark, sf_dir))


@_add("q_cache_fill", f"SELECT key, value FROM {_CACHE} UNION ALL SELECT key, concat('[ZH] ', min(text)) FROM {_KEYED} WHERE key NOT IN (SELECT key FROM {_CACHE}) GROUP BY key")
def _fill(spark, sf_dir):
    return translate.fill_cache(*_keyed(spark, sf_dir), markdown.fake)


# Settings and jobs.
_KEYS = ["VELLUMIX_LLM_MODEL", "VELLUMIX_WEB_PORT", "VELLUMIX_JOBS_DIR"]


@_add(
    "q_env_duplicates",
    f"""SELECT file, key, list_sort(list(line_no)) AS line_nos FROM (SELECT file, line_no, trim(split_part(e, '=', 1)) AS key FROM (SELECT file, line_no, regexp_replace(trim(line), '^export ', '') AS e FROM {views.sql('env_lines')}) WHERE NOT starts_with(trim(e), '#') AND contains(e, '='))
WHERE key IN ({', '.join(f"'{k}'" for k in _KEYS)}) GROUP BY ALL HAVING count(*) > 1""",
)
def _env(spark, sf_dir):
    return settings.duplicate_keys(views.frame(spark, sf_dir, "env_lines"), _KEYS)


@_add(
    "q_exit_codes",
    f"""SELECT event_id, kind, CASE kind WHEN 'ConfigError' THEN 2 WHEN 'DownloadError' THEN 3 WHEN 'ExtractError' THEN 4 WHEN 'OCRError' THEN 4 WHEN 'ConverterError' THEN 4
WHEN 'TranslateError' THEN 5 WHEN 'RenderError' THEN 6 WHEN 'JobError' THEN 7 ELSE 1 END AS exit_code FROM {views.sql('failures')}""",
)
def _codes(spark, sf_dir):
    return jobs.with_exit_codes(views.frame(spark, sf_dir, "failures"))


@_add(
    "q_job_state",
    f"""SELECT job_id, arg_max(status, seq) AS status, arg_max(stage, seq) FILTER (stage IS NOT NULL) AS stage, (arg_max({{'e': error}}, seq) FILTER (sets_error)).e AS error, count(*) AS n_events
FROM {views.sql('job_events')} GROUP BY job_id""",
)
def _state(spark, sf_dir):
    return jobs.latest(views.frame(spark, sf_dir, "job_events"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: Markdown documents chunked, protected, translated and put together."""
    out = markdown.translated(views.frame(spark, sf_dir, "md_docs"))
    return out.select("doc_id", "n_chunks", F.length("text").cast("long").alias("translated_chars"))


_add("flagship", _translate_sql("concat('[ZH] ', protected)").replace(f"> {CAP})", f"> {markdown.CHUNK_CHARS})") + " SELECT doc_id, count(*) AS n_chunks, CAST(length(coalesce(string_agg(translated, chr(10) || chr(10) ORDER BY chunk_index) FILTER (translated <> ''), '')) AS BIGINT) AS translated_chars FROM c GROUP BY doc_id")(entry)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
