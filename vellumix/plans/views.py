"""Tables that bring the documents' rules to bear, derived from the input tables by expressions.

Each view is SQL text over the input tables in either dialect; ``frame`` makes it a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumix import shared
from vellumix.functions.dialect import DUCK, SPARK, Dialect


def table(d: Dialect, sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir}/{name}.parquet`" if d is SPARK else name


def _lines(d: Dialect, cases: list[str]) -> str:
    body = "CASE " + " ".join(f"WHEN i % {len(cases) + 1} = {k} THEN {c}" for k, c in enumerate(cases)) + " ELSE l END"
    return d.join(d.imap(d.split("coalesce(text, '')", "\n"), "l", "i", body), "chr(10)")


def md_docs(d: Dialect, sf_dir: str = "") -> str:
    text = "STRING" if d is SPARK else "VARCHAR"
    cases = [
        "concat('# ', l)",
        "concat('- ', l)",
        "concat(l, chr(10))",
        "concat('```', chr(10), l, chr(10), chr(10), '```')",
        "concat('| ', l, ' |')",
        f"concat('![fig](img/p', CAST(doc_id % 7 AS {text}), '.png) see [t](https://e.x/p?q=1) and `c d` ', l)",
        "concat('cost $x$ of $$y + z$$ at http://e.x/a and `[u](v)` ', l)",
        "concat('1. ', l)",
    ]
    return f"SELECT doc_id, {_lines(d, cases)} AS text FROM {table(d, sf_dir, 'documents')}"


MATH_SAMPLES = (
    "Then ∑n i=1 i2 = 6 holds, where n2 + n is even.",
    "The set {x ∈ Z | x > 0} is infinite and {a b | a, b integers} is not.",
    "Let S = {1, 2, 3} be given with n = k + 1 in a non-zero case.",
    "We know A ∩ B = ∅ and x ∈ A or y ∉ B.",
    "α + β = γ",
    "symbol = denoted by x ≤ y",
)


def math_docs(d: Dialect, sf_dir: str = "") -> str:
    sample = "CASE " + " ".join(f"WHEN doc_id % {len(MATH_SAMPLES)} = {k} THEN '{s}'" for k, s in enumerate(MATH_SAMPLES)) + " END"
    return f"SELECT doc_id, concat({sample}, ' ', replace(coalesce(text, ''), chr(10), ' ')) AS text, {sample} AS formula FROM {table(d, sf_dir, 'documents')}"


DIRTY_SAMPLES = (
    "\x07bell \uf8f1a\uf8f2b\uf8f3 \ue000end",
    "x /∈ A and \u0338= y, a/∈b",
    "A ∩ /0 and B \\ /0 /0 with 1/0",
    "path /0 is far from it",
    "/ 0 stands in the empty set",
    "\x7f\uf8f4 plain",
)


def dirty_docs(d: Dialect, sf_dir: str = "") -> str:
    sample = "CASE " + " ".join(f"WHEN doc_id % {len(DIRTY_SAMPLES)} = {k} THEN {d.lit(s)}" for k, s in enumerate(DIRTY_SAMPLES)) + " END"
    return f"SELECT doc_id, concat(coalesce(text, ''), ' ', {sample}) AS text FROM {table(d, sf_dir, 'documents')}"


def conv_pages(d: Dialect, sf_dir: str = "") -> str:
    """Conversations as documents whose turns are pages, with headers, footers, headings, bullets and broken formulas."""
    text = "STRING" if d is SPARK else "VARCHAR"
    t = "coalesce(text, '')"
    body = (
        f"CASE turn % 4 WHEN 0 THEN concat(CAST(turn + 1 AS {text}), ' Section Title', chr(10), {t}) "
        f"WHEN 1 THEN concat('• first item • second', chr(10), 'and more of it', chr(10), {t}, chr(10), '2. third item', chr(10), chr(10), 'which goes on', chr(10), 'A New Part of It', chr(10), 'Text here.') "
        f"WHEN 2 THEN concat('We sum ∑n', chr(10), 'i = 1 over all', chr(10), 'x ∈', chr(10), 'A here', chr(10), {t}) ELSE concat({t}, chr(10), 'METHODS AND TOOLS') END"
    )
    return f"SELECT conv_id AS doc_id, CAST(turn + 1 AS BIGINT) AS page_number, concat('Spring 2024', chr(10), 'Lecture  ', CAST(conv_id % 5 AS {text}), chr(10), {body}, chr(10), 'Page ', CAST(turn + 1 AS {text}), ' of 9') AS text FROM {table(d, sf_dir, 'conversations')}"


def doc_pages(d: Dialect, sf_dir: str = "") -> str:
    """Documents as the pages of their sources: few books of very many pages, one of which holds a large share."""
    return f"SELECT coalesce(source, '') AS doc_id, doc_id AS page_number, coalesce(text, '') AS text FROM {table(d, sf_dir, 'documents')}"


def urls(d: Dialect, sf_dir: str = "") -> str:
    cases = ("url", "concat(url, '.pdf')", "concat(url, '/My%20Paper.v2.PDF?x=1#y')", "concat(url, '/a+b%ZZ.pdf')", "concat(url, '.pdf/')", "'https://e.x'", "'ftp://e.x/file.pdf'", "''")
    case = "CASE " + " ".join(f"WHEN page_id % {len(cases)} = {k} THEN {c}" for k, c in enumerate(cases)) + " END"
    return f"SELECT page_id AS id, {case} AS url FROM {table(d, sf_dir, 'pages')}"


def payloads(d: Dialect, sf_dir: str = "") -> str:
    html = "coalesce(html, '')"
    body = f"CASE page_id % 4 WHEN 0 THEN concat('%PDF-1.7', chr(10), {html}) WHEN 1 THEN concat('  ', chr(10), {html}) WHEN 2 THEN 'just text' ELSE {html} END"
    kind = "CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' ELSE NULL END"
    return f"SELECT page_id AS id, {kind} AS content_type, {body} AS payload FROM {table(d, sf_dir, 'pages')}"


def translations(d: Dialect, sf_dir: str = "") -> str:
    """Sources with translations of different quality."""
    source = "replace(coalesce(text, ''), chr(10), ' ')"
    cases = (f"concat('[ZH] ', {source})", "'这是一个很好的翻译结果，没有问题'", f"concat('翻译 with some English NASA ', {source})", "''", "'  译文  '", "'译文 NASA'")
    case = "CASE " + " ".join(f"WHEN doc_id % {len(cases)} = {k} THEN {c}" for k, c in enumerate(cases)) + " END"
    return f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('  ', {source}, ' ') WHEN doc_id % 5 = 1 THEN 'x = y + 1' WHEN doc_id % 5 = 2 THEN ', so it is!' ELSE {source} END AS source, {case} AS translated FROM {table(d, sf_dir, 'documents')}"


def job_events(d: Dialect, sf_dir: str = "") -> str:
    """The event table read as changes of jobs' states."""
    text = "STRING" if d is SPARK else "VARCHAR"
    return (
        f"SELECT CAST(user_id AS {text}) AS job_id, event_id AS seq, "
        "CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status, "
        "CASE event_id % 5 WHEN 0 THEN 'input' WHEN 1 THEN 'marker' WHEN 2 THEN 'translate' ELSE NULL END AS stage, "
        f"CASE WHEN event_id % 4 = 3 THEN event_type END AS error, event_id % 4 IN (2, 3) AS sets_error FROM {table(d, sf_dir, 'events')}"
    )


ENV_LINES = ("VELLUMIX_LLM_MODEL=a", "# VELLUMIX_LLM_MODEL=b", "export VELLUMIX_LLM_MODEL=c", "OTHER=1", " VELLUMIX_WEB_PORT = 1", "no entry", "VELLUMIX_JOBS_DIR=x")


def env_lines(d: Dialect, sf_dir: str = "") -> str:
    """The customers read as lines of settings files."""
    text = "STRING" if d is SPARK else "VARCHAR"
    line = "CASE " + " ".join(f"WHEN c_custkey * 7 % 11 = {k} THEN '{x}'" for k, x in enumerate(ENV_LINES)) + " ELSE '' END"
    return f"SELECT concat('file', CAST(c_custkey % 13 AS {text})) AS file, CAST(c_custkey AS INT) AS line_no, {line} AS line FROM {table(d, sf_dir, 'customer')}"


def failures(d: Dialect, sf_dir: str = "") -> str:
    """The events read as errors of different kinds."""
    kinds = ("ConfigError", "DownloadError", "ExtractError", "OCRError", "ConverterError", "TranslateError", "RenderError", "JobError", "PipelineError", "ValueError")
    kind = "CASE " + " ".join(f"WHEN event_id % {len(kinds)} = {k} THEN '{x}'" for k, x in enumerate(kinds)) + " END"
    return f"SELECT event_id, {kind} AS kind FROM {table(d, sf_dir, 'events')}"


VIEWS = {f.__name__: f for f in (md_docs, math_docs, dirty_docs, conv_pages, urls, payloads, translations, job_events, doc_pages, env_lines, failures)}


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return shared.spread(spark.sql(VIEWS[view](SPARK, sf_dir)))


def sql(view: str) -> str:
    """The view for DuckDB, in parentheses."""
    return f"({VIEWS[view](DUCK)})"
