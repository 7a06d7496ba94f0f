"""Whole jobs: PDF files or URLs through conversion and translation to Markdown, with a log of their states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumix import shared
from vellumix.functions import text as T
from vellumix.functions.dialect import SPARK
from vellumix.operators import jobs, markdown, translate
from vellumix.sources import files

EVENTS = "job_id string, seq long, status string, stage string, error string, sets_error boolean"


def _event(own: DataFrame, seq: int, status: str, stage: str, error: F.Column | None = None) -> DataFrame:
    ended = status in ("succeeded", "failed")
    return own.select("job_id", F.lit(seq).cast("long").alias("seq"), F.lit(status).alias("status"), F.lit(stage).alias("stage"), (F.lit(None) if error is None else error).cast("string").alias("error"), F.lit(ended).alias("sets_error"))


def _log(*events: DataFrame) -> DataFrame:
    log = events[0]
    for more in events[1:]:
        log = log.unionByName(more)
    return log


def translated_files(inputs: DataFrame, convert: Callable[[bytes], str], translator: translate.Translator, out: str, most: int = markdown.CHUNK_CHARS, mode: str = "conservative", cache: translate.Cache | None = None, copies: str | None = None) -> DataFrame:
    """Convert and translate files (path, content), write (name, text) for each under ``out``; returns the events of all jobs.

    Every file is a job of its own, under a new id unless there is a column ``job_id``. A file that fails
    to convert, or a text of which the translator fails (``translate.service`` with ``errors``), ends its
    own job only. With a ``cache``, answers are kept there and not asked for again; with ``copies``, files
    are copied to their jobs' folders there.
    """
    inputs = inputs if "job_id" in inputs.columns else jobs.with_ids(inputs)
    # Written at once: ids are new every time they are computed.
    named, _ = shared.materialize(inputs.select("job_id", "path", "content"), "inputs")
    if copies:
        files.copy_inputs(named, copies)
    texts = files.convert(named, convert, ["job_id"])
    done, _ = shared.materialize(texts.withColumn("name", F.concat_ws("/", "job_id", F.concat(F.expr(files.stem(SPARK, "path")), F.lit(".zh.md")))), "converted")
    good, unread = done.where("error IS NULL"), done.where("error IS NOT NULL")
    made, _ = shared.materialize(markdown.translated(good.select(F.col("job_id").alias("doc_id"), "text"), translator, most, mode, cache).withColumnRenamed("doc_id", "job_id"), "translated")
    whole, broken = made.where("error IS NULL"), made.where("error IS NOT NULL")
    files.write_texts(whole.join(done.select("job_id", "name"), "job_id").select("name", "text"), out)
    return _log(
        _event(done, 1, "running", "input"),
        _event(done, 2, "running", "marker"),
        _event(unread, 3, "failed", "marker", F.col("error")),
        _event(good, 3, "running", "translate"),
        _event(broken, 4, "failed", "translate", F.col("error")),
        _event(whole, 4, "succeeded", "done"),
    )


def translated_urls(urls: DataFrame, fetch: Callable[[str], tuple[str, bytes]], convert: Callable[[bytes], str], translator: translate.Translator, out: str, attempts: int = 3, pause_s: float = 0.6, **options) -> DataFrame:
    """As ``translated_files`` for (url); a URL that isn't accepted or can't be downloaded fails in its own stage."""
    asked = urls if "job_id" in urls.columns else jobs.with_ids(urls)
    checked, _ = shared.materialize(asked.select("job_id", "url", F.expr(T.url_error(SPARK, "url")).alias("refused")), "urls")
    got, _ = shared.materialize(files.download(checked.where("refused IS NULL"), fetch, attempts, pause_s, ["job_id"]), "downloads")
    bad = got.where("error IS NOT NULL").select("job_id", "error").unionByName(checked.where("refused IS NOT NULL").select("job_id", F.col("refused").alias("error")))
    log = translated_files(got.where("error IS NULL").select("job_id", F.col("base_name").alias("path"), F.col("payload").alias("content")), convert, translator, out, **options)
    return _log(log, _event(bad, 1, "running", "downloading"), _event(bad, 2, "failed", "downloading", F.col("error")))


def translated_markdown(spark: SparkSession, source: str, out: str, translator: translate.Translator, most: int = markdown.CHUNK_CHARS, mode: str = "conservative", cache: translate.Cache | None = None) -> DataFrame:
    """Every Markdown file under ``source`` (or that file) to one of its name with ``.zh.md`` under ``out``; (name, error), null where it's done."""
    docs = files.read_markdown(spark, source)
    # The path below the folder, so that files of one name don't meet.
    whole, root = F.regexp_replace("path", "^file:/+", "/"), source.removeprefix("file:").rstrip("/") + "/"
    below = F.when(F.contains(whole, F.lit(root)), F.substring_index(whole, root, -1)).otherwise(F.element_at(F.split("path", "/"), -1))
    named = docs.select(below.alias("below"), "text").select(F.expr(files.output_name(SPARK, "below")).alias("doc_id"), "text")
    made, _ = shared.materialize(markdown.translated(named, translator, most, mode, cache).withColumnRenamed("doc_id", "name"), "translated")
    files.export(made.where("error IS NULL").select("name", "text"), out)
    return made.select("name", "error")


def submitted(inputs: DataFrame) -> DataFrame:
    """The events of new jobs (with ``job_id``): queued."""
    return _event(inputs, 0, "queued", "queued")


def run_stream(spark, folder: str, convert: Callable[[bytes], str], translator: translate.Translator, out: str, log: str, checkpoint: str, forever: bool = False, **options) -> None:
    """Jobs for PDF files that arrive in ``folder``, one after another: results under ``out``, events appended to the table ``log``.

    Ends when all that is there is done, unless ``forever``.
    """
    from vellumix.streaming import chunks

    def handle(batch: DataFrame, number: int) -> None:
        own, _ = shared.materialize(jobs.with_ids(batch, short=True), "submitted")
        submitted(own).write.mode("append").parquet(log)
        translated_files(own, convert, translator, f"{out}/batch-{number}", **options).write.mode("append").parquet(log)

    chunks.job_stream(spark, folder, handle, checkpoint, forever=forever)


def summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, section_count) of Markdown documents."""
    return docs.select("doc_id", T.column(T.markdown_sections, "text").alias("section_count"))
