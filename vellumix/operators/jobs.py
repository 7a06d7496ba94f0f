"""Job state as a log of events, and the latest state of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumix.errors import EXIT_CODES, JobError
from vellumix.sources import files

STATUSES = ("queued", "running", "succeeded", "failed")
STAGES = ("queued", "starting", "downloading", "input", "marker", "translate", "done")


MANIFEST = "job_id string, status string, stage string, error string, input_pdf string, marker_markdown string, translated_markdown string, output_markdown string, submitted_at string, source_url string"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Job manifests (one JSON object a file) under a folder; keys that a file lacks are null."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)


def manifests_of(asked: DataFrame, manifests: DataFrame, required: bool = False) -> DataFrame:
    """The manifests of the jobs asked for (job_id): nulls for a job without one, or a JobError if they are ``required``."""
    own = asked.select("job_id").distinct().join(manifests, "job_id", "left_anti").first() if required else None
    if own is not None:
        raise JobError(f"no manifest of job {own.job_id}")
    return asked.select("job_id").join(manifests, "job_id", "left")


def write_manifests(jobs: DataFrame, path: str) -> None:
    """One JSON object for each job, in a folder of its own; an earlier one is replaced."""
    columns = [c for c in jobs.columns if c != "job_id"]
    files.export(jobs.select(F.concat("job_id", F.lit("/manifest.json")).alias("name"), F.to_json(F.struct("job_id", *columns)).alias("text")), path)


def with_ids(df: DataFrame, short: bool = False) -> DataFrame:
    """``df`` with a new ``job_id`` a row: 12 hexadecimal digits, or the time (UTC, to the second), a dash and 8 digits.

    New every time it is computed, so write the result before it is read twice.
    """
    digits = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMddHHmmss")
    return df.withColumn("job_id", F.left(digits, F.lit(12)) if short else F.concat(now, F.lit("-"), F.left(digits, F.lit(8))))


def with_folders(asked: DataFrame, known: DataFrame, root: str) -> DataFrame:
    """(job_id, folder) of the jobs asked for: the known folder, else the one that a job of that id has under ``root``."""
    usual = F.concat(F.lit(root.rstrip("/") + "/"), F.col("job_id"))
    return asked.select("job_id").join(known.select("job_id", F.col("folder").alias("_known")), "job_id", "left").select("job_id", F.coalesce("_known", usual).alias("folder"))


def latest(events: DataFrame) -> DataFrame:
    """(job_id, status, stage, error, n_events) from (job_id, seq, status, stage, error, sets_error).

    A null status or stage leaves the one before; a null error overwrites it where ``sets_error``.
    """
    last = lambda c, when: F.max(F.when(when, F.struct("seq", F.col(c).alias("v"))))["v"]
    return events.groupBy("job_id").agg(
        last("status", F.col("status").isNotNull()).alias("status"),
        last("stage", F.col("stage").isNotNull()).alias("stage"),
        last("error", F.col("sets_error")).alias("error"),
        F.count(F.lit(1)).alias("n_events"),
    )


def with_exit_codes(df: DataFrame, kind: str = "kind") -> DataFrame:
    """``df`` with the exit code of an error kind's name; 1 for others."""
    code = F.lit(1)
    for error, n in EXIT_CODES:
        code = F.when(F.col(kind) == error.__name__, n).otherwise(code)
    return df.withColumn("exit_code", code)


def results(state: DataFrame, documents: DataFrame) -> DataFrame:
    """The latest states with page and section counts of (job_id, page_count, section_count), null where a job has none."""
    return state.join(documents, "job_id", "left")
