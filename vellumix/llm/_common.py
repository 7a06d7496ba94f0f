"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumix.shared import apart, discard, fenced, materialize, scratch, ship, spread

__all__ = ["KEPT", "apart", "discard", "fenced", "materialize", "only", "read", "scratch", "ship", "slices", "text_bytes", "with_text", "without_text"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables, on all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def only(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a condition on computed columns, which are computed once.

    Without the column between, the optimizer moves the condition under the projections and
    computes them there again, one inside the other.
    """
    return fenced(df).where(condition)


def text_bytes(column: str = "text") -> F.Column:
    """The UTF-8 bytes of a text column; null gives no bytes."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def without_text(df: DataFrame, text: str) -> Column:
    """The columns of ``df`` but its text as a struct ``row``, so that none of them clashes with an operator's own."""
    return F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row")


def with_text(df: DataFrame, text: str, changed: Column) -> list[Column]:
    """The columns of ``df`` again from ``row`` and ``text``; ``n_chars`` follows a changed text."""
    own = []
    for c in df.columns:
        old = F.col("text") if c == text else F.col(f"row.`{c}`")
        if c == "n_chars" != text:
            old = F.when(changed, F.length("text").cast(df.schema[c].dataType)).otherwise(old)
        own.append(old.alias(c))
    return own


#: What an operator keeps in a worker from task to task.
KEPT: dict = {}


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``most`` bytes in each (one row at least).

    What another operator has kept in this worker is let go, unless ``keep``. At a task's end, what
    allocators hold unused goes back to the system: workers wait for the next task beside the JVM.
    """
    if not keep:
        KEPT.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()])
        group = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
    release()


def release() -> None:
    """Give unused memory back to the system, where its library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
