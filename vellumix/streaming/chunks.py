"""Documents that arrive as files, chunked as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vellumix.operators import markdown


def chunk_stream(spark: SparkSession, source: DataFrame, out: str, checkpoint: str, most: int = markdown.CHUNK_CHARS) -> None:
    """Run ``source`` (a streaming frame of doc_id, text) to its end, appending chunks to ``out``; every file exactly once."""
    query = markdown.chunks(source, most).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def documents_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_at_a_time: int = 100) -> DataFrame:
    """A stream of a folder's parquet files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_a_time).parquet(folder)


def job_stream(spark: SparkSession, folder: str, handle, checkpoint: str, files_at_a_time: int = 1, forever: bool = False) -> None:
    """Jobs for PDF files that arrive in ``folder``: ``handle(batch, number)`` gets them in turn, in order of arrival."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_at_a_time).load(folder)
    when = {"processingTime": "2 seconds"} if forever else {"availableNow": True}
    files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**when).start().awaitTermination()
