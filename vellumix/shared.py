"""What operators need of the cluster: their code on the executors, and tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumix.errors import ConfigError

_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a SparkContext, whatever their PYTHONPATH is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="vellumix-")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((top / "vellumix").rglob("*.py")):
            z.write(f, f.relative_to(top))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine a session may name none; a folder of our own is used then.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="vellumix-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends (or by ``discard``)."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/vellumix-{app}/{tag}-{uuid.uuid4().hex}"
    if app not in _written:
        _written[app] = []
        atexit.register(_clean, spark, app)
    _written[app].append(path)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession, app: str) -> None:
    if spark.sparkContext._jsc is not None:
        for path in _written.pop(app, []):
            discard(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt out to all cores if they come in fewer partitions than there are cores.

    A file of one row group is one partition, however many cores wait. Inputs of more partitions than
    cores, as large ones are, stay as they are and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def apart(df: DataFrame) -> DataFrame:
    """The same rows, dealt out anew.

    For an aggregate that is joined back by its key: what it is joined with then has a shuffle of
    the join's own, of which Spark splits the partition of a hot key.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fenced(df: DataFrame) -> DataFrame:
    """The same rows, whose columns the optimizer moves into nothing above: they are computed once, here. Not for streams."""
    return df.withColumn("_fence", F.monotonically_increasing_id()).where("_fence >= 0").drop("_fence")


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
