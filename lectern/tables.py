"""Reading the test tables and cutting lineage in shared storage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has written, and folders it has made for sessions without a shared one, by application.
_WRITTEN: dict[str, list[str]] = {}
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Where it is unset, a session in one process gets a folder of its own; on a cluster that is an
    error, since a folder of one machine would not be seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext.applicationId
        if own in _OWN:
            return _OWN[own]
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors can reach")
        named = _OWN[own] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return named


def materialise(df: DataFrame, label: str, options: dict[str, int] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where a result feeds several later jobs: the table survives the loss of executors and
    ends the lineage, and as columnar, compressed data it is smaller than a checkpoint. ``options`` go
    to the writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """Jobs that run inside hand batches of about ``most`` bytes to Python workers.

    Spark's own limit is 64 MB, which long texts take several times over in the JVM and in Python.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def forget(spark: SparkSession) -> int:
    """Removes the tables that ``materialise`` has written for this application, and returns their number.

    Results that were not yet written or collected can't be read after that.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files make fewer partitions than there are cores.

    Only inputs of a few files are moved by that; larger ones already have a partition a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
