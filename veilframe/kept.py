"""Frames kept in the shared folder while the application runs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where it is unset, one process that is driver and executor
    at once (tests) takes a folder of its own, and a cluster is refused, as its executors would not see that folder."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="veilframe-")
    return own


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/veilframe/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Executions in here leave no shuffle files behind: what they write to the shared folder takes their place."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    expire(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def expire(spark: SparkSession, path: str) -> None:
    """The table at path goes when the application ends, since frames that were returned may still read it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
