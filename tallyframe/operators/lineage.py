"""Cutting lineage between the steps of a cascade."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset a temporary one on a local master, an error elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallyframe-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint in the folder that the cluster shares."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _freed_shuffles(spark: SparkSession):
    """Within it, a query's shuffle files go as soon as the query is done, and not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """df written as compressed columns to the folder that the cluster shares, and read from there; for large tables, of which readers need some columns.

    What it was made of leaves no shuffle files. Its own files go with the session. Columns need names of their own and
    types that Parquet has; rows come back in any order and split.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    with _freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
