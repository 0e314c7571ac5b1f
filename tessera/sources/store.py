"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

PREFIX = "tessera-table-"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    The result is computed once, however many actions read it, and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{PREFIX}{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Delete every stored table of the session's checkpoint folder; returns how many.

    For the end of a job: plans that still read a stored table fail afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(PREFIX)]
    for p in names:
        fs.delete(p, True)
    return len(names)
