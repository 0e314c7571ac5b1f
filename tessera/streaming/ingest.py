"""File-drop ingestion: profile each arriving micro-batch.

``readStream`` over a file glob -> ``foreachBatch`` -> batch operators
(``col_stats`` and null counts) -> one Parquet partition per epoch,
written with ``overwrite`` so a replayed epoch (after a driver or executor
failure) rewrites the same output instead of duplicating it.  Stream
state lives in a checkpoint folder under the cluster-shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.stats import col_stats, numeric_columns


def batch_profile(batch: DataFrame, epoch_id: int) -> DataFrame:
    """Per-column statistics of one micro-batch plus its null counts."""
    nums = numeric_columns(batch)
    nulls = batch.agg(F.count(F.lit(1)).alias("rows"),
                      *[F.count_if(F.col(c).isNull()).alias(c) for c in batch.columns])
    long_nulls = nulls.select("rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("nulls")) for c in batch.columns]))
        .alias("x")).select("rows", "x.*")
    st = col_stats(batch, nums, min_n=1) if nums else None
    out = long_nulls if st is None else long_nulls.join(st, "column", "left")
    return out.withColumn("epoch_id", F.lit(epoch_id).cast("bigint"))


def start_profiling(spark: SparkSession, source_glob: str, schema: StructType, out_dir: str,
                    checkpoint: str, fmt: str = "parquet", base_path: str | None = None,
                    max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if base_path:
        reader = reader.option("basePath", base_path)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    stream = reader.load(source_glob)

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch_profile(batch, epoch_id).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_profiles(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(out_dir)
