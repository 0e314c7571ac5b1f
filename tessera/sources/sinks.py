"""Exports (L-12..L-14) and the dataset fingerprint (F-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import column_profiles


def export_csv(df: DataFrame, path: str) -> None:
    """L-12: header CSV, no index."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """L-14: JSON records."""
    df.write.mode("overwrite").json(path)


def export_workbook_tables(df: DataFrame, path: str) -> None:
    """L-13: the three sheets (data, statistics, column info) as three Parquet tables."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    prof = column_profiles(df)
    prof.select("column", "n_rows", "mean", "std", "min_val", "q25", "median", "q75", "max_val") \
        .write.mode("overwrite").parquet(f"{path}/statistics")
    prof.select("column", "dtype", "missing_count", "missing_pct", "unique_count") \
        .write.mode("overwrite").parquet(f"{path}/column_info")


def fingerprint(df: DataFrame) -> DataFrame:
    """F-1: order-free content fingerprint: row count, sum of 64-bit row hashes
    (as an exact decimal) and a schema string."""
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("content_hash")) \
             .select("rows", "content_hash", F.lit(schema).alias("schema"))
