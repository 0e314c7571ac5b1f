"""Registered queries: validation (V-*), cleaning (K-*), quality rules (Q-5..Q-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, profile as prof, validate as val
from ..sources.tables import read_table
from .catalog import register, rounded
from .views import messy_view, with_views


@register("V1_validate_messy_lineitem")
def q_v1(spark, sf):
    return rounded(val.validate(messy_view(spark, sf)))


@register("V3_all_null_rows_and_V6_infinite", with_views("""
SELECT CAST(count(*) FILTER (WHERE coalesce(CAST(linenumber AS VARCHAR), CAST(sparse_discount AS VARCHAR),
                                            status_or_null) IS NULL) AS BIGINT) AS all_null_rows,
       CAST(count(*) FILTER (WHERE abs(sparse_discount) = 'inf'::DOUBLE) AS BIGINT) AS infinite_values
FROM messy""", "messy"))
def q_v3(spark, sf):
    m = messy_view(spark, sf).select("linenumber", "sparse_discount", "status_or_null")
    return m.agg(
        F.count_if(F.coalesce(*[F.col(c).cast("string") for c in m.columns]).isNull())
        .cast("bigint").alias("all_null_rows"),
        F.count_if(F.abs(F.col("sparse_discount")) == float("inf")).cast("bigint").alias("infinite_values"))


@register("V4_duplicate_rows_messy", with_views("""
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS BIGINT) AS duplicate_rows,
       CAST(count(*) AS BIGINT) AS rows FROM messy""", "messy"))
def q_v4(spark, sf):
    m = messy_view(spark, sf)
    d = prof.duplicate_rows(m)
    return m.agg(F.lit(d).cast("bigint").alias("duplicate_rows"), F.count(F.lit(1)).alias("rows"))


@register("K0_auto_clean_report")
def q_k0(spark, sf):
    _, report = clean.auto_clean(messy_view(spark, sf))
    return report


@register("K0_auto_clean_cleaned_table")
def q_k0_table(spark, sf):
    cleaned, _ = clean.auto_clean(messy_view(spark, sf))
    return cleaned


@register("K12_cleaning_summary")
def q_k12(spark, sf):
    _, report = clean.auto_clean(messy_view(spark, sf))
    return clean.cleaning_summary(report)


@register("Q6_dataset_quality_score_messy")
def q_q6(spark, sf):
    return rounded(prof.dataset_profile(messy_view(spark, sf)))


@register("Q9_column_status_messy")
def q_q9(spark, sf):
    return rounded(prof.column_status(prof.column_profiles(messy_view(spark, sf))))
