"""Profiling and data-quality scoring (Q-2..Q-16).

Plan: (1) one wide aggregate for per-column null counts, string lengths
and date ranges; (2) one long-form ``(column, value)`` distinct-count
table for cardinality, top values and small value-count maps, combined
map-side; (3) ``col_stats`` for numeric columns.  Top values use partial
aggregates (``max`` of counts, then ``min`` value at that count), never a
window over one column's distinct values, so an id column with billions
of values does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import NUMERIC_TYPES, col_stats

# ---- fixed values that must equal the reference's -------------------------
ID_NAME_KEYWORDS = ("_id", "id_", "userid", "orderid", "custid", "empid", "itemid",
                    "skuid", "uuid", "key")
VALUE_NAME_KEYWORDS = ("price", "amount", "cost", "rate", "count", "score", "salary",
                       "revenue", "sales", "qty", "quantity", "hours", "age", "percent",
                       "pct", "evaluation", "satisfaction", "project")
URL_NAME_KEYWORDS = ("url", "link", "href", "img", "image", "photo", "thumbnail", "src",
                     "path", "uri")
# ---------------------------------------------------------------------------

_PANDAS_DTYPE = {
    "LongType": "int64", "IntegerType": "int32", "ShortType": "int16", "ByteType": "int8",
    "DoubleType": "float64", "FloatType": "float32", "StringType": "object",
    "BooleanType": "bool", "TimestampType": "datetime64[ns]",
    "TimestampNTZType": "datetime64[ns]", "DateType": "object",
}


def pandas_dtype(dt: T.DataType) -> str:
    return _PANDAS_DTYPE.get(type(dt).__name__, "object")


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "string"


def _as_string(c: str, dt: T.DataType):
    col = F.col(c)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        # -0.0 and 0.0 are one value (as in pandas nunique)
        col = F.when(col == 0, F.lit(0.0)).otherwise(col)
    return col.cast("string")


def column_profiles(df: DataFrame) -> DataFrame:
    """Q-3: one row per column (see FIXTURES column_profile)."""
    fields = df.schema.fields
    kinds = {f.name: _kind(f.dataType) for f in fields}
    spark = df.sparkSession

    # (1) wide aggregate: total rows, non-null counts, string lengths, date ranges
    aggs = [F.count(F.lit(1)).alias("__n")]
    for f in fields:
        aggs.append(F.count(F.col(f.name)).alias(f"nn__{f.name}"))
        if kinds[f.name] == "string":
            aggs.append(F.avg(F.length(F.col(f.name))).alias(f"len__{f.name}"))
        if kinds[f.name] == "datetime":
            aggs.append(F.min(F.col(f.name)).cast("string").alias(f"dmin__{f.name}"))
            aggs.append(F.max(F.col(f.name)).cast("string").alias(f"dmax__{f.name}"))
            aggs.append(F.datediff(F.max(F.col(f.name)), F.min(F.col(f.name))).alias(f"dd__{f.name}"))
    wide = df.agg(*aggs).first().asDict()
    n = wide["__n"]

    # (2) long-form distinct counts per (column, value)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column"), _as_string(f.name, f.dataType).alias("value"))
        for f in fields])).alias("kv")).select("kv.column", "kv.value")
    vc = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("cnt"))
    card = vc.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"),
                                    F.max("cnt").alias("top_cnt"))
    top = (vc.join(F.broadcast(card), "column").where(F.col("cnt") == F.col("top_cnt"))
             .groupBy("column").agg(F.min("value").alias("top_value")))
    small = (vc.join(F.broadcast(card.where(F.col("unique_count") <= 20).select("column")), "column")
               .groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(
                   F.struct("value", "cnt")))).alias("value_counts")))
    card = card.join(top, "column", "left").join(small, "column", "left")

    # static per-column facts (schema-bounded table)
    meta_rows = []
    for f in fields:
        low = f.name.lower()
        meta_rows.append((
            f.name, pandas_dtype(f.dataType), kinds[f.name], int(n),
            int(n - wide[f"nn__{f.name}"]),
            wide.get(f"len__{f.name}"),
            any(k in low for k in ID_NAME_KEYWORDS), any(k in low for k in VALUE_NAME_KEYWORDS),
            any(k in low for k in URL_NAME_KEYWORDS),
            wide.get(f"dmin__{f.name}"), wide.get(f"dmax__{f.name}"), wide.get(f"dd__{f.name}")))
    meta = spark.createDataFrame(meta_rows, "column string, dtype string, kind string, n long, "
                                 "missing_count long, avg_len double, id_name boolean, "
                                 "value_name boolean, url_name boolean, min_date string, "
                                 "max_date string, date_range_days int")

    num_cols = [f.name for f in fields if kinds[f.name] == "numeric"]
    p = meta.join(card, "column", "left")
    if num_cols:
        cs = col_stats(df, num_cols)
        p = p.join(cs.select("column", "mean", "median", "std", F.col("min").alias("min_val"),
                             F.col("max").alias("max_val"), F.col("q1").alias("q25"),
                             F.col("q3").alias("q75"), F.col("skew").alias("skewness"),
                             F.col("outliers").alias("outlier_count"),
                             F.col("outlier_pct").alias("_opct")), "column", "left")
    else:
        for c, t in [("mean", "double"), ("median", "double"), ("std", "double"),
                     ("min_val", "double"), ("max_val", "double"), ("q25", "double"),
                     ("q75", "double"), ("skewness", "double"), ("outlier_count", "bigint"),
                     ("_opct", "double")]:
            p = p.withColumn(c, F.lit(None).cast(t))

    u = F.coalesce(F.col("unique_count"), F.lit(0)).cast("bigint")
    nn = F.col("n").cast("double")
    ratio = u / F.greatest(nn, F.lit(1.0))
    inferred = (
        F.when(u <= 1, "constant")
         .when(F.col("kind") == "datetime", "datetime")
         .when(F.col("kind") == "bool", "binary")
         .when(F.col("kind") == "numeric",
               F.when(u == 2, "binary")
                .when((ratio > 0.95) & (F.col("n") > 50) & F.col("id_name") & ~F.col("value_name"), "id")
                .otherwise("numeric"))
         .when((ratio > 0.85) & (F.col("n") > 50),
               F.when(F.col("url_name"), "id").when(F.col("avg_len") < 20, "id").otherwise("text"))
         .when(u <= 50, "categorical")
         .otherwise("text"))
    p = p.withColumn("unique_count", u).withColumn("inferred_type", inferred)
    is_num = F.col("inferred_type").isin("numeric", "binary") & (F.col("kind") == "numeric")
    is_cat = F.col("inferred_type").isin("categorical", "id", "text", "constant")
    missing_pct = F.bround(F.col("missing_count") / F.greatest(nn, F.lit(1.0)) * 100.0, 1)
    p = p.withColumn("missing_pct", missing_pct)
    for c in ("mean", "median", "std", "min_val", "max_val", "q25", "q75", "skewness"):
        p = p.withColumn(c, F.when(is_num, F.col(c)))
    p = (p.withColumn("outlier_count", F.when(is_num, F.coalesce("outlier_count", F.lit(0))).otherwise(0)
                      .cast("bigint"))
          .withColumn("outlier_pct", F.when(is_num, F.coalesce(F.bround("_opct", 1), F.lit(0.0)))
                      .otherwise(0.0))
          .withColumn("top_value", F.when(is_cat, F.col("top_value")))
          .withColumn("top_value_pct", F.when(is_cat & F.col("top_cnt").isNotNull(), F.bround(
              F.col("top_cnt") / F.greatest(nn - F.col("missing_count"), F.lit(1.0)) * 100.0, 1)))
          .withColumn("value_counts", F.when(is_cat, F.col("value_counts"))))
    score = (F.lit(100.0) - F.col("missing_pct") / 100.0 * 50.0
             - F.when(F.col("outlier_count") > 0, F.least(F.col("outlier_pct") * 0.5, F.lit(15.0)))
              .otherwise(0.0)
             - F.when((u <= 1) & (F.col("n") > 1), 20.0).otherwise(0.0))
    score = F.when(F.col("inferred_type") == "id", F.least(score, F.lit(80.0))).otherwise(score)
    p = p.withColumn("quality_score", F.greatest(F.lit(0.0), F.bround(score, 1)))
    issues = F.array_compact(F.array(
        F.when(F.col("missing_pct") > 0, F.concat(F.format_number("missing_pct", 1), F.lit("% missing"))),
        F.when(is_num & (F.col("outlier_pct") > 10),
               F.concat(F.format_number("outlier_pct", 1), F.lit("% outliers"))),
        F.when(is_num & (F.abs(F.col("skewness")) > 2),
               F.concat(F.lit("heavily skewed ("), F.format_number("skewness", 1), F.lit(")"))),
        F.when(is_cat & (F.col("inferred_type") == "constant"), F.lit("constant value — no variance")),
        F.when(is_cat & (F.col("inferred_type") == "id"), F.lit("ID column — exclude from analysis"))))
    return p.select(
        "column", "dtype", "inferred_type", F.col("n").alias("n_rows"), "missing_count", "missing_pct", "unique_count",
        F.bround(u / F.greatest(nn, F.lit(1.0)) * 100.0, 1).alias("unique_pct"),
        (F.col("inferred_type") == "id").alias("is_id_like"),
        (F.col("inferred_type") == "constant").alias("is_constant"),
        "mean", "median", "std", "min_val", "max_val", "q25", "q75", "skewness",
        "outlier_count", "outlier_pct", "top_value", "top_value_pct", "value_counts",
        F.when(F.col("kind") == "datetime", F.col("min_date")).alias("min_date"),
        F.when(F.col("kind") == "datetime", F.col("max_date")).alias("max_date"),
        F.when(F.col("kind") == "datetime", F.col("date_range_days")).alias("date_range_days"),
        "quality_score", issues.alias("quality_issues"))


def duplicate_rows(df: DataFrame) -> int:
    """V-4: rows repeating an earlier row = rows - distinct rows."""
    return int(df.groupBy(*df.columns).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0])


def grade(score) -> str:
    return ("A" if score >= 90 else "B" if score >= 75 else "C" if score >= 60
            else "D" if score >= 45 else "F")


def grade_col(c) -> F.Column:
    return (F.when(c >= 90, "A").when(c >= 75, "B").when(c >= 60, "C").when(c >= 45, "D")
             .otherwise("F"))


def dataset_profile(df: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Q-6 / Q-7 / Q-15: dataset totals, duplicate share and composite quality
    ``0.6·completeness + 0.3·dedup + 0.1·mean(column score)`` with grade."""
    profiles = profiles if profiles is not None else column_profiles(df)
    pa = profiles.agg(
        F.sum("missing_count").alias("missing_cells"), F.avg("quality_score").alias("col_health"),
        F.count(F.lit(1)).alias("cols"),
        F.count_if(F.size("quality_issues") > 0).alias("n_issues"),
        F.sort_array(F.collect_list(F.when(F.col("is_id_like"), F.col("column")))).alias("id_cols"),
        F.sort_array(F.collect_list(F.when(F.col("is_constant"), F.col("column")))).alias("constant_cols"),
        F.sort_array(F.collect_list(F.when(F.col("missing_pct") > 30, F.col("column")))).alias("high_missing_cols"),
        F.sort_array(F.collect_list(F.when(F.col("outlier_pct") > 10, F.col("column")))).alias("high_outlier_cols"),
    )
    rows = df.count()
    dups = duplicate_rows(df)
    total_cells = rows * len(df.columns)
    tc = F.lit(float(max(total_cells, 1)))
    completeness = (F.lit(1.0) - F.col("missing_cells") / tc) * 100.0
    dedup = (1.0 - dups / max(rows, 1)) * 100.0
    overall = F.bround(completeness * 0.6 + F.lit(dedup * 0.3) + F.col("col_health") * 0.1, 1)
    return pa.select(
        F.lit(rows).cast("bigint").alias("rows"), F.col("cols").cast("int").alias("cols"),
        F.lit(total_cells).cast("bigint").alias("total_cells"),
        F.col("missing_cells").cast("bigint").alias("missing_cells"),
        F.bround(F.col("missing_cells") / tc * 100.0, 1).alias("missing_pct"),
        F.lit(dups).cast("bigint").alias("duplicate_rows"),
        F.lit(round(dups / max(rows, 1) * 100, 1)).cast("double").alias("duplicate_pct"),
        overall.alias("overall_quality_score"), grade_col(overall).alias("grade"),
        F.col("n_issues").cast("int").alias("n_issues"),
        "id_cols", "constant_cols", "high_missing_cols", "high_outlier_cols")


def column_status(profiles: DataFrame) -> DataFrame:
    """Q-9: HIGH MISSING (>20 %) / REVIEW (>5 %) / CONSTANT / ID COL / OK."""
    return profiles.select(
        "column", "missing_pct",
        F.when(F.col("missing_pct") > 20, "HIGH MISSING").when(F.col("missing_pct") > 5, "REVIEW")
         .when(F.col("unique_count") == 1, "CONSTANT")
         .when(F.col("unique_count") == F.col("n_rows"), "ID COL")
         .otherwise("OK").alias("status"))


def quality_verdict(missing_pct, dup_pct) -> str:
    """Q-14: GOOD / FAIR / POOR by missing and duplicate % tiers 1 / 5."""
    if missing_pct < 1 and dup_pct < 1:
        return "GOOD"
    if missing_pct < 5 and dup_pct < 5:
        return "FAIR"
    return "POOR"
