"""Registered queries giving every SURVEY §2 operator its own key:
sources (L-*), validation (V-*) and the individual cleaning steps (K-*)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions.scalars import nullify_nonfinite
from ..operators import clean, validate as val
from ..sources import files, sinks
from ..sources.tables import TABLES, read_table
from .catalog import register, rounded
from .queries_misc import _shared_dir
from .views import messy_view, with_views

MESSY_DEDUP_COLS = "l_returnflag, linenumber, l_quantity, l_tax, returned_flag"


# ------------------------------------------------------------------ L-*
@register("L1_load_file_dispatch_by_extension")
def q_l1(spark, sf):
    """L-1: parquet / csv / json dispatch and rejection of an unsupported extension."""
    base = _shared_dir(spark, "dispatch")
    o = read_table(spark, sf, "orders")
    o.write.mode("overwrite").parquet(f"{base}/orders.parquet")
    o.write.mode("overwrite").option("header", True).csv(f"{base}/orders.csv")
    o.write.mode("overwrite").json(f"{base}/orders.json")
    rows = []
    for name in ("orders.parquet", "orders.csv/*.csv", "orders.json/*.json", "orders.xml"):
        try:
            df = files.load_file(spark, f"{base}/{name}", max_mb=None)
            rows.append((name, "loaded", df.count(), len(df.columns)))
        except files.LoadError as e:
            rows.append((name, f"rejected: {e}", 0, 0))
    return spark.createDataFrame(rows, "file string, outcome string, n_rows long, n_cols int")


@register("L5_parquet_scan_lineitem_by_flag", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1""")
def q_l5(spark, sf):
    df = files.load_file(spark, os.path.join(sf, "lineitem.parquet"), infer=False, max_mb=None)
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                          F.round(F.sum("l_extendedprice"), 2).alias("price"))


@register("L8_infinite_values_to_null", """
SELECT CAST(count(*) FILTER (WHERE l_tax = 0) AS BIGINT) AS inf_values,
       CAST(count(*) FILTER (WHERE l_tax <> 0) AS BIGINT) AS non_null_after FROM lineitem""")
def q_l8(spark, sf):
    li = read_table(spark, sf, "lineitem")
    d = li.select(F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("x"))
    inf_values = d.agg(F.count_if(F.col("x") == float("inf"))).first()[0]
    return nullify_nonfinite(d).agg(F.lit(inf_values).cast("bigint").alias("inf_values"),
                                    F.count("x").cast("bigint").alias("non_null_after"))


@register("L9_drop_all_null_rows_and_columns", with_views("""
, d AS (SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS q,
               CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS f, CAST(NULL AS DOUBLE) AS empty FROM lineitem)
SELECT CAST((SELECT count(*) FROM d) AS BIGINT) AS rows_before,
       CAST((SELECT count(*) FROM d WHERE q IS NOT NULL OR f IS NOT NULL OR empty IS NOT NULL) AS BIGINT) AS rows_after,
       'empty' AS dropped_columns""", "messy"))
def q_l9(spark, sf):
    li = read_table(spark, sf, "lineitem")
    d = li.select(F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_quantity")).alias("q"),
                  F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_returnflag")).alias("f"),
                  F.lit(None).cast("double").alias("empty"))
    nn = d.agg(*[F.count(c).alias(c) for c in d.columns]).first()
    empty = [c for c in d.columns if nn[c] == 0]
    kept = d.dropna(how="all").drop(*empty)
    return kept.agg(F.count(F.lit(1)).cast("bigint").alias("rows_after")).select(
        F.lit(d.count()).cast("bigint").alias("rows_before"), "rows_after",
        F.lit(",".join(empty)).alias("dropped_columns"))


@register("L10_L11_type_inference_csv_lineitem", """
SELECT CAST(count(*) AS BIGINT) AS rows, round(sum(l_extendedprice), 2) AS price, CAST(sum(l_quantity) AS BIGINT) AS qty,
       CAST(min(l_shipdate) AS VARCHAR) AS first_ship,
       'bigint,bigint,bigint,bigint,bigint,double,double,double,string,string,timestamp' AS inferred_types FROM lineitem""")
def q_l10(spark, sf):
    path = _shared_dir(spark, "lineitem_csv")
    (read_table(spark, sf, "lineitem").write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    df = files.load_file(spark, path + "/*.csv", max_mb=None)
    types = ",".join(f.dataType.simpleString() for f in df.schema.fields)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
                  F.sum("l_quantity").cast("bigint").alias("qty"),
                  F.min("l_shipdate").cast("string").alias("first_ship"), F.lit(types).alias("inferred_types"))


@register("L12_csv_export_roundtrip_part", """
SELECT CAST(count(*) AS BIGINT) AS rows, round(sum(p_retailprice), 2) AS price, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands FROM part""")
def q_l12(spark, sf):
    path = _shared_dir(spark, "part_csv")
    sinks.export_csv(read_table(spark, sf, "part"), path)
    df = files.load_file(spark, path + "/*.csv", max_mb=None)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("p_retailprice"), 2).alias("price"),
                  F.countDistinct("p_brand").alias("brands"))


@register("L14_json_export_roundtrip_supplier", """
SELECT CAST(count(*) AS BIGINT) AS rows, round(sum(s_acctbal), 2) AS balance FROM supplier""")
def q_l14(spark, sf):
    path = _shared_dir(spark, "supplier_json")
    sinks.export_json(read_table(spark, sf, "supplier"), path)
    df = files.load_file(spark, path + "/*.json", max_mb=None)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


# ------------------------------------------------------------------ V-*
@register("V2_missing_cells_warning_messy", with_views("""
, c AS (SELECT count(*) * 8 AS cells,
               count(*) FILTER (WHERE l_returnflag IS NULL) + count(*) FILTER (WHERE linenumber IS NULL)
               + count(*) FILTER (WHERE l_quantity IS NULL) + count(*) FILTER (WHERE l_tax IS NULL)
               + count(*) FILTER (WHERE sparse_discount IS NULL) + count(*) FILTER (WHERE source IS NULL)
               + count(*) FILTER (WHERE returned_flag IS NULL) + count(*) FILTER (WHERE status_or_null IS NULL) AS missing FROM messy)
SELECT round(missing * 100.0 / cells, 6) AS missing_pct,
       CASE WHEN missing * 100.0 / cells > 50 THEN 'very high' WHEN missing * 100.0 / cells > 20 THEN 'high' ELSE 'ok' END AS tier
FROM c""", "messy"))
def q_v2(spark, sf):
    v = val.validate(messy_view(spark, sf)).where(F.col("check") == "missing_cells_pct")
    return rounded(v.select(F.col("value").alias("missing_pct"),
                            F.when(F.col("value") > 50, "very high").when(F.col("value") > 20, "high")
                             .otherwise("ok").alias("tier")))


@register("V7_mixed_type_detection", """
WITH d AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_quantity AS VARCHAR) ELSE l_returnflag END AS mixed,
                  l_returnflag AS text_only FROM lineitem)
SELECT 'mixed' AS "column", round(avg(CASE WHEN try_cast(mixed AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS numeric_pct FROM d
UNION ALL SELECT 'text_only', round(avg(CASE WHEN try_cast(text_only AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100.0, 6) FROM d""")
def q_v7(spark, sf):
    li = read_table(spark, sf, "lineitem")
    d = li.select(F.when(F.col("l_orderkey") % 2 == 0, F.col("l_quantity").cast("string"))
                  .otherwise(F.col("l_returnflag")).alias("mixed"), F.col("l_returnflag").alias("text_only"))
    return rounded(d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v"))
                                                for c in d.columns])).alias("x")).select("x.*")
                   .groupBy("column").agg((F.avg(F.expr("try_cast(v AS DOUBLE)").isNotNull().cast("double")) * 100.0)
                                          .alias("numeric_pct")))


@register("V8_V10_upload_limits_per_table")
def q_v8(spark, sf):
    rows = []
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if not os.path.exists(p):
            continue
        df = read_table(spark, sf, t)
        mb = files.file_size_mb(spark, p)
        n = df.count()
        msgs = val.validate_upload(mb, n, len(df.columns))
        rows.append((t, float(mb), int(n), len(df.columns), "; ".join(msgs) or "ok"))
    return spark.createDataFrame(rows, "table string, size_mb double, n_rows long, n_cols int, verdict string")


# ------------------------------------------------------------------ K-*
def _report(spark, sf):
    return clean.auto_clean(messy_view(spark, sf))[1]


@register("K1_strip_column_names")
def q_k1(spark, sf):
    d = messy_view(spark, sf)
    d = d.toDF(*[f" {c} " if i % 2 == 0 else c for i, c in enumerate(d.columns)])
    _, rep = clean.auto_clean(d)
    return rep.where(F.col("issue") == "leading/trailing whitespace").select("column", "before", "after")


@register("K2_drop_fully_empty_columns")
def q_k2(spark, sf):
    d = messy_view(spark, sf).withColumn("always_null", F.lit(None).cast("double"))
    _, rep = clean.auto_clean(d)
    return rep.where(F.col("issue") == "100% empty").select("column", "action", "rows_affected")


@register("K3_K7_drop_sparse_columns", with_views("""
SELECT 'sparse_discount' AS "column", CAST(floor(count(*) FILTER (WHERE sparse_discount IS NULL) * 100.0 / count(*)) AS BIGINT) AS null_pct
FROM messy HAVING count(*) FILTER (WHERE sparse_discount IS NULL) * 100.0 / count(*) > 55""", "messy"))
def q_k3(spark, sf):
    rep = _report(spark, sf).where(F.col("issue").startswith(">55% missing"))
    return rep.select("column", F.regexp_extract("before", r"^(\d+)", 1).cast("bigint").alias("null_pct"))


@register("K4_drop_constant_columns", with_views("""
SELECT "column" FROM (SELECT 'source' AS "column", count(DISTINCT source) AS u FROM messy
                      UNION ALL SELECT 'status_or_null', count(DISTINCT status_or_null) FROM messy
                      UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM messy) WHERE u <= 1""", "messy"))
def q_k4(spark, sf):
    return _report(spark, sf).where(F.col("issue") == "constant value (no variance)").select("column")


@register("K5_remove_duplicate_rows", with_views(f"""
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {MESSY_DEDUP_COLS} FROM messy)) AS BIGINT) AS rows_affected,
       CAST((SELECT count(*) FROM (SELECT DISTINCT {MESSY_DEDUP_COLS} FROM messy)) AS BIGINT) AS rows_after FROM messy""", "messy"))
def q_k5(spark, sf):
    rep = _report(spark, sf).where(F.col("issue_group") == "duplicates")
    return rep.select("rows_affected", F.col("after").cast("bigint").alias("rows_after"))


@register("K6_trim_strings_count_changed", with_views(f"""
SELECT CAST(count(*) FILTER (WHERE returned_flag <> trim(returned_flag)) AS BIGINT) AS rows_affected
FROM (SELECT DISTINCT {MESSY_DEDUP_COLS} FROM messy)""", "messy"))
def q_k6(spark, sf):
    return _report(spark, sf).where(F.col("issue_group") == "whitespace").select("rows_affected")


@register("K8_median_imputation_value", with_views(f"""
SELECT 'linenumber' AS "column", CAST(count(*) FILTER (WHERE linenumber IS NULL) AS BIGINT) AS rows_affected,
       round(quantile_cont(linenumber, 0.5), 6) AS fill_value
FROM (SELECT DISTINCT {MESSY_DEDUP_COLS} FROM messy)""", "messy"))
def q_k8(spark, sf):
    rep = _report(spark, sf).where(F.col("action").startswith("filled with median"))
    return rep.select("column", "rows_affected",
                      F.regexp_extract("action", r"\(([-0-9.e+]+)\)", 1).cast("double").alias("fill_value"))


@register("K9_mode_or_unknown_imputation")
def q_k9(spark, sf):
    li = read_table(spark, sf, "lineitem")
    d = li.select("l_orderkey", "l_linenumber",
                  F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("l_returnflag")).alias("flag_some_missing"),
                  F.when(F.col("l_linenumber") <= 3, None).otherwise(F.col("l_linestatus")).alias("status_often_missing"))
    _, rep = clean.auto_clean(d)
    return rep.where(F.col("action").startswith("filled with")).select("column", "issue", "action", "rows_affected")


@register("K10_extreme_outlier_flags")
def q_k10(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") * 10).otherwise(F.col("o_totalprice"))
        .alias("price_with_spikes"))
    _, rep = clean.auto_clean(o)
    return rep.where(F.col("issue_group") == "flagged").select("column", "issue", "rows_affected")


@register("K11_boolean_normalisation", with_views(f"""
SELECT 'returned_flag' AS "column", CAST(count(*) AS BIGINT) AS rows_affected,
       CAST(count(*) FILTER (WHERE lower(trim(returned_flag)) IN ('yes', 'true', '1', 'y')) AS BIGINT) AS n_true
FROM (SELECT DISTINCT {MESSY_DEDUP_COLS} FROM messy)""", "messy"))
def q_k11(spark, sf):
    cleaned, rep = clean.auto_clean(messy_view(spark, sf))
    n_true = cleaned.where(F.col("returned_flag")).count()
    return rep.where(F.col("issue_group") == "type_fix").select("column", "rows_affected",
                                                               F.lit(n_true).cast("bigint").alias("n_true"))


# ======================================================================
# Q-*: profile pieces
# ======================================================================
from ..operators import profile as prof, stats  # noqa: E402
from .queries_stats import CUSTOMER_COLS, ORDERS_COLS, profile_sql  # noqa: E402


def _profile_subset_sql(table, cols, select):
    return f"WITH prof AS ({profile_sql(table, cols)})\nSELECT {select} FROM prof"


@register("Q2_inferred_column_types_orders", _profile_subset_sql("orders", ORDERS_COLS, '"column", inferred_type'))
def q_q2(spark, sf):
    return prof.column_profiles(read_table(spark, sf, "orders")).select("column", "inferred_type")


@register("Q4_datetime_profile_orderdate", """
SELECT 'o_orderdate' AS "column", CAST(min(o_orderdate) AS VARCHAR) AS min_date, CAST(max(o_orderdate) AS VARCHAR) AS max_date,
       CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS INTEGER) AS date_range_days FROM orders""")
def q_q4(spark, sf):
    return prof.column_profiles(read_table(spark, sf, "orders")).where(F.col("column") == "o_orderdate") \
        .select("column", "min_date", "max_date", "date_range_days")


@register("Q5_column_quality_scores_customer", _profile_subset_sql("customer", CUSTOMER_COLS, '"column", quality_score'))
def q_q5(spark, sf):
    return rounded(prof.column_profiles(read_table(spark, sf, "customer")).select("column", "quality_score"))


@register("Q7_profile_dataset_orders_customer_mix")
def q_q7(spark, sf):
    return rounded(prof.dataset_profile(read_table(spark, sf, "orders")))


@register("Q10_analytical_flags_lineitem")
def q_q10(spark, sf):
    st = stats.col_stats(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    n = F.col("n").cast("double")
    g1 = stats.skew_G1(F.col("skew"), n)
    cvp = F.col("cv") * 100.0
    flag = (F.when(cvp > 80, "highly variable").when(F.abs(g1) > 1.5, "skewed")
             .when(F.col("outlier_pct") > 5, "outliers").when(cvp < 15, "stable").otherwise("normal"))
    return rounded(st.select("column", "mean", "median", cvp.alias("cv_pct"), g1.alias("skew_G1"), "outlier_pct",
                             flag.alias("flag")))


@register("Q11_describe_table_lineitem", """
WITH long AS (SELECT 'l_quantity' AS "column", CAST(l_quantity AS DOUBLE) AS v FROM lineitem
              UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM lineitem)
SELECT "column", CAST(count(v) AS BIGINT) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       round(min(v), 6) AS "min", round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS "max" FROM long GROUP BY "column" """)
def q_q11(spark, sf):
    st = stats.col_stats(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], min_n=1)
    return rounded(st.select("column", F.col("n").alias("count"), "mean", "std", "min", F.col("q1").alias("p25"),
                             F.col("median").alias("p50"), F.col("q3").alias("p75"), "max"))


@register("Q12_column_info_customer", _profile_subset_sql(
    "customer", CUSTOMER_COLS, '"column", dtype, missing_count, missing_pct, unique_count'))
def q_q12(spark, sf):
    return rounded(prof.column_profiles(read_table(spark, sf, "customer"))
                   .select("column", "dtype", "missing_count", "missing_pct", "unique_count"))


@register("Q13_general_numeric_profile_orders", """
WITH long AS (SELECT 'o_totalprice' AS "column", CAST(o_totalprice AS DOUBLE) AS v FROM orders
              UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders)
, s AS (SELECT "column", count(*) AS n, count(v) AS nn, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
               stddev_samp(v) AS std, skewness(v) AS skew_G1, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90
        FROM long GROUP BY "column")
SELECT "column", CAST(nn AS BIGINT) AS count, round((n - nn) * 100.0 / n, 6) AS missing_pct, round(mean, 6) AS mean,
       round(median, 6) AS median, round(std, 6) AS std, round(std / abs(mean) * 100.0, 6) AS cv_pct,
       round(skew_G1, 6) AS skew_G1, round(p10, 6) AS p10, round(p90, 6) AS p90 FROM s""")
def q_q13(spark, sf):
    o = read_table(spark, sf, "orders")
    cols = ["o_totalprice", "o_custkey"]
    st = stats.col_stats(o, cols, min_n=1)
    n = o.count()
    return rounded(st.select("column", F.col("n").alias("count"),
                             ((F.lit(n) - F.col("n")) * 100.0 / F.lit(n)).alias("missing_pct"), "mean", "median", "std",
                             (F.col("cv") * 100.0).alias("cv_pct"),
                             stats.skew_G1(F.col("skew"), F.col("n").cast("double")).alias("skew_G1"), "p10", "p90"))


@register("Q14_data_quality_verdict_tables")
def q_q14(spark, sf):
    rows = []
    from .views import messy_view as mv
    for name, df in [("orders", read_table(spark, sf, "orders")), ("messy_lineitem", mv(spark, sf))]:
        n = df.count()
        miss = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
        mp = sum(miss[c] for c in df.columns) / len(df.columns) * 100
        dp = prof.duplicate_rows(df) / max(n, 1) * 100
        rows.append((name, float(mp), float(dp), prof.quality_verdict(mp, dp)))
    return rounded(spark.createDataFrame(rows, "table string, missing_pct double, duplicate_pct double, verdict string"))


@register("Q15_dataset_summary_orders", """
SELECT CAST(count(*) AS BIGINT) AS rows, 6 AS cols, 3 AS numeric_cols, 2 AS text_cols, 1 AS datetime_cols,
       CAST(0 AS BIGINT) AS missing_cells,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS BIGINT) AS duplicate_rows FROM orders""")
def q_q15(spark, sf):
    o = read_table(spark, sf, "orders")
    kinds = [prof._kind(f.dataType) for f in o.schema.fields]
    miss = o.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in o.columns]).first()
    return o.agg(F.count(F.lit(1)).cast("bigint").alias("rows")).select(
        "rows", F.lit(len(o.columns)).alias("cols"), F.lit(kinds.count("numeric")).alias("numeric_cols"),
        F.lit(kinds.count("string")).alias("text_cols"), F.lit(kinds.count("datetime")).alias("datetime_cols"),
        F.lit(sum(miss[c] for c in o.columns)).cast("bigint").alias("missing_cells"),
        F.lit(prof.duplicate_rows(o)).cast("bigint").alias("duplicate_rows"))


@register("Q16_compute_health_messy")
def q_q16(spark, sf):
    from .views import messy_view as mv
    m = mv(spark, sf)
    p = prof.column_profiles(m)
    d = prof.dataset_profile(m, p)
    share = p.agg((F.avg((F.col("outlier_count") > 0).cast("double")) * 100.0).alias("outlier_col_pct"),
                  F.avg("outlier_pct").alias("outlier_pct")).first()
    return rounded(d.select(F.col("overall_quality_score").alias("score"), "grade", "missing_pct", "duplicate_pct",
                            F.lit(share["outlier_pct"]).cast("double").alias("outlier_pct"),
                            F.lit(share["outlier_col_pct"]).cast("double").alias("outlier_col_pct")))


# ======================================================================
# P-6 / P-7 / P-11, W-9, C-*, H-6, H-14, E-5
# ======================================================================
from ..functions.binning import equal_width_bin, equal_width_bin_sql, quantile_bins  # noqa: E402
from ..operators import bi, corr, eda, hypothesis as hyp  # noqa: E402
from ..operators.domains.ecommerce import PRICE_BAND_LABELS  # noqa: E402
from ..operators.quantiles import exact_quantiles  # noqa: E402
from .views import ecommerce_view, finance_view, hr_view  # noqa: E402


@register("P6_price_quintile_bins_part", """
WITH q AS (SELECT quantile_cont(p_retailprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM part WHERE p_retailprice IS NOT NULL)
SELECT CASE WHEN p_retailprice >= e[1] AND p_retailprice <= e[2] THEN 'Bottom 20%' WHEN p_retailprice > e[2] AND p_retailprice <= e[3] THEN '20–40%'
            WHEN p_retailprice > e[3] AND p_retailprice <= e[4] THEN '40–60%' WHEN p_retailprice > e[4] AND p_retailprice <= e[5] THEN '60–80%'
            WHEN p_retailprice > e[5] AND p_retailprice <= e[6] THEN 'Top 20%' END AS band, CAST(count(*) AS BIGINT) AS n
FROM part, q WHERE p_retailprice IS NOT NULL GROUP BY 1""")
def q_p6(spark, sf):
    p = read_table(spark, sf, "part").where(F.col("p_retailprice").isNotNull())
    q = exact_quantiles(p.select(F.col("p_retailprice").alias("v")), [], "v",
                        [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).first()
    edges = [q[f"q{i}"] for i in range(6)]
    return p.groupBy(quantile_bins(F.col("p_retailprice"), edges, PRICE_BAND_LABELS).alias("band")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("P7_equal_width_20_bins_mean_revenue")
def q_p7(spark, sf):
    e = ecommerce_view(spark, sf)
    mm = e.agg(F.min("price").alias("lo"), F.max("price").alias("hi")).first()
    return rounded(e.groupBy(equal_width_bin(F.col("price"), mm["lo"], mm["hi"], 20).alias("bin"))
                   .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.avg("revenue").alias("mean_revenue")))


@register("P11_days_since_min_orderdate", """
SELECT CAST(date_diff('day', CAST((SELECT min(o_orderdate) FROM orders) AS DATE), CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 1""")
def q_p11(spark, sf):
    o = read_table(spark, sf, "orders")
    first = o.select(F.min("o_orderdate")).scalar()
    return o.groupBy(F.datediff(F.col("o_orderdate"), first).alias("days")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("W9_cumulative_share_rank_by_brand", with_views("""
, g AS (SELECT CAST(cat AS VARCHAR) AS name, sum(rev) AS value FROM finance WHERE cat IS NOT NULL GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY value DESC, name) AS BIGINT) AS rank, name, round(value, 4) AS value,
       round(sum(value) OVER (ORDER BY value DESC, name ROWS UNBOUNDED PRECEDING) * 100.0 / sum(value) OVER (), 6) AS cumulative_pct
FROM g""", "finance"))
def q_w9(spark, sf):
    return rounded(bi.pareto(finance_view(spark, sf), "cat", "rev").select("rank", "name", "value", "cumulative_pct"),
                   {"value": 4})


@register("C2_correlation_analysis_with_significance")
def q_c2(spark, sf):
    return rounded(corr.spearman_pairs(hr_view(spark, sf), ["satisfaction", "tenure", "hours", "projects", "evaluation"]))


@register("C3_bivariate_effect_labels_lineitem")
def q_c3(spark, sf):
    s = corr.spearman_pairs(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                            with_p=False)
    return rounded(s.withColumn("effect", corr.effect_label(F.col("r"))))


@register("C6_spearman_matrix_orders")
def q_c6(spark, sf):
    return rounded(corr.spearman_pairs(read_table(spark, sf, "orders"), ["o_totalprice", "o_custkey", "o_orderkey"],
                                       with_p=False))


@register("C7_discount_rating_verdict")
def q_c7(spark, sf):
    s = corr.spearman_pairs(ecommerce_view(spark, sf), ["discount", "rating"], with_p=False)
    return rounded(s.withColumn("verdict", F.when(F.abs(F.col("r")) > 0.15, "discounts move ratings")
                                .otherwise("no meaningful link")))


@register("H6_iqr_outliers_orders_customer", """
WITH long AS (SELECT 'o_totalprice' AS "column", CAST(o_totalprice AS DOUBLE) AS v FROM orders
              UNION ALL SELECT 'c_acctbal', CAST(c_acctbal AS DOUBLE) FROM customer)
, q AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long WHERE v IS NOT NULL GROUP BY 1)
SELECT l."column", CAST(count(*) FILTER (WHERE q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))) AS BIGINT) AS outliers_iqr
FROM long l JOIN q ON l."column" = q."column" WHERE v IS NOT NULL GROUP BY 1""")
def q_h6(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_totalprice"), F.lit(None).cast("double").alias("c_acctbal"))
    c = read_table(spark, sf, "customer").select(F.lit(None).cast("double").alias("o_totalprice"), F.col("c_acctbal"))
    st = stats.col_stats(o.unionByName(c), ["o_totalprice", "c_acctbal"], iqr_guard=True)
    return st.select("column", F.col("outliers").alias("outliers_iqr"))


@register("H14_eta_squared_hours_by_dept", with_views("""
, x AS (SELECT CAST(dept AS VARCHAR) AS g, CAST(hours AS DOUBLE) AS v FROM hr WHERE dept IS NOT NULL AND hours IS NOT NULL)
, g AS (SELECT g, count(*) AS n, avg(v) AS m FROM x GROUP BY g)
, t AS (SELECT avg(v) AS gm, var_pop(v) * count(*) AS sst FROM x)
SELECT round(sum(n * pow(m - gm, 2)) / any_value(sst), 6) AS eta_sq FROM g, t""", "hr"))
def q_h14(spark, sf):
    d = hyp._prep(hr_view(spark, sf), "hours", "dept")
    return rounded(hyp.anova_table(d).select("eta_sq"))


@register("E5_stats_analyze_numeric_orders")
def q_e5(spark, sf):
    return rounded(eda.stats_analyze(read_table(spark, sf, "orders"))["numeric"])
