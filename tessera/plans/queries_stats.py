"""Registered queries: statistics (Q-1, H-2, H-6..H-8) and profiling (Q-*, V-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as prof
from ..operators import stats
from ..sources.tables import read_table
from .catalog import register, rounded

LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {table}" for c in cols)


# ------------------------------------------------------------------ Q-1
COL_STATS_SQL = """
WITH long AS ({long}), v AS (SELECT * FROM long WHERE value IS NOT NULL)
, m AS (SELECT "column", count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std,
               min(value) AS mn, max(value) AS mx,
               skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS skew,
               kurtosis_pop(value) AS kurt,
               quantile_cont(value, 0.10) AS p10, quantile_cont(value, 0.25) AS q1,
               quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3,
               quantile_cont(value, 0.90) AS p90 FROM v GROUP BY "column")
, o AS (SELECT v."column", count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM v JOIN m ON v."column" = m."column" GROUP BY v."column")
SELECT m."column", CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(median, 6) AS median,
       round(std, 6) AS std, round(CASE WHEN mean <> 0 THEN std / abs(mean) ELSE 0.0 END, 6) AS cv,
       round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(mn, 6) AS "min",
       round(mx, 6) AS "max", round(skew, 6) AS skew, round(kurt, 6) AS kurtosis,
       CAST(outliers AS BIGINT) AS outliers, round(outliers * 100.0 / n, 6) AS outlier_pct,
       round(p10, 6) AS p10, round(p90, 6) AS p90
FROM m JOIN o ON m."column" = o."column" WHERE n >= 3"""


@register("Q1_col_stats_lineitem", COL_STATS_SQL.format(long=_long_sql("lineitem", LINEITEM_NUM)))
def q_q1(spark, sf):
    return rounded(stats.col_stats(read_table(spark, sf, "lineitem"), LINEITEM_NUM))


@register("Q1_col_stats_orders_customer_mix", COL_STATS_SQL.format(
    long=_long_sql("orders", ["o_totalprice", "o_custkey"])))
def q_q1b(spark, sf):
    return rounded(stats.col_stats(read_table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]))


# ------------------------------------------------------------------ H-7 / H-8
@register("H7_zscore_outliers_lineitem", """
WITH long AS ({long}), v AS (SELECT * FROM long WHERE value IS NOT NULL)
, m AS (SELECT "column", avg(value) AS mean, stddev_samp(value) AS std FROM v GROUP BY "column")
SELECT v."column", CAST(count(*) FILTER (WHERE std > 0 AND abs(value - mean) > 3 * std) AS BIGINT) AS outliers_zscore
FROM v JOIN m ON v."column" = m."column" GROUP BY v."column" """.format(
    long=_long_sql("lineitem", LINEITEM_NUM)))
def q_h7(spark, sf):
    return stats.zscore_outliers(read_table(spark, sf, "lineitem"), LINEITEM_NUM)


@register("H8_modified_zscore_outliers", """
WITH long AS ({long}), v AS (SELECT * FROM long WHERE value IS NOT NULL)
, m AS (SELECT "column", quantile_cont(value, 0.5) AS median FROM v GROUP BY "column")
, d AS (SELECT v."column", value, median, abs(value - median) AS dev FROM v JOIN m ON v."column" = m."column")
, mad AS (SELECT "column", quantile_cont(dev, 0.5) AS mad FROM d GROUP BY "column")
SELECT d."column", round(any_value(median), 6) AS median, round(mad, 6) AS mad,
       CAST(count(*) FILTER (WHERE mad <> 0 AND abs(0.6745 * (value - median) / mad) > 3.5) AS BIGINT) AS outliers_modz
FROM d JOIN mad ON d."column" = mad."column" GROUP BY d."column", mad""".format(
    long=_long_sql("orders", ["o_totalprice"]) + " UNION ALL " + _long_sql("customer", ["c_acctbal"])))
def q_h8(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_totalprice"))
    c = read_table(spark, sf, "customer").select(F.col("c_acctbal"))
    both = o.select("o_totalprice", F.lit(None).cast("double").alias("c_acctbal")).unionByName(
        c.select(F.lit(None).cast("double").alias("o_totalprice"), "c_acctbal"))
    return rounded(stats.modified_z_outliers(both, ["o_totalprice", "c_acctbal"]))


# ------------------------------------------------------------------ H-2
@register("H2_dagostino_k2_lineitem", """
WITH long AS ({long}), v AS (SELECT * FROM long WHERE value IS NOT NULL)
, m AS (SELECT "column", CAST(count(*) AS DOUBLE) AS n,
               skewness(value) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS g1,
               kurtosis_pop(value) AS g2 FROM v GROUP BY "column")
, a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y,
               3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
               g2 + 3.0 AS b2, 3.0 * (n - 1) / (n + 1) AS e,
               24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS varb2,
               6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3))) AS sb1
        FROM m WHERE n >= 8)
, b AS (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, (b2 - e) / sqrt(varb2) AS x,
               6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS aa FROM a)
, c AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS alpha,
               1 - 2 / (9.0 * aa) AS term1, 1 + x * sqrt(2 / (aa - 4.0)) AS denom FROM b)
, z AS (SELECT "column", n, delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) AS z1,
               (term1 - sign(denom) * pow(abs((1 - 2.0 / aa) / denom), 1 / 3.0)) / sqrt(2 / (9.0 * aa)) AS z2 FROM c)
SELECT "column", CAST(n AS BIGINT) AS n, round(z1, 6) AS z_skew, round(z2, 6) AS z_kurt,
       round(z1 * z1 + z2 * z2, 6) AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value FROM z""".format(
    long=_long_sql("lineitem", LINEITEM_NUM)))
def q_h2(spark, sf):
    return rounded(stats.dagostino_k2(read_table(spark, sf, "lineitem"), LINEITEM_NUM))


# ------------------------------------------------------------------ Q-3 profile
_ID_KW = prof.ID_NAME_KEYWORDS
_VAL_KW = prof.VALUE_NAME_KEYWORDS
_URL_KW = prof.URL_NAME_KEYWORDS

CUSTOMER_COLS = [("c_custkey", "numeric", "int64"), ("c_name", "string", "object"),
                 ("c_nationkey", "numeric", "int32"), ("c_acctbal", "numeric", "float64"),
                 ("c_mktsegment", "string", "object")]
ORDERS_COLS = [("o_orderkey", "numeric", "int64"), ("o_custkey", "numeric", "int64"),
               ("o_orderstatus", "string", "object"), ("o_totalprice", "numeric", "float64"),
               ("o_orderdate", "datetime", "datetime64[ns]"), ("o_orderpriority", "string", "object")]


def profile_sql(table: str, cols) -> str:
    parts = []
    for c, kind, dtype in cols:
        low = c.lower()
        idn = any(k in low for k in _ID_KW)
        valn = any(k in low for k in _VAL_KW)
        urln = any(k in low for k in _URL_KW)
        norm = f"CASE WHEN {c} = 0 THEN 0.0 ELSE {c} END" if dtype.startswith("float") else c
        num = kind == "numeric"
        outl = (f"""(SELECT count(*) FILTER (WHERE x < q25 - 1.5 * (q75 - q25) OR x > q75 + 1.5 * (q75 - q25)) AS outliers
      FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {table} WHERE {c} IS NOT NULL),
           (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25,
                   quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75 FROM {table}))"""
                if num else "(SELECT 0 AS outliers)")
        stats_sel = (f"""(SELECT avg(x) FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {table} WHERE {c} IS NOT NULL))""")
        inferred = f"""CASE WHEN u <= 1 THEN 'constant'
            WHEN {'TRUE' if kind == 'datetime' else 'FALSE'} THEN 'datetime'
            WHEN {'TRUE' if num else 'FALSE'} THEN
                CASE WHEN u = 2 THEN 'binary'
                     WHEN u / greatest(n, 1.0) > 0.95 AND n > 50 AND {idn} AND NOT {valn} THEN 'id'
                     ELSE 'numeric' END
            WHEN u / greatest(n, 1.0) > 0.85 AND n > 50 THEN
                CASE WHEN {urln} THEN 'id' WHEN avg_len < 20 THEN 'id' ELSE 'text' END
            WHEN u <= 50 THEN 'categorical' ELSE 'text' END"""
        parts.append(f"""
SELECT '{c}' AS "column", '{dtype}' AS dtype, n, missing, u, top_cnt, top_value, avg_len,
       {inferred} AS inferred_type, st.*, o.outliers,
       {'CAST(min_d AS VARCHAR)' if kind == 'datetime' else 'CAST(NULL AS VARCHAR)'} AS min_date,
       {'CAST(max_d AS VARCHAR)' if kind == 'datetime' else 'CAST(NULL AS VARCHAR)'} AS max_date,
       {"CAST(date_diff('day', CAST(min_d AS DATE), CAST(max_d AS DATE)) AS INTEGER)" if kind == 'datetime' else 'CAST(NULL AS INTEGER)'} AS date_range_days,
       {'TRUE' if num else 'FALSE'} AS is_numkind
FROM (SELECT count(*) AS n, count(*) - count({c}) AS missing,
             {'avg(length(' + c + '))' if kind == 'string' else 'CAST(NULL AS DOUBLE)'} AS avg_len,
             {'min(' + c + ')' if kind == 'datetime' else 'NULL'} AS min_d,
             {'max(' + c + ')' if kind == 'datetime' else 'NULL'} AS max_d FROM {table}) a,
     (SELECT count(*) AS u, max(cnt) AS top_cnt,
             min(value) FILTER (WHERE cnt = (SELECT max(cnt) FROM (SELECT count(*) AS cnt FROM {table} WHERE {c} IS NOT NULL GROUP BY {norm}))) AS top_value
      FROM (SELECT CAST({norm} AS VARCHAR) AS value, count(*) AS cnt FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)) b,
     (SELECT {'avg(x)' if num else 'NULL'} AS mean, {'quantile_cont(x, 0.5)' if num else 'NULL'} AS median,
             {'stddev_samp(x)' if num else 'NULL'} AS std, {'min(x)' if num else 'NULL'} AS min_val,
             {'max(x)' if num else 'NULL'} AS max_val, {'quantile_cont(x, 0.25)' if num else 'NULL'} AS q25,
             {'quantile_cont(x, 0.75)' if num else 'NULL'} AS q75,
             {'skewness(x) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))' if num else 'NULL'} AS skewness,
             count(*) AS nn FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {table} WHERE {c} IS NOT NULL)) st,
     {outl} o""")
    body = " UNION ALL ".join(parts)
    return f"""
WITH p AS ({body})
, q AS (SELECT *, inferred_type IN ('numeric', 'binary') AND is_numkind AS is_num,
               inferred_type IN ('categorical', 'id', 'text', 'constant') AS is_cat,
               round_even(missing / greatest(n, 1.0) * 100.0, 1) AS missing_pct FROM p)
, r AS (SELECT *, CASE WHEN is_num THEN coalesce(outliers, 0) ELSE 0 END AS outlier_count,
               CASE WHEN is_num AND nn >= 3 THEN round_even(outliers * 100.0 / nn, 1) ELSE 0.0 END AS outlier_pct FROM q)
, s AS (SELECT *, 100.0 - missing_pct / 100.0 * 50.0
                  - CASE WHEN outlier_count > 0 THEN least(outlier_pct * 0.5, 15.0) ELSE 0.0 END
                  - CASE WHEN u <= 1 AND n > 1 THEN 20.0 ELSE 0.0 END AS raw_score FROM r)
SELECT "column", dtype, inferred_type, CAST(n AS BIGINT) AS n_rows, CAST(missing AS BIGINT) AS missing_count,
       missing_pct, CAST(u AS BIGINT) AS unique_count,
       round_even(u / greatest(n, 1.0) * 100.0, 1) AS unique_pct,
       inferred_type = 'id' AS is_id_like, inferred_type = 'constant' AS is_constant,
       round(CASE WHEN is_num THEN mean END, 6) AS mean, round(CASE WHEN is_num THEN median END, 6) AS median,
       round(CASE WHEN is_num THEN std END, 6) AS std, round(CASE WHEN is_num THEN min_val END, 6) AS min_val,
       round(CASE WHEN is_num THEN max_val END, 6) AS max_val, round(CASE WHEN is_num THEN q25 END, 6) AS q25,
       round(CASE WHEN is_num THEN q75 END, 6) AS q75, round(CASE WHEN is_num THEN skewness END, 6) AS skewness,
       CAST(outlier_count AS BIGINT) AS outlier_count, outlier_pct,
       CASE WHEN is_cat THEN top_value END AS top_value,
       CASE WHEN is_cat AND top_cnt IS NOT NULL THEN round_even(top_cnt / greatest(n - missing, 1.0) * 100.0, 1) END AS top_value_pct,
       min_date, max_date, date_range_days,
       greatest(0.0, round_even(CASE WHEN inferred_type = 'id' THEN least(raw_score, 80.0) ELSE raw_score END, 1)) AS quality_score
FROM s"""


_PROFILE_SCALARS = ["column", "dtype", "inferred_type", "n_rows", "missing_count", "missing_pct",
                    "unique_count", "unique_pct", "is_id_like", "is_constant", "mean", "median",
                    "std", "min_val", "max_val", "q25", "q75", "skewness", "outlier_count",
                    "outlier_pct", "top_value", "top_value_pct", "min_date", "max_date",
                    "date_range_days", "quality_score"]


@register("Q3_column_profile_customer", profile_sql("customer", CUSTOMER_COLS))
def q_q3_customer(spark, sf):
    return rounded(prof.column_profiles(read_table(spark, sf, "customer")).select(*_PROFILE_SCALARS))


@register("Q3_column_profile_orders", profile_sql("orders", ORDERS_COLS))
def q_q3_orders(spark, sf):
    return rounded(prof.column_profiles(read_table(spark, sf, "orders")).select(*_PROFILE_SCALARS))


# ------------------------------------------------------------------ H-3 / H-4 / H-5 / E-1
from ..operators import distribution as dist  # noqa: E402


@register("H3_anderson_darling_lineitem")
def q_h3(spark, sf):
    return rounded(dist.anderson_darling(read_table(spark, sf, "lineitem"), LINEITEM_NUM))


@register("H5_distribution_fits_ks")
def q_h5(spark, sf):
    return rounded(dist.fit_distributions(read_table(spark, sf, "orders"), ["o_totalprice"]).unionByName(
        dist.fit_distributions(read_table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])))


@register("H4_normality_consensus_lineitem")
def q_h4(spark, sf):
    return rounded(dist.normality_consensus(read_table(spark, sf, "lineitem"), LINEITEM_NUM))


@register("E1_univariate_orders_customer")
def q_e1(spark, sf):
    return rounded(dist.univariate(read_table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]))
