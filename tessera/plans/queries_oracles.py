"""Oracle SQL attached to queries registered elsewhere (statistics forms,
profile-derived tables, verdicts)."""

from __future__ import annotations

from .catalog import attach_oracle
from .queries_corr import spearman_sql
from .queries_stats import profile_sql
from .views import with_views


def _effect(r: str = "r") -> str:
    return (f"CASE WHEN abs({r}) >= 0.5 THEN 'large' WHEN abs({r}) >= 0.3 THEN 'medium' "
            f"WHEN abs({r}) >= 0.1 THEN 'small' ELSE 'negligible' END AS effect")


# C-3 / C-6 / C-7: Spearman forms ------------------------------------------------
_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
attach_oracle("C3_bivariate_effect_labels_lineitem",
              "WITH src AS (SELECT * FROM lineitem)" + spearman_sql("src", _LI, False).replace(
                  "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction",
                  "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, " + _effect()))
attach_oracle("C6_spearman_matrix_orders",
              "WITH src AS (SELECT * FROM orders)" + spearman_sql("src", ["o_totalprice", "o_custkey", "o_orderkey"], False))
attach_oracle("C7_discount_rating_verdict", with_views(spearman_sql("ecommerce", ["discount", "rating"], False).replace(
    "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction",
    "CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, "
    "CASE WHEN abs(r) > 0.15 THEN 'discounts move ratings' ELSE 'no meaningful link' END AS verdict"), "ecommerce"))

# Q-10 analytical flags ------------------------------------------------------------
attach_oracle("Q10_analytical_flags_lineitem", """
WITH long AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM lineitem" for c in _LI) + """)
, v AS (SELECT * FROM long WHERE v IS NOT NULL)
, s AS (SELECT "column", count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std,
               skewness(v) AS g1a, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1)
, o AS (SELECT v."column", count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS out FROM v JOIN s USING ("column") GROUP BY 1)
, f AS (SELECT s.*, CASE WHEN mean <> 0 THEN std / abs(mean) ELSE 0.0 END * 100.0 AS cvp, out * 100.0 / n AS op FROM s JOIN o USING ("column"))
SELECT "column", round(mean, 6) AS mean, round(median, 6) AS median, round(cvp, 6) AS cv_pct, round(g1a, 6) AS skew_G1,
       round(op, 6) AS outlier_pct,
       CASE WHEN cvp > 80 THEN 'highly variable' WHEN abs(g1a) > 1.5 THEN 'skewed' WHEN op > 5 THEN 'outliers'
            WHEN cvp < 15 THEN 'stable' ELSE 'normal' END AS flag FROM f WHERE n >= 3""")

# Q-14 verdicts ---------------------------------------------------------------------
_MESSY_COLS = ["l_returnflag", "linenumber", "l_quantity", "l_tax", "sparse_discount", "source", "returned_flag",
               "status_or_null"]
_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _verdict_sql(name: str, table: str, cols: list[str]) -> str:
    miss = " + ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)" for c in cols)
    return f"""SELECT '{name}' AS "table", mp AS missing_pct, dp AS duplicate_pct,
       CASE WHEN mp < 1 AND dp < 1 THEN 'GOOD' WHEN mp < 5 AND dp < 5 THEN 'FAIR' ELSE 'POOR' END AS verdict
FROM (SELECT round(({miss}) / {len(cols)} * 100.0, 6) AS mp,
             round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table}))) * 100.0 / count(*), 6) AS dp FROM {table})"""


attach_oracle("Q14_data_quality_verdict_tables", with_views(
    "\n" + _verdict_sql("orders", "orders", _ORDERS_COLS) + "\nUNION ALL\n" +
    _verdict_sql("messy_lineitem", "messy", _MESSY_COLS), "messy").replace("WITH messy AS", "WITH messy AS", 1))

# N-21 (same operator as W-4 on the finance view) ------------------------------------
from .catalog import ORACLE  # noqa: E402

attach_oracle("N21_revenue_trend_halves_finance", ORACLE["W4_halves_trend_finance_revenue"])

# P-7 equal-width bins ----------------------------------------------------------------
attach_oracle("P7_equal_width_20_bins_mean_revenue", with_views("""
, mm AS (SELECT min(price) AS lo, max(price) AS hi FROM ecommerce)
SELECT CAST(least(greatest(CAST(ceil((price - lo) / ((hi - lo) / 20)) AS BIGINT) - 1, 0), 19) AS BIGINT) AS bin,
       CAST(count(*) AS BIGINT) AS n, round(avg(revenue), 6) AS mean_revenue FROM ecommerce, mm GROUP BY 1""", "ecommerce"))

# D-11 trend facts ---------------------------------------------------------------------
attach_oracle("D11_trend_facts_monthly_order_price", """
WITH m AS (SELECT last_day(o_orderdate) AS p, avg(o_totalprice) AS v FROM orders
           WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1)
, o AS (SELECT v, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM m)
, a AS (SELECT avg(v) FILTER (i <= n // 2) AS f, avg(v) FILTER (i > n // 2) AS l, count(*) AS n FROM o)
, c AS (SELECT *, (l - f) * 100.0 / greatest(abs(f), 0.001) AS chg FROM a)
SELECT round(f, 6) AS first_half, round(l, 6) AS second_half, CAST(n AS BIGINT) AS n_periods, round(chg, 6) AS change_pct,
       CASE WHEN chg > 2 THEN 'improved' WHEN chg < -2 THEN 'declined' ELSE 'stable' END AS direction FROM c""")

# A-14 page form: its text column uses %g formatting, which differs between the
# JVM and C printf, so it keeps the rows-only check (the engine form has an oracle).

# B-6 Pareto of margin by region (run_bi picks sum for 'margin') ----------------------------
attach_oracle("B6_run_bi_sales_pareto", with_views("""
, g AS (SELECT CAST(region AS VARCHAR) AS name, sum(margin) AS value FROM sales WHERE region IS NOT NULL GROUP BY 1)
, r AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS rn,
               sum(value) OVER (ORDER BY value DESC, name ROWS UNBOUNDED PRECEDING) AS cum,
               sum(value) OVER () AS total, count(*) OVER () AS n FROM g)
, k AS (SELECT greatest(1, CAST(ceil(n * 20 / 100.0) AS BIGINT)) AS k, any_value(total) AS total FROM r GROUP BY n)
, s AS (SELECT sum(value) * 100.0 / any_value(k.total) AS share FROM r, k WHERE rn <= k.k)
SELECT CAST(rn AS BIGINT) AS rank, name, round(value, 6) AS value, round(value * 100.0 / r.total, 6) AS pct_of_total,
       round(cum * 100.0 / r.total, 6) AS cumulative_pct, rn <= k.k AS in_top_20, round(s.share, 6) AS top_groups_share,
       s.share >= 60 AS pareto_holds FROM r, k, s""", "sales"))

# M-1 task detection (types are fixed by the HR view) -------------------------------------
attach_oracle("M1_detect_task_hr_columns", with_views("""
, u AS (SELECT count(DISTINCT "left") AS u_left, count(DISTINCT dept) AS u_dept, count(DISTINCT projects) AS u_proj,
               count(projects) AS n_proj, count(DISTINCT satisfaction) AS u_sat, count(satisfaction) AS n_sat,
               count(DISTINCT hours) AS u_hours, count(hours) AS n_hours FROM hr)
SELECT 'left' AS "column", 'classification' AS task, 'Binary target (2 unique values)' AS reason FROM u WHERE u_left = 2
UNION ALL SELECT 'dept', 'classification', printf('Categorical target (%d classes)', u_dept) FROM u
UNION ALL SELECT 'projects', 'classification', printf('Discrete integer target (%d unique values)', u_proj) FROM u
UNION ALL SELECT 'satisfaction', 'regression', printf('Continuous numeric target (%d unique values, %.1f%% unique)', u_sat, u_sat * 100.0 / n_sat) FROM u
UNION ALL SELECT 'hours', 'regression', printf('Continuous numeric target (%d unique values, %.1f%% unique)', u_hours, u_hours * 100.0 / n_hours) FROM u""", "hr"))

# Q-9 / Q-16 from the profile of the messy view ---------------------------------------------
_MESSY_KINDS = [("l_returnflag", "string", "object"), ("linenumber", "numeric", "int32"),
                ("l_quantity", "numeric", "float64"), ("l_tax", "numeric", "float64"),
                ("sparse_discount", "numeric", "float64"), ("source", "string", "object"),
                ("returned_flag", "string", "object"), ("status_or_null", "string", "object")]
_PROF = f", prof AS ({profile_sql('messy', _MESSY_KINDS)})"

attach_oracle("Q9_column_status_messy", with_views(_PROF + """
SELECT "column", missing_pct,
       CASE WHEN missing_pct > 20 THEN 'HIGH MISSING' WHEN missing_pct > 5 THEN 'REVIEW'
            WHEN unique_count = 1 THEN 'CONSTANT' WHEN unique_count = n_rows THEN 'ID COL' ELSE 'OK' END AS status
FROM prof""", "messy"))

attach_oracle("Q16_compute_health_messy", with_views(_PROF + f"""
, tot AS (SELECT count(*) AS rows_, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS dups FROM messy)
, agg AS (SELECT sum(missing_count) AS mc, avg(quality_score) AS ch, avg(outlier_pct) AS op,
                 avg(CASE WHEN outlier_count > 0 THEN 1.0 ELSE 0.0 END) * 100.0 AS ocp FROM prof)
, sc AS (SELECT round_even((1.0 - mc / CAST(rows_ * {len(_MESSY_KINDS)} AS DOUBLE)) * 100.0 * 0.6
                           + (1.0 - dups / CAST(rows_ AS DOUBLE)) * 100.0 * 0.3 + ch * 0.1, 1) AS score,
                round_even(mc / CAST(rows_ * {len(_MESSY_KINDS)} AS DOUBLE) * 100.0, 1) AS missing_pct,
                round_even(dups / CAST(rows_ AS DOUBLE) * 100, 1) AS duplicate_pct, op, ocp FROM agg, tot)
SELECT round(score, 6) AS score,
       CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade,
       round(missing_pct, 6) AS missing_pct, round(duplicate_pct, 6) AS duplicate_pct, round(op, 6) AS outlier_pct,
       round(ocp, 6) AS outlier_col_pct FROM sc""", "messy"))

# A-3 describe_column ------------------------------------------------------------------------
attach_oracle("A3_describe_column_dispatch", """
SELECT 'l_extendedprice' AS "column", 'double' AS type, CAST(count(*) AS BIGINT) AS n, CAST(count(l_extendedprice) AS BIGINT) AS non_null,
       CAST(count(DISTINCT l_extendedprice) AS BIGINT) AS "unique", round(avg(l_extendedprice), 6) AS mean,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(stddev_samp(l_extendedprice), 6) AS std,
       round(min(l_extendedprice), 6) AS "min", round(max(l_extendedprice), 6) AS "max" FROM lineitem""")

# P-4 head (file order of a single parquet file) -----------------------------------------------
attach_oracle("P4_head_preview_lineitem", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus FROM lineitem LIMIT 5""")

# V-1 validation checks -------------------------------------------------------------------------
_MESSY_MISSING = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _MESSY_COLS)
attach_oracle("V1_validate_messy_lineitem", with_views(f"""
, a AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST({_MESSY_MISSING} AS DOUBLE) AS miss,
               CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM messy)) AS DOUBLE) AS dups,
               CAST(count(*) FILTER (WHERE coalesce({", ".join(f"CAST({c} AS VARCHAR)" for c in _MESSY_COLS)}) IS NULL) AS DOUBLE) AS anr,
               CAST(count(*) FILTER (WHERE abs(l_quantity) = 'inf'::DOUBLE) + count(*) FILTER (WHERE abs(l_tax) = 'inf'::DOUBLE)
                    + count(*) FILTER (WHERE abs(sparse_discount) = 'inf'::DOUBLE) AS DOUBLE) AS infs FROM messy)
, c AS (SELECT *, miss / (n * 8) * 100 AS mpct FROM a)
SELECT 'empty' AS "check", 'error' AS severity, round(n, 6) AS value, n > 0 AS passed, '' AS message FROM c
UNION ALL SELECT 'no_columns', 'error', 8.0, true, '' FROM c
UNION ALL SELECT 'min_rows', 'error', round(n, 6), n >= 2, '' FROM c
UNION ALL SELECT 'max_cols', 'error', 8.0, true, '' FROM c
UNION ALL SELECT 'max_rows', 'error', round(n, 6), n <= 1000000, CASE WHEN n <= 1000000 THEN '' ELSE printf('%d rows exceeds 1000000', CAST(n AS BIGINT)) END FROM c
UNION ALL SELECT 'all_columns_empty', 'error', 8.0, true, '' FROM c
UNION ALL SELECT 'missing_cells_pct', 'warning', round(mpct, 6), mpct <= 20,
                 CASE WHEN mpct > 50 THEN 'very high missing' WHEN mpct > 20 THEN 'high missing' ELSE '' END FROM c
UNION ALL SELECT 'all_null_rows', 'warning', round(anr, 6), anr = 0,
                 CASE WHEN anr > 0 THEN printf('%d completely empty rows', CAST(anr AS BIGINT)) ELSE '' END FROM c
UNION ALL SELECT 'duplicate_rows', 'warning', round(dups, 6), dups = 0,
                 CASE WHEN dups > 0 THEN printf('%d duplicate rows (%.1f%%)', CAST(dups AS BIGINT), dups / n * 100) ELSE '' END FROM c
UNION ALL SELECT 'duplicate_rows_pct', 'warning', round(dups / n * 100, 6), dups = 0, '' FROM c
UNION ALL SELECT 'bad_column_names', 'warning', 0.0, true, '' FROM c
UNION ALL SELECT 'infinite_values', 'warning', round(infs, 6), infs = 0, '' FROM c""", "messy"))

# M-2 suggest targets ---------------------------------------------------------------------------
attach_oracle("M2_suggest_targets_hr", with_views("""
, s AS (SELECT count(DISTINCT "left") AS u_left, count("left") AS n_left, count(DISTINCT dept) AS u_dept, count(dept) AS n_dept,
               count(DISTINCT salary) AS u_sal, count(salary) AS n_sal, count(DISTINCT projects) AS u_proj, count(projects) AS n_proj,
               count(DISTINCT satisfaction) AS u_sat, count(satisfaction) AS n_sat,
               stddev_samp(satisfaction) / abs(avg(satisfaction)) AS cv_sat FROM hr)
, top AS (SELECT (SELECT max(c) FROM (SELECT count(*) AS c FROM hr WHERE "left" IS NOT NULL GROUP BY "left")) AS t_left,
                 (SELECT max(c) FROM (SELECT count(*) AS c FROM hr WHERE dept IS NOT NULL GROUP BY dept)) AS t_dept,
                 (SELECT max(c) FROM (SELECT count(*) AS c FROM hr WHERE salary IS NOT NULL GROUP BY salary)) AS t_sal,
                 (SELECT max(c) FROM (SELECT count(*) AS c FROM hr WHERE projects IS NOT NULL GROUP BY projects)) AS t_proj)
SELECT 'left' AS "column", 'classification' AS task, 'Binary target (2 unique values)' AS reason, round(1 - t_left / n_left, 6) AS score FROM s, top
UNION ALL SELECT 'dept', 'classification', printf('Categorical target (%d classes)', u_dept), round(1 - t_dept / n_dept, 6) FROM s, top
UNION ALL SELECT 'salary', 'classification', printf('Categorical target (%d classes)', u_sal), round(1 - t_sal / n_sal, 6) FROM s, top
UNION ALL SELECT 'projects', 'classification', printf('Discrete integer target (%d unique values)', u_proj), round(1 - t_proj / n_proj, 6) FROM s, top
UNION ALL SELECT 'satisfaction', 'regression', printf('Continuous numeric target (%d unique values, %.1f%% unique)', u_sat, u_sat * 100.0 / n_sat),
                 round(least(cv_sat, 1.0), 6) FROM s, top""", "hr"))


# E-5 / E-6 numeric statistics --------------------------------------------------------------------
# Shapiro-Wilk of columns with 12 to 5000 values: Royston's weights over normal scores (Acklam's inverse normal),
# p > 0.05 decided by the normal score of ln(1 - W) against 1.6448536269514722
_TAIL = ("((((({c}0.007784894002430293 * q - 0.3223964580411365) * q - 2.400758277161838) * q - 2.549732539343734) * q + 4.374664141464968) * q "
         "+ 2.938163982698783) / ((((0.007784695709041462 * q + 0.3224671290700398) * q + 2.445134137142996) * q + 3.754408661907416) * q + 1)")
SHAPIRO_SQL = f'''
, sr AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) AS i, CAST(count(*) OVER (PARTITION BY "column") AS DOUBLE) AS n
         FROM x QUALIFY count(*) OVER (PARTITION BY "column") BETWEEN 12 AND 5000)
, sp AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM sr)
, sq AS (SELECT *, CASE WHEN least(p, 1 - p) < 0.02425 THEN sqrt(-2 * ln(least(p, 1 - p))) ELSE p - 0.5 END AS q FROM sp)
, sm AS (SELECT *, CASE WHEN least(p, 1 - p) < 0.02425 THEN CASE WHEN p < 0.5 THEN 1 ELSE -1 END * {_TAIL.format(c="-")}
    ELSE (((((-39.69683028665376 * q * q + 220.9460984245205) * q * q - 275.9285104469687) * q * q + 138.3577518672690) * q * q - 30.66479806614716) * q * q
          + 2.506628277459239) * q / (((((-54.47609879822406 * q * q + 161.5858368580409) * q * q - 155.6989798598866) * q * q + 66.80131188771972) * q * q
          - 13.28068155288572) * q * q + 1) END AS m FROM sq)
, st AS (SELECT "column", n, sum(m * m) AS mm, min(m) AS m1, min(m) FILTER (WHERE i = 2) AS m2 FROM sm GROUP BY ALL)
, sa AS (SELECT *, m1 / sqrt(mm) AS c1, m2 / sqrt(mm) AS c2, 1 / sqrt(n) AS r FROM st)
, sb AS (SELECT *, (0.221157 + (-0.147981 + (-2.07119 + (4.434685 - 2.706056 * r) * r) * r) * r) * r - c1 AS a1,
                (0.042981 + (-0.293762 + (-1.752461 + (5.682633 - 3.582633 * r) * r) * r) * r) * r - c2 AS a2 FROM sa)
, sw AS (SELECT "column", (ln(1 - w) - mu) / sigma < 1.6448536269514722 AS sw_normal FROM (
    SELECT "column", n, pow(sum(weight * v), 2) / any_value(ss) AS w,
           -1.5861 + (-0.31082 + (-0.083751 + 0.0038915 * ln(n)) * ln(n)) * ln(n) AS mu,
           exp(-0.4803 + (-0.082676 + 0.0030302 * ln(n)) * ln(n)) AS sigma
    FROM (SELECT sm."column", sm.n, sm.v, var_pop(sm.v) OVER (PARTITION BY sm."column") * sm.n AS ss,
                 CASE WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 WHEN i = sm.n THEN a1 WHEN i = sm.n - 1 THEN a2
                      ELSE m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS weight
          FROM sm JOIN sb USING ("column")) GROUP BY ALL))'''


def _numeric_stats_sql(table: str, cols: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM {table}" for c in cols)
    g1 = "skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0))"
    return f"""
WITH long AS ({long}), x AS (SELECT * FROM long WHERE v IS NOT NULL)
, m AS (SELECT "column", CAST(count(*) AS DOUBLE) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std,
               min(v) AS mn, max(v) AS mx, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
               {g1} AS g1, kurtosis_pop(v) AS g2 FROM x GROUP BY 1)
, o AS (SELECT x."column", count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM x JOIN m USING ("column") GROUP BY 1)
, zs AS (SELECT x."column", count(*) FILTER (WHERE std > 0 AND abs(v - mean) > 3 * std) AS outliers_zscore
         FROM x JOIN m USING ("column") GROUP BY 1)
{SHAPIRO_SQL}
, a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y,
               3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
               g2 + 3.0 AS b2, 3.0 * (n - 1) / (n + 1) AS e,
               24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS varb2,
               6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3))) AS sb1
        FROM m)
, b AS (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, (b2 - e) / sqrt(varb2) AS xx,
               6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS aa FROM a)
, c AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS alpha, 1 - 2 / (9.0 * aa) AS term1,
               1 + xx * sqrt(2 / (aa - 4.0)) AS denom FROM b)
, z AS (SELECT *, delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) AS z1,
               (term1 - sign(denom) * pow(abs((1 - 2.0 / aa) / denom), 1 / 3.0)) / sqrt(2 / (9.0 * aa)) AS z2 FROM c)
, k AS (SELECT *, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) AS adj2,
               g1 * sqrt(n * (n - 1)) / (n - 2) AS adj1 FROM z)
SELECT k."column", CAST(n AS BIGINT) AS n, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std,
       round(mn, 4) AS "min", round(mx, 4) AS "max", round(q1, 4) AS q1, round(q3, 4) AS q3, round(adj1, 4) AS skewness,
       CASE WHEN abs(adj1) < 0.5 THEN 'approximately symmetric'
            WHEN abs(adj1) < 1.0 THEN CASE WHEN adj1 > 0 THEN 'moderately right-skewed' ELSE 'moderately left-skewed' END
            ELSE CASE WHEN adj1 > 0 THEN 'highly right-skewed' ELSE 'highly left-skewed' END END AS skew_label,
       round(adj2, 4) AS kurtosis,
       CASE WHEN adj2 > 1 THEN 'leptokurtic (heavy tails)' WHEN adj2 < -1 THEN 'platykurtic (light tails)'
            ELSE 'mesokurtic (normal-like tails)' END AS kurtosis_label,
       CASE WHEN n <= 5000 THEN 'Shapiro-Wilk' ELSE 'D''Agostino-Pearson' END AS normality_test,
       CASE WHEN n <= 5000 THEN sw_normal ELSE exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 END AS is_normal, CAST(outliers AS BIGINT) AS outliers,
       round(outliers * 100.0 / n, 6) AS outlier_pct, CAST(outliers_zscore AS BIGINT) AS outliers_zscore,
       CASE WHEN CASE WHEN n <= 5000 THEN sw_normal ELSE exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 END THEN 'Z-Score' ELSE 'IQR' END AS outlier_method
FROM k JOIN o USING ("column") JOIN zs USING ("column") LEFT JOIN sw USING ("column") WHERE n >= 3"""


attach_oracle("E6_numeric_stats_lineitem", _numeric_stats_sql("lineitem", _LI))
attach_oracle("E5_stats_analyze_numeric_orders", _numeric_stats_sql("orders", ["o_totalprice", "o_custkey"]))
attach_oracle("E6_numeric_stats_customer_shapiro", _numeric_stats_sql("customer", ["c_acctbal", "c_custkey", "c_nationkey"]))


# D-7 anomalies -------------------------------------------------------------------------------------
def _anomaly_sql(table: str, cols: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM {table}" for c in cols)
    return f"""
SELECT * FROM (
  WITH long AS ({long}), x AS (SELECT * FROM long WHERE v IS NOT NULL)
  , s AS (SELECT "column", count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
                 quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
                 skewness(v) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS skew FROM x GROUP BY 1)
  , o AS (SELECT x."column", count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) * 100.0 / any_value(n) AS op
          FROM x JOIN s USING ("column") GROUP BY 1)
  , m AS (SELECT "column", avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) * 100.0 AS mp FROM long GROUP BY 1)
  , j AS (SELECT * FROM s JOIN o USING ("column") JOIN m USING ("column") WHERE n >= 3)
  SELECT "column", 'outliers' AS kind, printf('''%s'' has %.1f%% outliers — normal range %.2f–%.2f. Validate before modelling.',
         "column", op, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) AS text FROM j WHERE op > 10
  UNION ALL SELECT "column", 'skew', printf('''%s'' heavily skewed (skew=%.2f). Median %.2f more reliable than mean %.2f.',
         "column", skew, median, mean) FROM j WHERE abs(skew) > 2
  UNION ALL SELECT "column", 'missing', printf('''%s'' is %.1f%% missing — imputed values may affect results.', "column", mp)
         FROM j WHERE mp > 20)"""


attach_oracle("D7_anomalies_messy_and_orders", with_views(
    "\n" + _anomaly_sql("messy", ["linenumber", "l_quantity", "sparse_discount"]) + "\nUNION ALL\n" +
    _anomaly_sql("customer", ["c_acctbal"]), "messy"))


# D-4 column roles of orders (name rules are schema-only; uniqueness and the
# consecutive-difference test are computed) --------------------------------------------------------
def _consecutive_ratio_sql(col: str) -> str:
    return f"""(SELECT avg(CASE WHEN d = 1 THEN 1.0 ELSE 0.0 END) FROM (
              SELECT v - lag(v) OVER (ORDER BY v) AS d FROM (SELECT CAST({col} AS DOUBLE) AS v FROM orders WHERE {col} IS NOT NULL))
            WHERE d IS NOT NULL)"""


attach_oracle("D4_column_roles_orders", f"""
WITH u AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS uk, count(DISTINCT o_custkey) AS uc,
                  count(DISTINCT o_orderstatus) AS us, count(DISTINCT o_totalprice) AS up,
                  count(DISTINCT o_orderdate) AS ud, count(DISTINCT o_orderpriority) AS uo FROM orders)
SELECT 'o_orderkey' AS "column",
       CASE WHEN uk / n > 0.95 AND n > 100 THEN 'identifier'
            WHEN n > 10 AND {_consecutive_ratio_sql('o_orderkey')} > 0.95 THEN 'identifier' ELSE 'metric' END AS role,
       CAST(uk AS BIGINT) AS n_unique FROM u
UNION ALL SELECT 'o_custkey',
       CASE WHEN uc / n > 0.95 AND n > 100 THEN 'identifier'
            WHEN n > 10 AND {_consecutive_ratio_sql('o_custkey')} > 0.95 THEN 'identifier' ELSE 'metric' END,
       CAST(uc AS BIGINT) FROM u
UNION ALL SELECT 'o_orderstatus', CASE WHEN us BETWEEN 2 AND 30 THEN 'dimension' ELSE 'other' END, CAST(us AS BIGINT) FROM u
UNION ALL SELECT 'o_totalprice', 'metric', CAST(up AS BIGINT) FROM u
UNION ALL SELECT 'o_orderdate', 'date', CAST(ud AS BIGINT) FROM u
UNION ALL SELECT 'o_orderpriority', CASE WHEN uo BETWEEN 2 AND 30 THEN 'dimension' ELSE 'other' END, CAST(uo AS BIGINT) FROM u""")


# K-12 cleaning summary of the messy view: every rule's firing is recomputed ----------------------
_K12_SQL = """
, raw AS (SELECT count(*) AS n FROM messy)
, nulls AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS np, "
    f"count(DISTINCT {c}) AS u FROM messy" for c in _MESSY_COLS) + """)
, sparse AS (SELECT col FROM nulls WHERE np > 55)
, const AS (SELECT col FROM nulls WHERE np <= 55 AND u <= 1)
, dd AS (SELECT DISTINCT l_returnflag, linenumber, l_quantity, l_tax, returned_flag FROM messy)
, nd AS (SELECT count(*) AS n_after FROM dd)
, acts AS (
    SELECT 'missing' AS issue_group, 0 AS rows_affected FROM sparse
    UNION ALL SELECT 'dropped_col', (SELECT n FROM raw) FROM const
    UNION ALL SELECT 'duplicates', (SELECT n FROM raw) - n_after FROM nd WHERE (SELECT n FROM raw) - n_after > 0
    UNION ALL SELECT 'whitespace', count(*) FILTER (WHERE returned_flag <> trim(returned_flag)) FROM dd
              HAVING count(*) FILTER (WHERE returned_flag <> trim(returned_flag)) > 0
    UNION ALL SELECT 'whitespace', count(*) FILTER (WHERE l_returnflag <> trim(l_returnflag)) FROM dd
              HAVING count(*) FILTER (WHERE l_returnflag <> trim(l_returnflag)) > 0
    UNION ALL SELECT 'missing', count(*) FILTER (WHERE linenumber IS NULL) FROM dd HAVING count(*) FILTER (WHERE linenumber IS NULL) > 0
    UNION ALL SELECT 'missing', count(*) FILTER (WHERE l_quantity IS NULL) FROM dd HAVING count(*) FILTER (WHERE l_quantity IS NULL) > 0
    UNION ALL SELECT 'missing', count(*) FILTER (WHERE l_tax IS NULL) FROM dd HAVING count(*) FILTER (WHERE l_tax IS NULL) > 0
    UNION ALL SELECT 'type_fix', (SELECT n_after FROM nd) FROM dd
              HAVING count(*) FILTER (WHERE lower(trim(returned_flag)) NOT IN ('yes', 'no', 'true', 'false', '1', '0', 'y', 'n')) = 0
                 AND count(DISTINCT lower(trim(returned_flag))) <= 4)
SELECT issue_group, CAST(count(*) AS BIGINT) AS n_actions, CAST(sum(rows_affected) AS BIGINT) AS rows_affected
FROM acts GROUP BY issue_group"""
attach_oracle("K12_cleaning_summary", with_views(_K12_SQL, "messy"))

# N-81 dispatch: HR and sales KPIs by their detected domains, general ones for plain orders ---------
_COUNTS = " + ".join(f"count({c})" for c in _ORDERS_COLS)
attach_oracle("N81_domain_kpi_dispatch_with_fallback", with_views(f"""
, h AS (SELECT *, CASE WHEN "left" = 'Yes' THEN 1 ELSE 0 END AS gone FROM hr)
, a AS (SELECT sum(rev) AS r, sum(target) AS t, avg(margin) AS m, avg(CASE WHEN won = 'won' THEN 1 ELSE 0 END) AS w FROM sales)
, rep AS (SELECT max(s) AS tr FROM (SELECT sum(rev) AS s FROM sales WHERE rep IS NOT NULL GROUP BY rep))
, k AS (SELECT 'hr' AS input, 'hr' AS domain, 'Total Records' AS label, CAST(count(*) AS DOUBLE) AS value FROM h
  UNION ALL SELECT 'hr', 'hr', 'Attrition Rate', avg(gone) * 100.0 FROM h
  UNION ALL SELECT 'hr', 'hr', 'Avg Satisfaction', avg(satisfaction) FROM h
  UNION ALL SELECT 'hr', 'hr', 'Median Tenure', quantile_cont(tenure, 0.5) FROM h
  UNION ALL SELECT 'hr', 'hr', 'Avg Evaluation', avg(evaluation) FROM h
  UNION ALL SELECT 'hr', 'hr', 'Salary Attrition Gap',
                   (avg(gone) FILTER (lower(salary) = 'low') - avg(gone) FILTER (lower(salary) = 'high')) * 100.0 FROM h
  UNION ALL SELECT 'sales', 'sales', 'Total Revenue', r FROM a
  UNION ALL SELECT 'sales', 'sales', 'Quota Attainment', r * 100.0 / t FROM a
  UNION ALL SELECT 'sales', 'sales', 'Top Rep Share', tr * 100.0 / r FROM a, rep
  UNION ALL SELECT 'sales', 'sales', 'Avg Margin', m FROM a
  UNION ALL SELECT 'sales', 'sales', 'Win Rate', w * 100.0 FROM a
  UNION ALL SELECT 'orders', 'general', 'Total Records', count(*) FROM orders
  UNION ALL SELECT 'orders', 'general', 'Columns', {len(_ORDERS_COLS)}
  UNION ALL SELECT 'orders', 'general', 'Completeness', ({_COUNTS}) * 100.0 / (count(*) * {len(_ORDERS_COLS)}) FROM orders
  UNION ALL SELECT 'orders', 'general', 'Numeric Columns', 3)
SELECT input, domain, label, round(value, 4) AS value FROM k""", "hr", "sales"))
