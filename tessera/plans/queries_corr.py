"""Registered queries: correlation (C-*) and hypothesis tests (H-9..H-15)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import corr, hypothesis as hyp
from ..sources.tables import read_table
from .catalog import register, rounded
from .views import ecommerce_view, hr_view, messy_view, with_views

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rank_sql(src: str, col: str) -> str:
    return (f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)")


def spearman_sql(src: str, cols: list[str], pairwise_filter: bool) -> str:
    parts = []
    for a, b in itertools.combinations(cols, 2):
        parts.append(f"""
SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, corr(ra, rb) AS r FROM (
  SELECT {_rank_sql(src, a)} AS ra, {_rank_sql(src, b)} AS rb FROM {src}
  WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    body = " UNION ALL ".join(parts)
    return f"""
, p AS ({body})
SELECT col_a, col_b, 'spearman' AS method, CAST(n AS BIGINT) AS n, round(r, 6) AS r, round(r * r, 6) AS r2,
       CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM p WHERE n >= 10 AND r IS NOT NULL"""


@register("C1_spearman_lineitem", "WITH src AS (SELECT * FROM lineitem)" + spearman_sql("src", LI, False))
def q_c1(spark, sf):
    return rounded(corr.spearman_pairs(read_table(spark, sf, "lineitem"), LI, with_p=False))


@register("C1_spearman_pairwise_complete_with_nulls",
          with_views(spearman_sql("messy", ["linenumber", "l_quantity", "sparse_discount"], True), "messy"))
def q_c1_nulls(spark, sf):
    return rounded(corr.spearman_pairs(messy_view(spark, sf), ["linenumber", "l_quantity", "sparse_discount"],
                                       with_p=False))


@register("C1_spearman_with_pvalues_hr")
def q_c1_p(spark, sf):
    return rounded(corr.spearman_pairs(hr_view(spark, sf), ["satisfaction", "tenure", "hours", "evaluation"],
                                       min_r=0.0))


@register("C4_pearson_quantity_price", """
SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, CAST(count(*) FILTER (WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) AS BIGINT) AS n,
       round(corr(l_quantity, l_extendedprice), 6) AS r,
       CASE WHEN abs(corr(l_quantity, l_extendedprice)) > 0.7 THEN 'strong'
            WHEN abs(corr(l_quantity, l_extendedprice)) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
       CASE WHEN corr(l_quantity, l_extendedprice) > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM lineitem""")
def q_c4(spark, sf):
    return rounded(corr.pearson(read_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@register("C5_pearson_matrix_lineitem", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n, "
    f"round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in itertools.combinations(LI, 2)))
def q_c5(spark, sf):
    return rounded(corr.pearson_matrix(read_table(spark, sf, "lineitem"), LI))


@register("C8_ols_trend_discount_rating_by_category", with_views("""
SELECT category, CAST(count(*) AS BIGINT) AS n, round(regr_slope(rating, discount), 6) AS slope,
       round(regr_intercept(rating, discount), 6) AS intercept
FROM ecommerce WHERE discount IS NOT NULL AND rating IS NOT NULL GROUP BY category""", "ecommerce"))
def q_c8(spark, sf):
    return rounded(corr.ols_trend(ecommerce_view(spark, sf), "discount", "rating", "category"))


@register("C9_vif_lineitem")
def q_c9(spark, sf):
    return rounded(corr.vif(read_table(spark, sf, "lineitem"), LI))


def chi_sql(src: str, a: str, b: str, yates: bool) -> str:
    adj = ("least(0.5, abs(e - o)) * sign(e - o)" if yates else "0")
    return f"""
, obs AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM {src}
          WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)
, ra AS (SELECT a, sum(o) AS na FROM obs GROUP BY a), rb AS (SELECT b, sum(o) AS nb FROM obs GROUP BY b)
, n AS (SELECT sum(o) AS n FROM obs)
, cells AS (SELECT ra.a, rb.b, coalesce(obs.o, 0) AS o, na * nb / CAST(n AS DOUBLE) AS e, n
            FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN obs ON obs.a = ra.a AND obs.b = rb.b)
SELECT '{a}' AS col_a, '{b}' AS col_b, CAST(any_value(n) AS BIGINT) AS n,
       CAST(((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM rb) - 1) AS BIGINT) AS dof,
       round(sum(pow(o + {adj} - e, 2) / e), 6) AS chi2 FROM cells"""


@register("C10_chi_square_dept_by_left", with_views(chi_sql("hr", "dept", '"left"', False), "hr").replace(
    "'\"left\"' AS col_b", "'left' AS col_b"))
def q_c10(spark, sf):
    return rounded(corr.chi_square(hr_view(spark, sf), "dept", "left", with_p=False))


@register("C10_chi_square_yates_left_by_promotion", with_views(chi_sql("hr", '"left"', "promotion", True), "hr").replace(
    "'\"left\"' AS col_a", "'left' AS col_a"))
def q_c10y(spark, sf):
    return rounded(corr.chi_square(hr_view(spark, sf), "left", "promotion", with_p=False))


@register("C10_chi_square_with_pvalue_salary_by_left")
def q_c10p(spark, sf):
    return rounded(corr.chi_square(hr_view(spark, sf), "salary", "left"))


# ---------------------------------------------------------------- H-*
HR_G = """
, d AS (SELECT CAST(dept AS VARCHAR) AS g, CAST(satisfaction AS DOUBLE) AS v FROM hr
        WHERE satisfaction IS NOT NULL AND dept IS NOT NULL)
, keep AS (SELECT g FROM d GROUP BY g HAVING count(*) >= 3)
, x AS (SELECT d.* FROM d JOIN keep USING (g))"""


@register("H9_kruskal_satisfaction_by_dept", with_views(HR_G + """
, r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM x)
, s AS (SELECT g, count(*) AS n, sum(rk) AS R FROM r GROUP BY g)
, t AS (SELECT sum(c * c * c - c) AS T FROM (SELECT count(*) AS c FROM x GROUP BY v))
, a AS (SELECT count(*) AS k, sum(n) AS N, sum(R * R / n) AS q FROM s)
SELECT CAST(k AS BIGINT) AS k, CAST(N AS BIGINT) AS n_total,
       round((12.0 / (N * (N + 1)) * q - 3 * (N + 1)) / (1 - T / (CAST(N AS DOUBLE) * N * N - N)), 6) AS h_stat
FROM a, t""", "hr"))
def q_h9(spark, sf):
    d = hyp._prep(hr_view(spark, sf), "satisfaction", "dept", 3)
    return rounded(hyp.kruskal_table(d))


@register("H10_anova_satisfaction_by_dept", with_views(HR_G + """
, g AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS var FROM x GROUP BY g)
, t AS (SELECT count(*) AS ntot, avg(v) AS gm, var_pop(v) AS vp FROM x)
, a AS (SELECT count(*) AS k, sum(g.n * pow(m - gm, 2)) AS ssb, sum(coalesce((g.n - 1) * var, 0)) AS ssw,
               any_value(ntot) AS ntot, any_value(vp) AS vp FROM g, t)
SELECT CAST(k AS BIGINT) AS k, CAST(ntot AS BIGINT) AS n_total, round(ssb, 6) AS ssb, round(ssw, 6) AS ssw,
       round((ssb / (k - 1)) / (ssw / (ntot - k)), 6) AS f_stat,
       round(CASE WHEN vp * ntot > 0 THEN ssb / (vp * ntot) ELSE 0 END, 6) AS eta_sq FROM a""", "hr"))
def q_h10(spark, sf):
    d = hyp._prep(hr_view(spark, sf), "satisfaction", "dept", 3)
    return rounded(hyp.anova_table(d))


@register("H13_levene_hours_by_salary", with_views("""
, d AS (SELECT CAST(salary AS VARCHAR) AS g, CAST(hours AS DOUBLE) AS v FROM hr WHERE hours IS NOT NULL AND salary IS NOT NULL)
, keep AS (SELECT g FROM d GROUP BY g HAVING count(*) >= 3)
, x AS (SELECT d.* FROM d JOIN keep USING (g))
, med AS (SELECT g, quantile_cont(v, 0.5) AS med FROM x GROUP BY g)
, z AS (SELECT x.g, abs(v - med) AS v FROM x JOIN med USING (g))
, g AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS var FROM z GROUP BY g)
, t AS (SELECT count(*) AS ntot, avg(v) AS gm FROM z)
, a AS (SELECT count(*) AS k, sum(g.n * pow(m - gm, 2)) AS ssb, sum(coalesce((g.n - 1) * var, 0)) AS ssw, any_value(ntot) AS ntot FROM g, t)
SELECT CAST(k AS BIGINT) AS k, CAST(ntot AS BIGINT) AS n_total, round((ssb / (k - 1)) / (ssw / (ntot - k)), 6) AS w_stat FROM a""",
    "hr"))
def q_h13(spark, sf):
    return rounded(hyp.levene(hr_view(spark, sf), "hours", "salary"))


@register("H11_H12_H15_two_group_tests_hours_by_left", with_views("""
, d AS (SELECT CAST("left" AS VARCHAR) AS g, CAST(hours AS DOUBLE) AS v FROM hr WHERE hours IS NOT NULL AND "left" IS NOT NULL)
, x AS (SELECT * FROM d WHERE g IN ('Yes', 'No'))
, m AS (SELECT g, count(*) AS n, avg(v) AS mean, var_samp(v) AS var, stddev_pop(v) AS sp FROM x GROUP BY g)
, a AS (SELECT * FROM m WHERE g = 'Yes'), b AS (SELECT * FROM m WHERE g = 'No')
, r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM x)
, r1 AS (SELECT sum(rk) AS R1 FROM r WHERE g = 'Yes')
, t AS (SELECT sum(c * c * c - c) AS T FROM (SELECT count(*) AS c FROM x GROUP BY v))
, u AS (SELECT a.n AS n1, b.n AS n2, R1 - a.n * (a.n + 1) / 2.0 AS u1, T FROM a, b, r1, t)
SELECT 'Yes' AS group_a, 'No' AS group_b, a.n AS n_a, b.n AS n_b, round(a.mean, 6) AS mean_a, round(b.mean, 6) AS mean_b,
       round((a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) AS t_stat,
       CAST(a.n + b.n - 2 AS BIGINT) AS t_df, round(u1, 6) AS u_stat,
       round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5)
             / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - T / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) AS mwu_z,
       round((a.mean - b.mean) / sqrt((a.sp * a.sp + b.sp * b.sp) / 2.0), 6) AS cohens_d,
       CASE WHEN abs((a.mean - b.mean) / sqrt((a.sp * a.sp + b.sp * b.sp) / 2.0)) < 0.2 THEN 'negligible'
            WHEN abs((a.mean - b.mean) / sqrt((a.sp * a.sp + b.sp * b.sp) / 2.0)) < 0.5 THEN 'small'
            WHEN abs((a.mean - b.mean) / sqrt((a.sp * a.sp + b.sp * b.sp) / 2.0)) < 0.8 THEN 'medium' ELSE 'large' END AS d_label
FROM a, b, u""", "hr"))
def q_h11(spark, sf):
    return rounded(hyp.two_group_tests(hr_view(spark, sf), "hours", "left", "Yes", "No", with_p=False))


@register("E2_group_comparison_kruskal_with_pvalue")
def q_e2(spark, sf):
    return rounded(hyp.group_comparison(hr_view(spark, sf), "satisfaction", "dept", is_normal=False))


@register("E2_group_comparison_anova_with_pvalue")
def q_e2b(spark, sf):
    return rounded(hyp.group_comparison(hr_view(spark, sf), "hours", "salary", is_normal=True))


@register("H11_H12_two_group_tests_with_pvalues")
def q_h12p(spark, sf):
    return rounded(hyp.two_group_tests(hr_view(spark, sf), "satisfaction", "left", "Yes", "No"))
