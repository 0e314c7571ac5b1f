"""Registered queries: BI, aggregation and domain operators on the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bi
from .catalog import register, rounded
from .views import sales_view, with_views


# ------------------------------------------------------------------ B-4
@register("B4_pareto_revenue_by_nation", with_views("""
, g AS (SELECT CAST(rep AS VARCHAR) AS name, sum(rev) AS value FROM sales
        WHERE rep IS NOT NULL GROUP BY 1)
, r AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS rn,
               sum(value) OVER (ORDER BY value DESC, name ROWS UNBOUNDED PRECEDING) AS cum,
               sum(value) OVER () AS total, count(*) OVER () AS n FROM g)
, k AS (SELECT greatest(1, CAST(ceil(n * 20 / 100.0) AS BIGINT)) AS k, any_value(total) AS total
        FROM r GROUP BY n)
, s AS (SELECT sum(value) * 100.0 / any_value(k.total) AS share FROM r, k WHERE rn <= k.k)
SELECT CAST(rn AS BIGINT) AS rank, name, round(value, 2) AS value,
       round(value * 100.0 / r.total, 6) AS pct_of_total,
       round(cum * 100.0 / r.total, 6) AS cumulative_pct,
       rn <= k.k AS in_top_20, round(s.share, 6) AS top_groups_share,
       s.share >= 60 AS pareto_holds
FROM r, k, s""", "sales"))
def q_pareto(spark, sf):
    return rounded(bi.pareto(sales_view(spark, sf), "rep", "rev"), {"value": 2})


# ======================================================================
# A-*: aggregations
# ======================================================================
from ..operators import aggregate as agg  # noqa: E402
from ..operators import select as sel  # noqa: E402
from ..sources.tables import read_table  # noqa: E402
from .views import ecommerce_view, finance_view, hr_view  # noqa: E402


@register("A1_aggregate_sum_revenue_by_region", with_views(
    "SELECT region, round(sum(rev), 2) AS rev FROM sales WHERE region IS NOT NULL GROUP BY region",
    "sales"))
def q_a1_sum(spark, sf):
    return rounded(agg.aggregate(sales_view(spark, sf), "region", "rev", "sum"), default=2)


@register("A1_aggregate_mean_rating_by_category", with_views(
    "SELECT category, round(avg(rating), 6) AS rating FROM ecommerce "
    "WHERE category IS NOT NULL GROUP BY category", "ecommerce"))
def q_a1_mean(spark, sf):
    return rounded(agg.aggregate(ecommerce_view(spark, sf), "category", "rating", "mean"))


@register("A1_aggregate_count_by_salary_band", with_views(
    "SELECT salary, count(emp_id) AS emp_id FROM hr WHERE salary IS NOT NULL GROUP BY salary", "hr"))
def q_a1_count(spark, sf):
    return agg.aggregate(hr_view(spark, sf), "salary", "emp_id", "count")


@register("A1_aggregate_max_min_price_by_brand", """
SELECT p_brand, round(max(p_retailprice), 2) AS max_price, round(min(p_retailprice), 2) AS min_price
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand""")
def q_a1_maxmin(spark, sf):
    p = read_table(spark, sf, "part")
    mx = agg.aggregate(p, "p_brand", "p_retailprice", "max").withColumnRenamed("p_retailprice", "max_price")
    mn = agg.aggregate(p, "p_brand", "p_retailprice", "min").withColumnRenamed("p_retailprice", "min_price")
    return rounded(mx.join(mn, "p_brand"), default=2)


@register("A2_count_values_quantity_top20", """
SELECT l_quantity, count(*) AS count FROM lineitem WHERE l_quantity IS NOT NULL
GROUP BY l_quantity ORDER BY count DESC, l_quantity LIMIT 20""")
def q_a2(spark, sf):
    return agg.count_values(read_table(spark, sf, "lineitem"), "l_quantity", 20)


@register("A4_metric_by_group_rating_mean", with_views("""
SELECT category, round(avg(rating), 6) AS rating, 'mean' AS agg_func FROM ecommerce
WHERE category IS NOT NULL GROUP BY category ORDER BY rating DESC, category LIMIT 15""", "ecommerce"))
def q_a4_mean(spark, sf):
    return rounded(agg.metric_by_group(ecommerce_view(spark, sf), "category", "rating"))


@register("A4_metric_by_group_revenue_sum_top15", with_views("""
SELECT rep, round(sum(rev), 2) AS rev, 'sum' AS agg_func FROM sales
WHERE rep IS NOT NULL GROUP BY rep ORDER BY sum(rev) DESC, rep LIMIT 15""", "sales"))
def q_a4_sum(spark, sf):
    return rounded(agg.metric_by_group(sales_view(spark, sf), "rep", "rev"), default=2)


@register("A5_metric_by_group_ascending_bottom10", with_views("""
SELECT cat, round(sum(profit), 4) AS profit, 'sum' AS agg_func FROM finance
WHERE cat IS NOT NULL GROUP BY cat ORDER BY sum(profit) ASC, cat LIMIT 10""", "finance"))
def q_a5(spark, sf):
    return rounded(agg.metric_by_group(finance_view(spark, sf), "cat", "profit", top=10,
                                       ascending=True), default=4)


@register("A6_share_of_total_revenue_by_brand_top8", with_views("""
, t AS (SELECT cat, sum(rev) AS value FROM finance WHERE cat IS NOT NULL GROUP BY cat
        ORDER BY value DESC, cat LIMIT 8)
SELECT cat, round(value, 4) AS value, round(value * 100.0 / sum(value) OVER (), 6) AS share_pct FROM t""",
    "finance"))
def q_a6(spark, sf):
    return rounded(agg.share_of_total(finance_view(spark, sf), "cat", "rev", 8), {"value": 4})


@register("A7_above_below_group_average_satisfaction", with_views("""
, g AS (SELECT dept, avg(satisfaction) AS value FROM hr WHERE dept IS NOT NULL GROUP BY dept)
SELECT dept, round(value, 6) AS value, round((SELECT avg(value) FROM g), 6) AS group_avg,
       CASE WHEN value >= (SELECT avg(value) FROM g) THEN 'above' ELSE 'below' END AS marker
FROM g""", "hr"))
def q_a7(spark, sf):
    return rounded(agg.above_below_average(hr_view(spark, sf), "dept", "satisfaction"))


@register("A8_distribution_order_status", """
SELECT o_orderstatus, count(*) AS count,
       round(count(*) / CAST((SELECT count(o_orderstatus) FROM orders) AS DOUBLE), 6) AS share
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""")
def q_a8(spark, sf):
    return rounded(agg.distribution(read_table(spark, sf, "orders"), "o_orderstatus"))


@register("A11_entropy_customer_columns", """
, long AS (SELECT 'c_mktsegment' AS "column", CAST(c_mktsegment AS VARCHAR) AS value FROM customer
           UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer)
, c AS (SELECT "column", value, count(*) AS cnt FROM long WHERE value IS NOT NULL GROUP BY ALL)
, p AS (SELECT "column", cnt / CAST(sum(cnt) OVER (PARTITION BY "column") AS DOUBLE) AS p FROM c)
SELECT "column", round(-sum(p * log2(p + 1e-10)), 6) AS entropy FROM p GROUP BY "column"
""".replace(
    ", long AS", "WITH long AS", 1))
def q_a11(spark, sf):
    return rounded(agg.entropy(read_table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"]))


@register("A12_histogram_extendedprice_20bins", """
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS mean,
                  quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem)
, b AS (SELECT least(greatest(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 20)) AS BIGINT), 0), 19) AS bin
        FROM lineitem, s WHERE l_extendedprice IS NOT NULL)
, c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin)
SELECT r.bin, round(lo + r.bin * ((hi - lo) / 20), 6) AS bin_lo,
       round(lo + (r.bin + 1) * ((hi - lo) / 20), 6) AS bin_hi,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count, round(mean, 6) AS mean, round(med, 6) AS median
FROM (SELECT CAST(range AS BIGINT) AS bin FROM range(20)) r LEFT JOIN c ON r.bin = c.bin, s""")
def q_a12(spark, sf):
    return rounded(agg.histogram(read_table(spark, sf, "lineitem"), "l_extendedprice", 20))


@register("A13_box_summary_price_by_returnflag", """
WITH base AS (SELECT CAST(l_returnflag AS VARCHAR) AS grp, l_extendedprice AS value FROM lineitem
              WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL)
, q AS (SELECT grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
               quantile_cont(value, 0.75) AS q3 FROM base GROUP BY grp)
, f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM q)
SELECT f.grp, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       count(*) AS n,
       round(min(value) FILTER (WHERE value >= lo_f AND value <= hi_f), 6) AS whisker_lo,
       round(max(value) FILTER (WHERE value >= lo_f AND value <= hi_f), 6) AS whisker_hi,
       count(*) FILTER (WHERE NOT (value >= lo_f AND value <= hi_f)) AS n_outliers
FROM base JOIN f ON base.grp = f.grp GROUP BY f.grp, q1, median, q3, iqr""")
def q_a13(spark, sf):
    return rounded(agg.box_summary(read_table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@register("A15_dominant_value_lineitem", """
WITH long AS (SELECT 'l_discount' AS "column", CAST(l_discount AS DOUBLE) AS value FROM lineitem
              UNION ALL SELECT 'l_tax', CAST(l_tax AS DOUBLE) FROM lineitem
              UNION ALL SELECT 'l_quantity', CAST(l_quantity AS DOUBLE) FROM lineitem)
, c AS (SELECT "column", value, count(*) AS cnt FROM long WHERE value IS NOT NULL GROUP BY ALL)
, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value ASC) AS rn,
               sum(cnt) OVER (PARTITION BY "column") AS n, count(*) OVER (PARTITION BY "column") AS n_unique FROM c)
SELECT "column", CAST(n AS BIGINT) AS n, n_unique, round(value, 6) AS top_value, round(cnt / CAST(n AS DOUBLE), 6) AS top_share,
       (cnt / CAST(n AS DOUBLE) > 0.6) AND n_unique > 3 AS is_dominant
FROM r WHERE rn = 1""")
def q_a15(spark, sf):
    return rounded(agg.dominant_value(read_table(spark, sf, "lineitem"),
                                      ["l_discount", "l_tax", "l_quantity"]))


# ======================================================================
# P-*: selection
# ======================================================================
@register("P1_filter_price_gt", """
SELECT * FROM part WHERE CAST(p_retailprice AS DOUBLE) > 1500.0""")
def q_p1_gt(spark, sf):
    return sel.filter_rows(read_table(spark, sf, "part"), "p_retailprice", ">", 1500)


@register("P1_filter_contains_case_insensitive", """
SELECT * FROM part WHERE coalesce(contains(lower(CAST(p_name AS VARCHAR)), 'ring'), false)""")
def q_p1_contains(spark, sf):
    return sel.filter_rows(read_table(spark, sf, "part"), "p_name", "contains", "RING")


@register("P1_filter_not_equal_string_form", """
SELECT * FROM orders WHERE CAST(o_orderstatus AS VARCHAR) IS DISTINCT FROM 'F'""")
def q_p1_ne(spark, sf):
    return sel.filter_rows(read_table(spark, sf, "orders"), "o_orderstatus", "!=", "F")


@register("P3_top_n_orders_by_price", """
SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10""")
def q_p3(spark, sf):
    return sel.top_n(read_table(spark, sf, "orders"), "o_totalprice", 10, tiebreak=["o_orderkey"])


# ======================================================================
# B-*: business intelligence
# ======================================================================
from ..operators import normality as norm  # noqa: E402


@register("B1_benchmark_lineitem", """
WITH long AS (SELECT 'l_quantity' AS "column", CAST(l_quantity AS DOUBLE) AS value FROM lineitem
              UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM lineitem)
, v AS (SELECT * FROM long WHERE value IS NOT NULL)
, m AS (SELECT "column", avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.1) AS p10,
               quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median,
               quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90 FROM v GROUP BY "column")
, a AS (SELECT v."column", avg(CASE WHEN value > mean THEN 1.0 ELSE 0.0 END) * 100.0 AS above FROM v JOIN m USING ("column") GROUP BY v."column")
, c AS (SELECT m.*, above, CASE WHEN mean <> 0 THEN std / abs(mean) ELSE 0.0 END AS cv,
               CASE WHEN median <> 0 THEN abs(mean - median) / abs(median) * 100.0 ELSE 0.0 END AS diff FROM m JOIN a USING ("column"))
SELECT "column", round(mean, 6) AS mean, round(median, 6) AS median, round(p25, 6) AS p25, round(p75, 6) AS p75,
       round(p90, 6) AS p90, round(p90, 6) AS top_10_pct, round(p10, 6) AS bottom_10_pct,
       round(above, 6) AS above_avg_pct, round(cv, 6) AS cv,
       CASE WHEN cv < 0.1 THEN 'Very Consistent — low variation across records'
            WHEN cv < 0.3 THEN 'Consistent — moderate variation'
            WHEN cv < 0.6 THEN 'Variable — significant spread'
            ELSE 'Highly Variable — large spread, investigate outliers' END AS benchmark_label,
       diff > 20 AS skewed_central_tendency FROM c""")
def q_b1(spark, sf):
    return rounded(bi.benchmark(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@register("B2_root_cause_low_satisfaction_hr")
def q_b2(spark, sf):
    return rounded(bi.root_cause(hr_view(spark, sf), "satisfaction", ["tenure", "hours", "evaluation", "projects"],
                                 ["dept", "salary", "left"]))


@register("B2_root_cause_low_revenue_ecommerce")
def q_b2b(spark, sf):
    return rounded(bi.root_cause(ecommerce_view(spark, sf), "revenue", ["price", "discount", "rating", "reviews"],
                                 ["category"]))


@register("B3_cohort_stats_revenue_by_region", with_views("""
, d AS (SELECT CAST(region AS VARCHAR) AS name, CAST(rev AS DOUBLE) AS v FROM sales WHERE region IS NOT NULL)
, valid AS (SELECT name FROM d GROUP BY name HAVING count(*) >= 5)
, f AS (SELECT d.* FROM d JOIN valid USING (name))
, g AS (SELECT name, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, quantile_cont(v, 0.5) AS median FROM f GROUP BY name)
, o AS (SELECT avg(v) AS overall FROM f)
, r AS (SELECT g.*, row_number() OVER (ORDER BY mean DESC, name) AS rk,
               CASE WHEN overall <> 0 THEN (mean - overall) / abs(overall) * 100.0 ELSE 0.0 END AS vs FROM g, o)
SELECT 'region' AS cohort_col, 'rev' AS metric_col, name, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean,
       round(median, 6) AS median, round(std, 6) AS std, CAST(rk AS BIGINT) AS rank, round(vs, 6) AS vs_avg_pct,
       CASE WHEN vs > 5 THEN 'above' WHEN vs < -5 THEN 'below' ELSE 'avg' END AS status FROM r""", "sales"))
def q_b3(spark, sf):
    return rounded(bi.cohort(sales_view(spark, sf), "region", "rev", with_p=False))


@register("B3_cohort_gap_revenue_by_region", with_views("""
, g AS (SELECT CAST(region AS VARCHAR) AS name, avg(CAST(rev AS DOUBLE)) AS mean FROM sales WHERE region IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)
, r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, name) AS k, count(*) OVER () AS n FROM g WHERE mean IS NOT NULL)
SELECT CAST(b.n AS BIGINT) AS n_groups, b.name AS best, round(b.mean, 6) AS best_value, w.name AS worst, round(w.mean, 6) AS worst_value,
       round(b.mean - w.mean, 6) AS gap, round(CASE WHEN w.mean <> 0 THEN (b.mean - w.mean) / abs(w.mean) * 100.0 ELSE 0.0 END, 6) AS gap_pct
FROM r b JOIN r w ON b.k = 1 AND w.k = w.n WHERE b.n >= 2""", "sales"))
def q_b3_gap(spark, sf):
    return rounded(bi.group_gap(bi.cohort(sales_view(spark, sf), "region", "rev", with_p=False)))


@register("B3_cohort_with_test_satisfaction_by_dept")
def q_b3p(spark, sf):
    return rounded(bi.cohort(hr_view(spark, sf), "dept", "satisfaction"))


@register("B5_segment_health_by_category", with_views("""
, long AS (SELECT CAST(category AS VARCHAR) AS segment, 'price' AS metric, CAST(price AS DOUBLE) AS value FROM ecommerce WHERE category IS NOT NULL
           UNION ALL SELECT CAST(category AS VARCHAR), 'rating', CAST(rating AS DOUBLE) FROM ecommerce WHERE category IS NOT NULL
           UNION ALL SELECT CAST(category AS VARCHAR), 'discount', CAST(discount AS DOUBLE) FROM ecommerce WHERE category IS NOT NULL)
, ov AS (SELECT metric, avg(value) AS overall FROM long GROUP BY metric)
, seg AS (SELECT segment, metric, avg(value) AS mean FROM long GROUP BY segment, metric)
, rows_ AS (SELECT CAST(category AS VARCHAR) AS segment, count(*) AS n FROM ecommerce WHERE category IS NOT NULL GROUP BY 1)
, s AS (SELECT seg.*, overall, CASE WHEN overall <> 0 THEN (mean - overall) / abs(overall) * 100.0 ELSE 0.0 END AS vs
        FROM seg JOIN ov USING (metric))
, j AS (SELECT s.*, n FROM s JOIN rows_ USING (segment) WHERE n >= 5)
, a AS (SELECT segment, n, avg(least(100.0, greatest(0.0, 50.0 + vs * 0.5))) AS health_score,
               count(*) FILTER (WHERE vs < -5) AS nweak, count(*) FILTER (WHERE vs > 5) AS nstrong,
               arg_min(metric, vs) AS wm, arg_min(mean, vs) AS wmean, arg_min(overall, vs) AS wov, min(vs) AS wvs,
               arg_max(metric, vs) AS bm FROM j GROUP BY segment, n)
SELECT 'category' AS segment_col, segment AS segment_name, CAST(n AS BIGINT) AS n, round(health_score, 6) AS health_score,
       CASE WHEN nweak > 0 THEN printf('Improve ''%s'' from %.2f to dataset average %.2f — %.1f%% improvement opportunity.', wm, wmean, wov, abs(wvs))
            WHEN nstrong > 0 THEN printf('Already leading in ''%s'' — leverage this advantage in other segments.', bm)
            ELSE 'Performance close to average across all metrics.' END AS opportunity FROM a""", "ecommerce"))
def q_b5(spark, sf):
    out = bi.segment_health(ecommerce_view(spark, sf), "category", ["price", "rating", "discount"])
    return rounded(out.select("segment_col", "segment_name", "n", "health_score", "opportunity"))


@register("B5_segment_health_full_by_region")
def q_b5full(spark, sf):
    return rounded(bi.segment_health(sales_view(spark, sf), "region", ["rev", "margin", "target"]))


@register("H1_shapiro_wilk_lineitem")
def q_h1(spark, sf):
    return rounded(norm.shapiro_by_column(read_table(spark, sf, "lineitem"),
                                          ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def _root_cause_sql(view: str, target: str, nums: list[str], cats: list[str]) -> str:
    nl = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", low AS flag, CAST({c} AS DOUBLE) AS v FROM f WHERE {c} IS NOT NULL" for c in nums)
    cl = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", low AS flag, CAST({c} AS VARCHAR) AS v FROM f WHERE {c} IS NOT NULL" for c in cats)
    return f"""
, thr AS (SELECT quantile_cont({target}, 0.25) AS t FROM {view} WHERE {target} IS NOT NULL)
, f AS (SELECT *, {target} <= t AS low FROM {view}, thr WHERE {target} IS NOT NULL)
, nl AS ({nl})
, r AS (SELECT *, rank() OVER (PARTITION BY "column" ORDER BY v) + (count(*) OVER (PARTITION BY "column", v) - 1) / 2.0 AS rk FROM nl)
, s AS (SELECT "column", count(*) FILTER (WHERE flag) AS n1, count(*) FILTER (WHERE NOT flag) AS n2, sum(rk) FILTER (WHERE flag) AS r1,
               avg(v) FILTER (WHERE flag) AS lm, avg(v) FILTER (WHERE NOT flag) AS hm FROM r GROUP BY 1)
, tt AS (SELECT "column", sum(c * c * c - c) AS tt FROM (SELECT "column", v, count(*) AS c FROM nl GROUP BY 1, 2) GROUP BY 1)
, u AS (SELECT s.*, tt, r1 - n1 * (n1 + 1) / 2.0 AS u1,
               CASE WHEN lm <> 0 THEN abs(hm - lm) / abs(lm) * 100.0 ELSE 0.0 END AS dp FROM s JOIN tt USING ("column"))
, num AS (SELECT "column" AS factor, 'numeric' AS dtype, least(dp / 100.0, 1.0) AS impact,
                 CASE WHEN hm - lm > 0 THEN 'negative' ELSE 'positive' END AS direction, lm AS low_mean, hm AS high_mean, dp AS diff_pct,
                 CAST(NULL AS VARCHAR) AS key_category, CAST(NULL AS DOUBLE) AS low_pct_cat, CAST(NULL AS DOUBLE) AS high_pct_cat,
                 (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z
          FROM u WHERE n1 >= 5 AND n2 >= 5)
, cl AS ({cl})
, sh AS (SELECT "column", flag, v, count(*) AS c FROM cl GROUP BY 1, 2, 3)
, side AS (SELECT "column", flag, sum(c) AS n FROM sh GROUP BY 1, 2)
, pct AS (SELECT sh.*, c * 100.0 / n AS p FROM sh JOIN side USING ("column", flag))
, mx AS (SELECT "column", max(c) AS mc FROM pct WHERE flag GROUP BY 1)
, top AS (SELECT pct."column", min(v) AS kc FROM pct JOIN mx ON pct."column" = mx."column" AND pct.c = mx.mc WHERE flag GROUP BY 1)
, cat AS (SELECT top."column" AS factor, 'categorical' AS dtype,
                 least(abs(lo.p - coalesce(hi.p, 0.0)) / 100.0, 1.0) AS impact, 'categorical' AS direction,
                 CAST(NULL AS DOUBLE) AS low_mean, CAST(NULL AS DOUBLE) AS high_mean, abs(lo.p - coalesce(hi.p, 0.0)) AS diff_pct,
                 top.kc AS key_category, lo.p AS low_pct_cat, coalesce(hi.p, 0.0) AS high_pct_cat, CAST(NULL AS DOUBLE) AS z
          FROM top JOIN pct lo ON lo."column" = top."column" AND lo.flag AND lo.v = top.kc
               LEFT JOIN pct hi ON hi."column" = top."column" AND NOT hi.flag AND hi.v = top.kc)
SELECT '{target}' AS target_col, round((SELECT t FROM thr), 6) AS threshold, factor, dtype, round(impact, 6) AS impact, direction,
       round(low_mean, 6) AS low_mean, round(high_mean, 6) AS high_mean, round(diff_pct, 6) AS diff_pct, key_category,
       round(low_pct_cat, 6) AS low_pct_cat, round(high_pct_cat, 6) AS high_pct_cat, round(z, 6) AS z
FROM (SELECT * FROM num UNION ALL SELECT * FROM cat)"""


@register("B2_root_cause_driver_stats_hr", with_views(_root_cause_sql("hr", "satisfaction", ["tenure", "hours", "evaluation"],
                                                                      ["dept", "salary"]), "hr"))
def q_b2s(spark, sf):
    return rounded(bi.root_cause(hr_view(spark, sf), "satisfaction", ["tenure", "hours", "evaluation"],
                                 ["dept", "salary"], with_p=False))
