"""Registered queries: time series and trends (W-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..sources.tables import read_table
from .catalog import register, rounded
from .views import finance_view, sales_view, ecommerce_view, with_views


@register("W1_monthly_mean_order_price", """
SELECT CAST(last_day(o_orderdate) AS VARCHAR) AS month_end, round(avg(o_totalprice), 6) AS o_totalprice,
       count(*) AS n
FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1""")
def q_w1(spark, sf):
    m = ts.monthly_mean(read_table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(m.withColumn("month_end", F.col("month_end").cast("string")))


@register("W2_period_totals_finance_quarter", with_views("""
SELECT period, round(sum(rev), 4) AS rev, round(sum(cost), 2) AS cost FROM finance
WHERE period IS NOT NULL GROUP BY period""", "finance"))
def q_w2(spark, sf):
    return rounded(ts.period_totals(finance_view(spark, sf), "period", ["rev", "cost"]), {"rev": 4, "cost": 2})


@register("W3_change_vs_prior_month_sales", with_views("""
, p AS (SELECT period, sum(rev) AS rev FROM sales WHERE period IS NOT NULL GROUP BY period)
SELECT period, round(rev, 2) AS rev, round(lag(rev) OVER (ORDER BY period), 2) AS prev_value,
       round((rev - lag(rev) OVER (ORDER BY period)) * 100.0 / lag(rev) OVER (ORDER BY period), 6) AS change_pct
FROM p""", "sales"))
def q_w3(spark, sf):
    p = ts.period_totals(sales_view(spark, sf), "period", ["rev"])
    return rounded(ts.change_vs_prior(p, "period", "rev"), {"rev": 2, "prev_value": 2})


@register("W4_halves_trend_finance_revenue", with_views("""
, p AS (SELECT period, sum(rev) AS total FROM finance WHERE period IS NOT NULL GROUP BY period)
, r AS (SELECT *, row_number() OVER (ORDER BY period) AS rn, count(*) OVER () AS n FROM p)
, a AS (SELECT max(n) AS n_periods, avg(total) FILTER (WHERE rn <= floor(n / 2)) AS fh,
               avg(total) FILTER (WHERE rn > floor(n / 2)) AS sh FROM r)
, t AS (SELECT *, CASE WHEN fh > 0 THEN (sh - fh) / fh * 100.0 END AS tp FROM a WHERE n_periods >= 2)
SELECT CAST(n_periods AS BIGINT) AS n_periods, round(fh, 4) AS first_half, round(sh, 4) AS second_half,
       round(tp, 6) AS trend_pct,
       CASE WHEN tp > 0 THEN 'growing' WHEN tp IS NOT NULL THEN 'declining' END AS direction,
       CASE WHEN tp < -20 THEN 'critical' WHEN tp < -10 THEN 'warning' WHEN tp > 15 THEN 'opportunity'
            ELSE 'stable' END AS signal FROM t""", "finance"))
def q_w4(spark, sf):
    return rounded(ts.halves_trend(finance_view(spark, sf), "period", "rev"),
                   {"first_half": 4, "second_half": 4})


@register("W5_first_last_growth_by_brand", with_views("""
, p AS (SELECT cat, period, sum(rev) AS total FROM finance WHERE period IS NOT NULL GROUP BY cat, period)
SELECT cat, round(arg_min(total, period), 4) AS first_value, round(arg_max(total, period), 4) AS last_value,
       CAST(count(*) AS BIGINT) AS n_periods,
       round((arg_max(total, period) - arg_min(total, period)) * 100.0 / arg_min(total, period), 6) AS growth_pct
FROM p GROUP BY cat""", "finance"))
def q_w5(spark, sf):
    return rounded(ts.first_last_growth(finance_view(spark, sf), "period", "rev", ["cat"]),
                   {"first_value": 4, "last_value": 4})


@register("W6_row_half_trend_events", """
WITH d AS (SELECT ts, event_id, CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL)
, r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM d)
, a AS (SELECT max(n) AS n, avg(v) FILTER (WHERE rn <= n // 2) AS fh, avg(v) FILTER (WHERE rn > n // 2) AS sh,
               avg(v) AS mean, stddev_samp(v) AS std FROM r)
SELECT CAST(n AS BIGINT) AS n, round(fh, 6) AS first_half, round(sh, 6) AS second_half,
       round((sh - fh) * 100.0 / abs(fh), 6) AS change_pct, round(std / abs(mean), 6) AS cv,
       CASE WHEN (sh - fh) * 100.0 / abs(fh) > 2 THEN 'up' WHEN (sh - fh) * 100.0 / abs(fh) < -2 THEN 'down'
            ELSE 'flat' END AS trend FROM a""")
def q_w6(spark, sf):
    return rounded(ts.row_half_trend(read_table(spark, sf, "events"), "ts", "value", ["event_id"]))


@register("W7_linear_trend_monthly_revenue", """
WITH m AS (SELECT last_day(o_orderdate) AS month_end, avg(o_totalprice) AS v FROM orders
           WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1)
, s AS (SELECT *, CAST(row_number() OVER (ORDER BY month_end) - 1 AS DOUBLE) AS x FROM m)
, g AS (SELECT count(*) AS n, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept, corr(x, v) AS r FROM s)
SELECT CAST(n AS BIGINT) AS n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r,
       round(CASE WHEN abs(r) < 1 THEN r * sqrt((n - 2) / (1.0 - r * r)) END, 6) AS t_stat FROM g WHERE n >= 2""")
def q_w7(spark, sf):
    m = ts.monthly_mean(read_table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(ts.linear_trend(m, "month_end", "o_totalprice", with_p=False))


@register("W7_linear_trend_with_pvalue_by_status")
def q_w7p(spark, sf):
    m = ts.monthly_mean(read_table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderstatus"])
    return rounded(ts.linear_trend(m, "month_end", "o_totalprice", ["o_orderstatus"]))


@register("W8_adf_monthly_revenue_by_status")
def q_w8(spark, sf):
    m = ts.monthly_mean(read_table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderstatus"])
    return rounded(ts.adf_by_key(m, "o_orderstatus", "month_end", "o_totalprice"))


@register("W8_adf_daily_event_value_by_type")
def q_w8b(spark, sf):
    e = read_table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    d = e.groupBy("event_type", "day").agg(F.avg("value").alias("value"))
    return rounded(ts.adf_by_key(d, "event_type", "day", "value"))


@register("W10_group_rank_terciles_rep_revenue", with_views("""
, g AS (SELECT rep, avg(rev) AS mean, count(*) AS n FROM sales WHERE rep IS NOT NULL GROUP BY rep)
, r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, CAST(rep AS VARCHAR)) AS rn, count(*) OVER () AS k FROM g)
SELECT rep, round(mean, 6) AS mean, n, CAST(rn AS BIGINT) AS rank,
       CASE WHEN rn <= ceil(k / 3.0) THEN 'top' WHEN rn <= ceil(2 * (k / 3.0)) THEN 'middle' ELSE 'bottom' END AS tier
FROM r""", "sales"))
def q_w10(spark, sf):
    return rounded(ts.group_rank_terciles(sales_view(spark, sf), "rep", "rev"))


@register("W11_quintile_bands_rep_revenue", with_views("""
, g AS (SELECT rep, sum(rev) AS total FROM sales WHERE rep IS NOT NULL GROUP BY rep ORDER BY total DESC, rep LIMIT 20)
, r AS (SELECT *, row_number() OVER (ORDER BY total DESC, rep) AS pos, count(*) OVER () AS n FROM g)
SELECT rep, round(total, 2) AS total, CAST(pos AS BIGINT) AS rank,
       CAST(floor((pos - 1) / CAST(n AS DOUBLE) * 5) + 1 AS INTEGER) AS quintile FROM r""", "sales"))
def q_w11(spark, sf):
    return rounded(ts.quintile_bands(sales_view(spark, sf), "rep", "rev"), {"total": 2})


@register("W12_consecutive_diff_orderkey", """
WITH d AS (SELECT CAST(o_orderkey AS DOUBLE) AS v FROM orders WHERE o_orderkey IS NOT NULL)
, s AS (SELECT v - lag(v) OVER (ORDER BY v) AS diff FROM d)
SELECT CAST(count(diff) AS BIGINT) AS n_diffs, round(avg(CASE WHEN diff = 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE diff IS NOT NULL), 6) AS ratio_diff_one FROM s""")
def q_w12(spark, sf):
    return rounded(ts.consecutive_diff_ratio(read_table(spark, sf, "orders"), "o_orderkey"))


@register("W12_consecutive_diff_quantity", """
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS v FROM lineitem WHERE l_quantity IS NOT NULL)
, s AS (SELECT v - lag(v) OVER (ORDER BY v) AS diff FROM d)
SELECT CAST(count(diff) AS BIGINT) AS n_diffs, round(avg(CASE WHEN diff = 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE diff IS NOT NULL), 6) AS ratio_diff_one FROM s""")
def q_w12b(spark, sf):
    return rounded(ts.consecutive_diff_ratio(read_table(spark, sf, "lineitem"), "l_quantity"))


@register("W13_sorted_group_mean_revenue_by_quantity", with_views("""
SELECT reviews, round(avg(revenue), 6) AS revenue FROM ecommerce WHERE reviews IS NOT NULL GROUP BY reviews""",
    "ecommerce"))
def q_w13(spark, sf):
    return rounded(ts.sorted_group_mean(ecommerce_view(spark, sf), "reviews", "revenue"))
