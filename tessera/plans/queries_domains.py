"""Registered queries: domain operators (N-*) on the bound domain views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.domains import ecommerce as ec, finance as fin, hr, sales as sl
from .catalog import register, rounded
from .views import ecommerce_view, finance_view, hr_view, sales_view, with_views

LEFT = """CASE WHEN lower(trim(CAST("left" AS VARCHAR))) IN ('yes', '1', '1.0', 'true', 'left') THEN 1 ELSE 0 END"""


def kv(df):
    return rounded(df.select("label", "value"), default=4)


# ------------------------------------------------------------------ HR
@register("N1_attrition_rate_hr", with_views(f"""
, a AS (SELECT sum({LEFT}) AS n_left, count(*) AS n_total FROM hr)
SELECT round(n_left / greatest(n_total, 1) * 100.0, 6) AS rate, CAST(n_left AS BIGINT) AS n_left, CAST(n_total AS BIGINT) AS n_total,
       CASE WHEN n_left * 100.0 / n_total > 25 THEN 'critical' WHEN n_left * 100.0 / n_total > 18 THEN 'high'
            WHEN n_left * 100.0 / n_total > 12 THEN 'warning' ELSE 'normal' END AS severity FROM a""", "hr"))
def q_n1(spark, sf):
    return rounded(hr.attrition(hr_view(spark, sf), "left"))


@register("N2_attrition_by_dept_hr", with_views(f"""
SELECT dept, CAST(count(*) AS BIGINT) AS n, CAST(sum({LEFT}) AS BIGINT) AS n_left, round(avg({LEFT}) * 100.0, 6) AS attrition_pct,
       round(avg(satisfaction), 6) AS avg_satisfaction, round(avg(evaluation), 6) AS avg_evaluation
FROM hr WHERE dept IS NOT NULL GROUP BY dept""", "hr"))
def q_n2(spark, sf):
    return rounded(hr.attrition_by(hr_view(spark, sf), "left", "dept", ["satisfaction", "evaluation"]))


@register("N3_numeric_drivers_of_attrition_hr")
def q_n3(spark, sf):
    return rounded(hr.numeric_drivers(hr_view(spark, sf), "left", ["satisfaction", "tenure", "hours", "projects"]))


@register("N4_categorical_drivers_of_attrition_hr")
def q_n4(spark, sf):
    return rounded(hr.categorical_drivers(hr_view(spark, sf), "left", ["dept", "salary"]))


FLIGHT_SQL = """
, st AS (SELECT * FROM hr WHERE {left} = 0)
, t AS (SELECT quantile_cont(satisfaction, {pct}) AS thr FROM st)
SELECT round(thr, 6) AS satisfaction_threshold, CAST(count(*) AS BIGINT) AS n_stayers,
       CAST(count(*) FILTER (WHERE satisfaction < thr {extra}) AS BIGINT) AS n_flight_risk,
       round(count(*) FILTER (WHERE satisfaction < thr {extra}) / greatest(count(*), 1) * 100.0, 6) AS flight_risk_pct
FROM st, t GROUP BY thr"""


@register("N5_flight_risk_engine_hr", with_views(FLIGHT_SQL.format(left=LEFT, pct=0.25, extra=""), "hr"))
def q_n5(spark, sf):
    return rounded(hr.flight_risk(hr_view(spark, sf), "left", "satisfaction", 0.25))


@register("N6_flight_risk_page_hr", with_views(FLIGHT_SQL.format(
    left=LEFT, pct=0.4, extra="AND tenure >= 3 AND CASE WHEN lower(trim(CAST(promotion AS VARCHAR))) IN ('yes', '1', '1.0', 'true', 'left') THEN 1 ELSE 0 END = 0"), "hr"))
def q_n6(spark, sf):
    return rounded(hr.flight_risk(hr_view(spark, sf), "left", "satisfaction", 0.40, tenure="tenure", min_tenure=3,
                                  promotion="promotion"))


TENURE_CASE = """CASE WHEN tenure > 0 AND tenure <= 2 THEN '1–2 yrs' WHEN tenure > 2 AND tenure <= 4 THEN '3–4 yrs'
     WHEN tenure > 4 AND tenure <= 6 THEN '5–6 yrs' WHEN tenure > 6 AND tenure <= 8 THEN '7–8 yrs'
     WHEN tenure > 8 AND tenure <= 99 THEN '9+ yrs' END"""


@register("N7_tenure_cohorts_hr", with_views(f"""
, b AS (SELECT {TENURE_CASE} AS band, {LEFT} AS l, satisfaction, hours FROM hr)
SELECT band, CAST(count(*) AS BIGINT) AS n, CAST(sum(l) AS BIGINT) AS n_left, round(avg(l) * 100.0, 6) AS rate,
       round(avg(satisfaction), 6) AS avg_satisfaction, round(avg(hours), 6) AS avg_hours
FROM b WHERE band IS NOT NULL GROUP BY band""", "hr"))
def q_n7(spark, sf):
    return rounded(hr.tenure_cohorts(hr_view(spark, sf), "left", "tenure", "satisfaction", "hours"))


@register("N8_satisfaction_bins_hr", with_views(f"""
, b AS (SELECT CAST(ceil((satisfaction - 0.05) / 0.05) AS BIGINT) AS k, {LEFT} AS l FROM hr
        WHERE satisfaction > 0.05 AND satisfaction <= 1.0)
SELECT round(CAST(0.05 AS DOUBLE) + (k - 0.5) * CAST(0.05 AS DOUBLE), 6) AS mid, CAST(count(*) AS BIGINT) AS n, round(avg(l) * 100.0, 6) AS rate
FROM b GROUP BY k""", "hr"))
def q_n8(spark, sf):
    return rounded(hr.satisfaction_bins(hr_view(spark, sf), "left", "satisfaction"))


SAL = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("N9_tenure_salary_heatmap_hr", with_views(f"""
, b AS (SELECT {TENURE_CASE} AS band, salary, {LEFT} AS l FROM hr WHERE salary IS NOT NULL)
SELECT band, {", ".join(f"round(coalesce(avg(l) FILTER (WHERE salary = '{s}') * 100.0, 0.0), 6) AS \"{s}\"" for s in SAL)}
FROM b WHERE band IS NOT NULL GROUP BY band""", "hr"))
def q_n9(spark, sf):
    return rounded(hr.tenure_salary_heatmap(hr_view(spark, sf), "left", "tenure", "salary", SAL))


@register("N10_hr_kpis", with_views(f"""
, a AS (SELECT count(*) AS n, avg({LEFT}) AS att, avg(satisfaction) AS sat, avg(evaluation) AS ev,
               quantile_cont(tenure, 0.5) AS med_t,
               avg(CASE WHEN lower(salary) = '5-low' THEN {LEFT} END) AS lo, avg(CASE WHEN lower(salary) = '1-urgent' THEN {LEFT} END) AS hi FROM hr)
SELECT 'Total Records' AS label, round(CAST(n AS DOUBLE), 4) AS value FROM a
UNION ALL SELECT 'Attrition Rate', round(att * 100.0, 4) FROM a
UNION ALL SELECT 'Avg Satisfaction', round(sat, 4) FROM a
UNION ALL SELECT 'Median Tenure', round(med_t, 4) FROM a
UNION ALL SELECT 'Avg Evaluation', round(ev, 4) FROM a
UNION ALL SELECT 'Salary Attrition Gap', round((lo - hi) * 100.0, 4) FROM a""", "hr"))
def q_n10(spark, sf):
    return kv(hr.hr_kpis(hr_view(spark, sf), "left", "satisfaction", "tenure", "evaluation", "salary",
                         low="5-low", high="1-urgent"))


@register("N82_replacement_cost_hr", with_views(f"""
SELECT CAST(sum({LEFT}) AS BIGINT) AS n_left, round(avg(income), 6) AS avg_salary,
       round(sum({LEFT}) * avg(income) * 0.5, 4) AS cost_low, round(sum({LEFT}) * avg(income) * 1.5, 4) AS cost_high FROM hr""", "hr"))
def q_n82(spark, sf):
    out = hr.replacement_cost(hr_view(spark, sf), "left", "income")
    return rounded(out.withColumn("n_left", F.col("n_left").cast("bigint")), {"cost_low": 4, "cost_high": 4})


# ------------------------------------------------------------------ finance
@register("N20_gross_margin_finance", with_views("""
, a AS (SELECT sum(rev) AS r, sum(cost) AS c, count(*) FILTER (WHERE profit < 0) AS loss, count(*) AS n FROM finance)
SELECT round(r, 4) AS total_rev, round(c, 2) AS total_cost, round((r - c) * 100.0 / r, 6) AS gross_margin_pct,
       CAST(loss AS BIGINT) AS loss_rows, round(loss * 100.0 / n, 6) AS loss_pct,
       CASE WHEN (r - c) * 100.0 / r < 10 THEN 'critical' WHEN (r - c) * 100.0 / r < 25 THEN 'warning' ELSE 'healthy' END AS tier FROM a""",
    "finance"))
def q_n20(spark, sf):
    return rounded(fin.gross_margin(finance_view(spark, sf), "rev", "cost", "profit"), {"total_rev": 4, "total_cost": 2})


@register("N21_revenue_trend_halves_finance")
def q_n21(spark, sf):
    return rounded(fin.revenue_trend(finance_view(spark, sf), "rev", "period"), {"first_half": 4, "second_half": 4})


@register("N22_budget_variance_finance", with_views("""
, a AS (SELECT sum(budget) AS b, sum(actual) AS ac, count(*) FILTER (WHERE actual > budget) AS o,
               count(*) FILTER (WHERE actual < budget) AS u FROM finance)
SELECT round(b, 2) AS total_budget, round(ac, 4) AS total_actual, CAST(o AS BIGINT) AS over_budget_rows,
       CAST(u AS BIGINT) AS under_budget_rows, round((ac - b) * 100.0 / b, 6) AS variance_pct,
       CASE WHEN abs((ac - b) * 100.0 / b) > 20 THEN 'critical' WHEN abs((ac - b) * 100.0 / b) > 10 THEN 'warning'
            ELSE 'on_track' END AS tier FROM a""", "finance"))
def q_n22(spark, sf):
    return rounded(fin.budget_variance(finance_view(spark, sf), "budget", "actual"),
                   {"total_budget": 2, "total_actual": 4})


@register("N23_budget_vs_actual_by_period_top12", with_views("""
, g AS (SELECT period, sum(budget) AS budget, sum(actual) AS actual FROM finance WHERE period IS NOT NULL GROUP BY period)
SELECT period, round(budget, 2) AS budget, round(actual, 4) AS actual, round(actual - budget, 4) AS variance,
       round((actual - budget) * 100.0 / budget, 6) AS variance_pct
FROM g ORDER BY abs((actual - budget) * 100.0 / budget) DESC NULLS LAST, period LIMIT 12""", "finance"))
def q_n23(spark, sf):
    return rounded(fin.budget_vs_actual_by(finance_view(spark, sf), "period", "budget", "actual"),
                   {"budget": 2, "actual": 4, "variance": 4})


@register("N24_cost_concentration_and_opex_ratio", with_views("""
, g AS (SELECT cat, sum(cost) AS c FROM finance WHERE cat IS NOT NULL GROUP BY cat)
, r AS (SELECT *, row_number() OVER (ORDER BY c DESC, cat) AS rk FROM g)
, t AS (SELECT sum(cost) FILTER (WHERE cat IS NOT NULL) AS tc, sum(rev) AS tr, sum(opex) AS topx FROM finance)
SELECT (SELECT cat FROM r WHERE rk = 1) AS top_category,
       round((SELECT c FROM r WHERE rk = 1) / tc * 100.0, 6) AS top_share_pct,
       round((SELECT sum(c) FROM r WHERE rk <= 2) / tc * 100.0, 6) AS top2_share_pct,
       (SELECT c FROM r WHERE rk = 1) / tc * 100.0 > 60 AS concentrated,
       round(topx / tr * 100.0, 6) AS opex_ratio_pct, topx / tr * 100.0 > 80 AS opex_high FROM t""", "finance"))
def q_n24(spark, sf):
    return rounded(fin.cost_concentration(finance_view(spark, sf), "cat", "cost", "rev", "opex"))


@register("N25_revenue_concentration_cost_growth", with_views("""
, g AS (SELECT cat, sum(rev) AS r FROM finance WHERE cat IS NOT NULL GROUP BY cat)
, top AS (SELECT cat, r FROM g ORDER BY r DESC, cat LIMIT 1)
, p AS (SELECT period, sum(cost) AS c FROM finance WHERE period IS NOT NULL GROUP BY period)
, gr AS (SELECT (arg_max(c, period) - arg_min(c, period)) * 100.0 / arg_min(c, period) AS growth FROM p)
SELECT top.cat AS top_category, round(top.r / (SELECT sum(r) FROM g) * 100.0, 6) AS top_share_pct,
       top.r / (SELECT sum(r) FROM g) * 100.0 > 50 AS revenue_concentrated,
       round(growth, 6) AS cost_growth_pct, growth > 15 AS cost_growth_high FROM top, gr""", "finance"))
def q_n25(spark, sf):
    return rounded(fin.revenue_concentration(finance_view(spark, sf), "cat", "rev", "cost", "period"))


@register("N26_pnl_summary_finance", with_views("""
, a AS (SELECT sum(rev) AS r, sum(cost) AS c, sum(opex) AS o FROM finance)
SELECT 1 AS line_no, 'Revenue' AS line, round(r, 4) AS amount, round(100.0, 6) AS pct_of_revenue FROM a
UNION ALL SELECT 2, 'Cost of Goods', round(c, 4), round(c * 100.0 / r, 6) FROM a
UNION ALL SELECT 3, 'Gross Profit', round(r - c, 4), round((r - c) * 100.0 / r, 6) FROM a
UNION ALL SELECT 4, 'Operating Expenses', round(o, 4), round(o * 100.0 / r, 6) FROM a
UNION ALL SELECT 5, 'Operating Profit (proxy)', round(r - c - o, 4), round((r - c - o) * 100.0 / r, 6) FROM a""", "finance"))
def q_n26(spark, sf):
    return rounded(fin.pnl_summary(finance_view(spark, sf), "rev", "cost", "opex"), {"amount": 4})


@register("N27_cost_by_category_top10", with_views("""
, g AS (SELECT cat, sum(cost) AS cost FROM finance WHERE cat IS NOT NULL GROUP BY cat ORDER BY cost DESC, cat LIMIT 10)
, t AS (SELECT sum(cost) AS tc FROM finance)
SELECT cat, round(cost, 2) AS cost, CAST(row_number() OVER (ORDER BY cost DESC, cat) AS BIGINT) AS rank,
       round(cost / tc * 100.0, 6) AS share_pct,
       round(sum(cost / tc * 100.0) OVER (ORDER BY cost DESC, cat ROWS UNBOUNDED PRECEDING), 6) AS cum_share_pct FROM g, t""",
    "finance"))
def q_n27(spark, sf):
    return rounded(fin.cost_by_category(finance_view(spark, sf), "cat", "cost"), {"cost": 2})


@register("N28_revenue_cost_by_period", with_views("""
SELECT period, round(sum(rev), 4) AS revenue, round(sum(cost), 2) AS cost, round(sum(rev) - sum(cost), 4) AS profit,
       round((sum(rev) - sum(cost)) * 100.0 / sum(rev), 6) AS margin_pct FROM finance WHERE period IS NOT NULL GROUP BY period""",
    "finance"))
def q_n28(spark, sf):
    return rounded(fin.revenue_cost_by_period(finance_view(spark, sf), "period", "rev", "cost"),
                   {"revenue": 4, "cost": 2, "profit": 4})


@register("N29_category_profitability", with_views("""
SELECT cat, round(sum(rev), 4) AS revenue, round(sum(rev) - sum(cost), 4) AS gross_profit,
       round((sum(rev) - sum(cost)) * 100.0 / sum(rev), 6) AS margin_pct FROM finance WHERE cat IS NOT NULL GROUP BY cat""",
    "finance"))
def q_n29(spark, sf):
    return rounded(fin.category_profitability(finance_view(spark, sf), "cat", "rev", "cost"),
                   {"revenue": 4, "gross_profit": 4})


@register("N30_finance_kpis", with_views("""
, a AS (SELECT sum(rev) AS r, sum(cost) AS c, sum(profit) AS p, sum(opex) AS o,
               avg(CASE WHEN budget <> 0 THEN (actual - budget) * 100.0 / budget END) AS rv FROM finance)
SELECT 'Total Revenue' AS label, round(r, 4) AS value FROM a
UNION ALL SELECT 'Gross Margin', round((r - c) * 100.0 / r, 4) FROM a
UNION ALL SELECT 'Net Profit', round(p, 4) FROM a
UNION ALL SELECT 'Avg Budget Variance', round(rv, 4) FROM a
UNION ALL SELECT 'OpEx Ratio', round(o * 100.0 / r, 4) FROM a""", "finance"))
def q_n30(spark, sf):
    return kv(fin.finance_kpis(finance_view(spark, sf), "rev", "cost", "profit", "budget", "actual", "opex"))


# ------------------------------------------------------------------ e-commerce
@register("N40_rating_analysis", with_views("""
, v AS (SELECT rating AS x FROM ecommerce WHERE rating IS NOT NULL)
, q AS (SELECT count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, stddev_samp(x) AS std,
               quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v)
SELECT CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std,
       CAST((SELECT count(*) FROM v WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers,
       CAST((SELECT count(*) FROM ecommerce WHERE rating < 3.0) AS BIGINT) AS n_below_3,
       CASE WHEN mean < 3.5 THEN 'critical' WHEN mean < 4.0 THEN 'warning' ELSE 'healthy' END AS tier FROM q""", "ecommerce"))
def q_n40(spark, sf):
    return rounded(ec.rating_analysis(ecommerce_view(spark, sf), "rating"))


@register("N41_category_rating_gap", with_views("""
, g AS (SELECT category, avg(rating) AS avg_rating, count(*) AS n FROM ecommerce WHERE category IS NOT NULL GROUP BY category HAVING count(*) >= 5)
, e AS (SELECT max(avg_rating) - min(avg_rating) AS gap FROM g)
SELECT category, round(avg_rating, 6) AS avg_rating, CAST(n AS BIGINT) AS n, round(gap, 6) AS gap,
       CASE WHEN gap > 0.8 THEN 'critical' WHEN gap > 0.3 THEN 'warning' ELSE 'ok' END AS gap_severity FROM g, e""", "ecommerce"))
def q_n41(spark, sf):
    return rounded(ec.category_gap(ecommerce_view(spark, sf), "category", "rating"))


@register("N42_price_discount_signals", with_views("""
, long AS (SELECT 'price' AS "column", price AS v FROM ecommerce UNION ALL SELECT 'discount', discount FROM ecommerce)
, s AS (SELECT "column", count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
               skewness(v) * (count(v) - 2) / sqrt(count(v) * (count(v) - 1.0)) AS skew FROM long WHERE v IS NOT NULL GROUP BY "column")
SELECT "column", round(mean, 6) AS mean, round(median, 6) AS median, round(skew, 6) AS skew,
       CASE WHEN "column" = 'price' AND skew > 1.5 THEN 'right-skewed prices'
            WHEN "column" = 'discount' AND mean > 55 THEN 'critical discount erosion'
            WHEN "column" = 'discount' AND mean > 40 THEN 'discount erosion' ELSE 'ok' END AS signal FROM s WHERE n >= 3""",
    "ecommerce"))
def q_n42(spark, sf):
    return rounded(ec.price_discount_signals(ecommerce_view(spark, sf), "price", "discount"))


@register("N43_price_rating_link")
def q_n43(spark, sf):
    return rounded(ec.price_rating_link(ecommerce_view(spark, sf), "price", "rating"))


RB = ["<2", "2–3", "3–3.5", "3.5–4", "4–5"]


@register("N44_price_quintile_by_rating_band", with_views(f"""
, d AS (SELECT price, rating FROM ecommerce WHERE price IS NOT NULL AND rating IS NOT NULL)
, q AS (SELECT quantile_cont(price, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM d)
, b AS (SELECT CASE WHEN price >= e[1] AND price <= e[2] THEN 'Bottom 20%' WHEN price > e[2] AND price <= e[3] THEN '20–40%'
                    WHEN price > e[3] AND price <= e[4] THEN '40–60%' WHEN price > e[4] AND price <= e[5] THEN '60–80%'
                    WHEN price > e[5] AND price <= e[6] THEN 'Top 20%' END AS price_band,
               CASE WHEN rating > 0 AND rating <= 2 THEN '<2' WHEN rating > 2 AND rating <= 3 THEN '2–3'
                    WHEN rating > 3 AND rating <= 3.5 THEN '3–3.5' WHEN rating > 3.5 AND rating <= 4 THEN '3.5–4'
                    WHEN rating > 4 AND rating <= 5 THEN '4–5' END AS rating_band FROM d, q)
SELECT price_band, {", ".join(f"CAST(count(*) FILTER (WHERE rating_band = '{r}') AS BIGINT) AS \"{r}\"" for r in RB)}
FROM b WHERE price_band IS NOT NULL AND rating_band IS NOT NULL GROUP BY price_band""", "ecommerce"))
def q_n44(spark, sf):
    return ec.price_rating_matrix(ecommerce_view(spark, sf), "price", "rating")


@register("N45_ecommerce_kpis", with_views("""
, a AS (SELECT count(*) AS n, avg(price) AS p, avg(rating) AS r, avg(discount) AS d, sum(revenue) AS rev, sum(reviews) AS rv FROM ecommerce)
SELECT 'Products' AS label, round(CAST(n AS DOUBLE), 4) AS value FROM a
UNION ALL SELECT 'Avg Price', round(p, 4) FROM a UNION ALL SELECT 'Avg Rating', round(r, 4) FROM a
UNION ALL SELECT 'Avg Discount', round(d, 4) FROM a UNION ALL SELECT 'Total Revenue', round(rev, 4) FROM a
UNION ALL SELECT 'Total Reviews', round(rv, 4) FROM a""", "ecommerce"))
def q_n45(spark, sf):
    return kv(ec.ecommerce_kpis(ecommerce_view(spark, sf), "price", "rating", "discount", "revenue", "reviews"))


@register("N45_discount_rating_ols", with_views("""
SELECT CAST(count(*) AS BIGINT) AS n, round(regr_slope(rating, discount), 6) AS slope, round(regr_intercept(rating, discount), 6) AS intercept
FROM ecommerce WHERE discount IS NOT NULL AND rating IS NOT NULL""", "ecommerce"))
def q_n45b(spark, sf):
    return rounded(ec.discount_rating_trend(ecommerce_view(spark, sf), "discount", "rating"))


# ------------------------------------------------------------------ sales
@register("N60_revenue_overview_sales", with_views("""
, s AS (SELECT count(rev) AS n, avg(rev) AS mean, quantile_cont(rev, 0.5) AS median, stddev_samp(rev) AS std,
               skewness(rev) * (count(rev) - 2) / sqrt(count(rev) * (count(rev) - 1.0)) AS skew FROM sales WHERE rev IS NOT NULL)
SELECT CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std,
       round(std / abs(mean), 6) AS cv, round(skew, 6) AS skew, std / abs(mean) > 0.5 AS volatile,
       CASE WHEN skew > 1.5 THEN 'highly concentrated' WHEN skew > 1 THEN 'concentrated' ELSE 'balanced' END AS distribution FROM s""",
    "sales"))
def q_n60(spark, sf):
    return rounded(sl.revenue_overview(sales_view(spark, sf), "rev"))


@register("N61_target_achievement_sales", with_views("""
, a AS (SELECT avg(rev) AS r, avg(target) AS t FROM sales)
SELECT round(r, 6) AS avg_rev, round(t, 6) AS avg_target, round(r * 100.0 / t, 6) AS achievement_pct,
       CASE WHEN r * 100.0 / t < 70 THEN 'critical' WHEN r * 100.0 / t < 80 THEN 'warning'
            WHEN r * 100.0 / t < 100 THEN 'below target' ELSE 'on target' END AS tier FROM a""", "sales"))
def q_n61(spark, sf):
    return rounded(sl.target_achievement(sales_view(spark, sf), "rev", "target"))


@register("N62_regional_gap_sales", with_views("""
, g AS (SELECT region, sum(rev) AS revenue, avg(rev) AS avg_revenue, count(rev) AS n FROM sales WHERE region IS NOT NULL
        GROUP BY region HAVING count(rev) >= 3)
, t AS (SELECT sum(revenue) AS tr, (SELECT avg_revenue FROM g ORDER BY revenue DESC, region DESC LIMIT 1) AS b,
               (SELECT avg_revenue FROM g ORDER BY revenue, region LIMIT 1) AS w FROM g)
SELECT region, round(revenue, 2) AS revenue, round(avg_revenue, 6) AS avg_revenue, CAST(n AS BIGINT) AS n,
       round(revenue / tr * 100.0, 6) AS share_pct, round((b - w) * 100.0 / greatest(w, 1), 6) AS best_worst_gap_pct FROM g, t""", "sales"))
def q_n62(spark, sf):
    return rounded(sl.regional_gap(sales_view(spark, sf), "region", "rev"), {"revenue": 2})


@register("N63_product_concentration_sales", with_views("""
, g AS (SELECT product, sum(rev) AS r FROM sales WHERE product IS NOT NULL GROUP BY product HAVING count(rev) >= 3)
, t AS (SELECT sum(r) AS tr FROM g)
, top AS (SELECT product, r FROM g ORDER BY r DESC, product LIMIT 1)
, b3 AS (SELECT sum(r) AS s FROM (SELECT r FROM g ORDER BY r ASC, product LIMIT 3))
SELECT top.product AS top_product, round(top.r / tr * 100.0, 6) AS top_share_pct, top.r / tr * 100.0 > 40 AS concentrated,
       round(b3.s / tr * 100.0, 6) AS bottom3_share_pct FROM top, t, b3""", "sales"))
def q_n63(spark, sf):
    return rounded(sl.product_concentration(sales_view(spark, sf), "product", "rev"))


@register("N64_loss_rows_sales", with_views("""
SELECT CAST(count(*) FILTER (WHERE margin < 0) AS BIGINT) AS loss_rows, CAST(count(*) AS BIGINT) AS n,
       round(count(*) FILTER (WHERE margin < 0) * 100.0 / count(*), 6) AS loss_pct,
       count(*) FILTER (WHERE margin < 0) * 100.0 / count(*) > 10 AS flag FROM sales""", "sales"))
def q_n64(spark, sf):
    return rounded(sl.loss_rows(sales_view(spark, sf), "margin"))


@register("N65_rep_ranking_sales", with_views("""
, g AS (SELECT rep, sum(rev) AS revenue, count(*) AS deals, avg(rev) AS avg_deal, sum(target) AS target FROM sales
        WHERE rep IS NOT NULL GROUP BY rep)
SELECT rep, round(revenue, 2) AS revenue, CAST(deals AS BIGINT) AS deals, round(avg_deal, 6) AS avg_deal,
       round(target, 4) AS target, round(revenue / (SELECT sum(rev) FROM sales) * 100.0, 6) AS share_pct,
       CAST(row_number() OVER (ORDER BY revenue DESC, rep) AS BIGINT) AS rank,
       round(revenue * 100.0 / target, 6) AS achievement_pct FROM g""", "sales"))
def q_n65(spark, sf):
    return rounded(sl.rep_ranking(sales_view(spark, sf), "rep", "rev", "target"), {"revenue": 2, "target": 4})


@register("N66_revenue_vs_target_by_region", with_views("""
SELECT region, round(sum(rev), 2) AS revenue, round(sum(target), 4) AS target, round(sum(rev) * 100.0 / sum(target), 6) AS achievement_pct
FROM sales WHERE region IS NOT NULL GROUP BY region""", "sales"))
def q_n66(spark, sf):
    return rounded(sl.revenue_vs_target_by(sales_view(spark, sf), "region", "rev", "target"), {"revenue": 2, "target": 4})


@register("N66_margin_by_segment_gap", with_views("""
, g AS (SELECT CAST(region AS VARCHAR) AS name, count(*) AS n, avg(CAST(margin AS DOUBLE)) AS mean FROM sales WHERE region IS NOT NULL AND margin IS NOT NULL GROUP BY 1)
, r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, name) AS k, count(*) OVER () AS c, max(mean) OVER () AS top FROM g)
SELECT name, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(top - mean, 6) AS below_best,
       CASE WHEN k = 1 THEN 'best' WHEN k = c THEN 'worst' ELSE 'middle' END AS position FROM r""", "sales"))
def q_n66m(spark, sf):
    return rounded(sl.margin_by_segment(sales_view(spark, sf), "region", "margin"))


@register("N67_deal_size_histogram", with_views("""
, v AS (SELECT CAST(rev AS DOUBLE) AS x FROM sales WHERE rev IS NOT NULL)
, s AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.8) AS p80 FROM v)
, b AS (SELECT least(CAST(floor((x - lo) / ((hi - lo) / 20)) AS BIGINT), 19) AS bin, count(*) AS c FROM v, s GROUP BY 1)
SELECT CAST(k AS BIGINT) AS bin, round(lo + k * ((hi - lo) / 20), 6) AS bin_lo, round(lo + (k + 1) * ((hi - lo) / 20), 6) AS bin_hi,
       CAST(coalesce(c, 0) AS BIGINT) AS "count", round(mean, 6) AS mean, round(med, 6) AS median, lo + k * ((hi - lo) / 20) > p80 AS above_p80
FROM range(20) t(k) CROSS JOIN s LEFT JOIN b ON b.bin = k""", "sales"))
def q_n67h(spark, sf):
    return rounded(sl.deal_size_histogram(sales_view(spark, sf), "rev"))


@register("N67_deal_size_distribution", with_views("""
SELECT CAST(count(rev) AS BIGINT) AS n, round(quantile_cont(rev, 0.5), 6) AS median_deal, round(quantile_cont(rev, 0.8), 6) AS p80_deal
FROM sales WHERE rev IS NOT NULL""", "sales"))
def q_n67(spark, sf):
    return rounded(sl.deal_size_distribution(sales_view(spark, sf), "rev"))


@register("N68_sales_kpis", with_views("""
, a AS (SELECT sum(rev) AS r, sum(target) AS t, avg(margin) AS m,
               avg(CASE WHEN lower(trim(won)) IN ('won', 'yes', '1', 'true', 'closed won') THEN 1 ELSE 0 END) AS w FROM sales)
, top AS (SELECT max(s) AS tr FROM (SELECT sum(rev) AS s FROM sales WHERE rep IS NOT NULL GROUP BY rep))
SELECT 'Total Revenue' AS label, round(r, 4) AS value FROM a
UNION ALL SELECT 'Quota Attainment', round(r * 100.0 / t, 4) FROM a
UNION ALL SELECT 'Top Rep Share', round(tr * 100.0 / r, 4) FROM a, top
UNION ALL SELECT 'Avg Margin', round(m, 4) FROM a
UNION ALL SELECT 'Win Rate', round(w * 100.0, 4) FROM a""", "sales"))
def q_n68(spark, sf):
    return kv(sl.sales_kpis(sales_view(spark, sf), "rev", "target", "rep", "margin", "won"))


def _mwu_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS "column", flag, CAST({c} AS DOUBLE) AS v FROM (SELECT {LEFT} = 1 AS flag, {c} FROM hr) WHERE {c} IS NOT NULL""")
    long = " UNION ALL ".join(parts)
    return f"""
, long AS ({long})
, r AS (SELECT *, rank() OVER (PARTITION BY "column" ORDER BY v) + (count(*) OVER (PARTITION BY "column", v) - 1) / 2.0 AS rk FROM long)
, s AS (SELECT "column", count(*) FILTER (WHERE flag) AS n1, count(*) FILTER (WHERE NOT flag) AS n2,
               sum(rk) FILTER (WHERE flag) AS r1, avg(v) FILTER (WHERE flag) AS lm, avg(v) FILTER (WHERE NOT flag) AS sm FROM r GROUP BY 1)
, t AS (SELECT "column", sum(c * c * c - c) AS tt FROM (SELECT "column", v, count(*) AS c FROM long GROUP BY 1, 2) GROUP BY 1)
, u AS (SELECT s.*, tt, r1 - n1 * (n1 + 1) / 2.0 AS u1 FROM s JOIN t USING ("column"))
SELECT "column", round(lm, 6) AS left_mean, round(sm, 6) AS stay_mean, CAST(n1 AS BIGINT) AS n_flag, CAST(n2 AS BIGINT) AS n_rest,
       round(u1, 6) AS u_stat,
       round((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tt / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) AS z,
       round((lm - sm) * 100.0 / abs(sm), 6) AS diff_pct FROM u WHERE n1 >= 5 AND n2 >= 5"""


@register("N3_numeric_drivers_stats_hr", with_views(_mwu_sql(["satisfaction", "tenure", "hours", "projects"]), "hr"))
def q_n3s(spark, sf):
    return rounded(hr.numeric_drivers(hr_view(spark, sf), "left", ["satisfaction", "tenure", "hours", "projects"],
                                      with_p=False))


@register("N4_categorical_drivers_stats_hr", with_views(f"""
, long AS (SELECT 'dept' AS "column", {LEFT} = 1 AS flag, CAST(dept AS VARCHAR) AS v FROM hr
           UNION ALL SELECT 'salary', {LEFT} = 1, CAST(salary AS VARCHAR) FROM hr)
, rates AS (SELECT "column", v, avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END) * 100.0 AS rate FROM long WHERE v IS NOT NULL GROUP BY 1, 2)
, ext AS (SELECT "column", arg_max(v, (rate, v)) AS worst_category, max(rate) AS worst_rate,
                 arg_min(v, (rate, v)) AS best_category, min(rate) AS best_rate FROM rates GROUP BY 1)
, obs AS (SELECT "column", v, flag, count(*) AS o FROM long WHERE v IS NOT NULL GROUP BY 1, 2, 3)
, ra AS (SELECT "column", v, sum(o) AS na FROM obs GROUP BY 1, 2), rb AS (SELECT "column", flag, sum(o) AS nb FROM obs GROUP BY 1, 2)
, n AS (SELECT "column", sum(o) AS n, count(DISTINCT v) AS ka, count(DISTINCT flag) AS kb FROM obs GROUP BY 1)
, cells AS (SELECT ra."column", coalesce(obs.o, 0) AS o, na * nb / CAST(n.n AS DOUBLE) AS e, n.n, ka, kb
            FROM ra JOIN rb ON ra."column" = rb."column" JOIN n ON n."column" = ra."column"
            LEFT JOIN obs ON obs."column" = ra."column" AND obs.v = ra.v AND obs.flag = rb.flag)
, chi AS (SELECT "column", any_value(n) AS n, any_value((ka - 1) * (kb - 1)) AS dof, sum(pow(o - e, 2) / e) AS chi2 FROM cells GROUP BY 1)
SELECT ext."column", worst_category, round(worst_rate, 6) AS worst_rate, best_category, round(best_rate, 6) AS best_rate,
       CAST(n AS BIGINT) AS n, CAST(dof AS BIGINT) AS dof, round(chi2, 6) AS chi2 FROM ext JOIN chi USING ("column")""", "hr"))
def q_n4s(spark, sf):
    return rounded(hr.categorical_drivers(hr_view(spark, sf), "left", ["dept", "salary"], with_p=False))
