"""Registered queries: insights, recommendations and story (A-14, D-7..D-10,
N-11, N-80, Q-8, E-4, B-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import bi, corr, distribution as dist, hypothesis as hyp, insights as ins
from ..operators.timeseries import monthly_mean
from ..operators import profile as prof
from ..operators.domains import hr
from ..sources.tables import read_table
from .catalog import register, rounded
from .views import ecommerce_view, hr_view, messy_view, sales_view

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("A14_top_decile_opportunity_orders_lineitem", """
WITH long AS (SELECT 'o_totalprice' AS "column", CAST(o_totalprice AS DOUBLE) AS value FROM orders
              UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders)
, v AS (SELECT * FROM long WHERE value IS NOT NULL)
, s AS (SELECT "column", count(*) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50,
               quantile_cont(value, 0.9) AS p90, avg(value) AS mean, stddev_samp(value) AS sd FROM v GROUP BY "column")
, c AS (SELECT *, CASE WHEN mean <> 0 THEN sd / abs(mean) * 100.0 ELSE 0.0 END AS cv FROM s WHERE n >= 20)
SELECT "column", round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, round(cv, 6) AS cv_pct,
       round(p90 / p50, 6) AS ratio, p50 > 0 AND p90 / p50 >= 2.0 AND cv > 40 AS is_opportunity FROM c""")
def q_a14(spark, sf):
    return rounded(ins.top_decile_opportunity(read_table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
                   .drop("text"))


@register("A14_top_decile_opportunity_page_form")
def q_a14b(spark, sf):
    return rounded(ins.top_decile_opportunity(sales_view(spark, sf), ["rev", "margin", "target"], ratio=1.5, min_cv=0.0))


@register("D7_anomalies_messy_and_orders")
def q_d7(spark, sf):
    return ins.anomalies(messy_view(spark, sf), ["linenumber", "l_quantity", "sparse_discount"]).unionByName(
        ins.anomalies(read_table(spark, sf, "customer"), ["c_acctbal"]))


@register("N80_general_insights_lineitem")
def q_n80(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return ins.general_insights(li, LI, corr.spearman_pairs(li, LI, with_p=False))


@register("Q8_quality_recommendations_messy")
def q_q8(spark, sf):
    m = messy_view(spark, sf)
    p = prof.column_profiles(m)
    return ins.quality_recommendations(p, prof.dataset_profile(m, p))


@register("D10_hr_top_insights")
def q_d10(spark, sf):
    return ins.hr_top_insights(hr_view(spark, sf), "left", dept="dept", satisfaction="satisfaction",
                               salary="salary", tenure="tenure", low="5-low", high="1-urgent",
                               numeric=["satisfaction", "hours", "tenure"])


@register("N11_hr_insights_rules")
def q_n11(spark, sf):
    return ins.hr_insights(hr_view(spark, sf), "left", satisfaction="satisfaction", hours="hours",
                           projects="projects", evaluation="evaluation")


@register("E4_eda_findings_orders")
def q_e4(spark, sf):
    o = read_table(spark, sf, "orders")
    uni = dist.univariate(o, ["o_totalprice", "o_custkey"])
    cr = corr.spearman_pairs(o, ["o_totalprice", "o_custkey"], with_p=False)
    grp = hyp.group_comparison(o, "o_totalprice", "o_orderstatus")
    v = corr.vif(o, ["o_totalprice", "o_custkey"])
    return ins.eda_findings(uni, cr, grp, v)


@register("B7_bi_insights_sales")
def q_b7(spark, sf):
    s = sales_view(spark, sf)
    return ins.bi_insights(bi.benchmark(s, ["rev", "margin"]), bi.pareto(s, "rep", "rev"),
                           bi.cohort(s, "region", "rev", with_p=False),
                           bi.segment_health(s, "region", ["rev", "margin"]))


@register("D8_story_hr")
def q_d8(spark, sf):
    h = hr_view(spark, sf)
    top = ins.hr_top_insights(h, "left", dept="dept", satisfaction="satisfaction", numeric=["satisfaction", "hours"])
    return rounded(ins.story(h, ["satisfaction", "hours"], "hr", top, hr.attrition(h, "left"),
                             corr.spearman_pairs(h, ["satisfaction", "hours", "tenure"], with_p=False)))


# ------------------------------------------------------------------ P-12
from ..operators import text as txt  # noqa: E402
from ..operators.text import DOMAIN_BLOCKS, FAKE_PHRASES, INVALID_OUTPUTS  # noqa: E402


def _first_sql(phrases) -> str:
    arms = " ".join("WHEN contains(lower(text), '{0}') THEN '{0}'".format(p.replace("'", "''")) for p in phrases)
    return f"CASE {arms} END"


@register("P12_text_quality_gate_documents", f"""
WITH g AS (SELECT doc_id, length(text) AS n_chars,
       CASE WHEN text IS NULL OR length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 40 THEN 'too short'
            WHEN {_first_sql(INVALID_OUTPUTS)} IS NOT NULL THEN 'blocked phrase: ' || {_first_sql(INVALID_OUTPUTS)}
            WHEN {_first_sql(FAKE_PHRASES)} IS NOT NULL THEN 'invented metric: ' || {_first_sql(FAKE_PHRASES)}
            WHEN {_first_sql(DOMAIN_BLOCKS['ecommerce'])} IS NOT NULL
                 THEN 'domain contamination: ' || {_first_sql(DOMAIN_BLOCKS['ecommerce'])}
       END AS reason FROM documents)
SELECT doc_id, CAST(n_chars AS INTEGER) AS n_chars, reason IS NULL AS passed, reason FROM g""")
def q_p12(spark, sf):
    return txt.text_quality_gate(read_table(spark, sf, "documents"), "text", "ecommerce", id_col="doc_id")


@register("P12_text_gate_summary_documents")
def q_p12s(spark, sf):
    return txt.gate_summary(txt.text_quality_gate(read_table(spark, sf, "documents"), "text", "sales"))


# ------------------------------------------------------------------ D-6 / D-11 / D-12
from ..operators import charts  # noqa: E402


@register("D6_recommend_charts_sales")
def q_d6(spark, sf):
    return charts.recommend_charts(sales_view(spark, sf), "sales")


@register("D6_chart_data_all_recommended_sales")
def q_d6b(spark, sf):
    s = sales_view(spark, sf)
    cols = charts.analysis_columns(s)
    specs = charts.recommend_charts(s, "sales", cols).collect()
    parts = [charts.chart_data(s, sp, cols).select(F.lit(sp["chart_id"]).alias("chart_id"),
                                                   F.to_json(F.struct("*")).alias("row")) for sp in specs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("D11_bar_chart_facts_revenue_by_region", """
WITH s AS (SELECT o_totalprice AS rev, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
, g AS (SELECT region, avg(rev) AS v FROM s WHERE region IS NOT NULL GROUP BY region)
, a AS (SELECT arg_max(region, v) AS top, max(v) AS tv, arg_min(region, v) AS worst, min(v) AS wv, count(*) AS k FROM g)
SELECT top, round(tv, 2) AS top_value, worst, round(wv, 2) AS worst_value, round((SELECT avg(rev) FROM s), 2) AS avg_value,
       CAST(k AS BIGINT) AS n_groups, round(abs(tv - wv) * 100.0 / greatest(abs(wv), 0.001), 6) AS gap_pct,
       CAST((SELECT count(*) FROM g WHERE v > (SELECT avg(rev) FROM s)) AS BIGINT) AS n_above_avg FROM a""")
def q_d11(spark, sf):
    return rounded(charts.bar_facts(sales_view(spark, sf), "region", "rev"), {"top_value": 2, "worst_value": 2, "avg_value": 2})


@register("D11_pie_facts_revenue_by_region", """
WITH s AS (SELECT o_totalprice AS rev, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey
           JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
, g AS (SELECT region, avg(rev) AS v FROM s WHERE region IS NOT NULL GROUP BY region)
, r AS (SELECT *, row_number() OVER (ORDER BY v DESC, region) AS i FROM g)
, a AS (SELECT max(region) FILTER (i = 1) AS top, sum(v) FILTER (i = 1) * 100.0 / sum(v) AS t1,
               sum(v) FILTER (i <= 2) * 100.0 / sum(v) AS t2, count(*) AS k FROM r)
SELECT top, round(t1, 6) AS top_share, round(t2, 6) AS top2_share, CAST(k AS BIGINT) AS n_segments, t1 < 40 AS balanced FROM a""")
def q_d11p(spark, sf):
    return rounded(charts.share_facts(sales_view(spark, sf), "region", "rev"))


@register("D11_trend_facts_monthly_order_price")
def q_d11t(spark, sf):
    m = monthly_mean(read_table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return rounded(charts.trend_facts(m, "month_end", "o_totalprice"))


@register("D12_bar_narrative_revenue_by_region")
def q_d12(spark, sf):
    return charts.bar_narrative(charts.bar_facts(sales_view(spark, sf), "region", "rev"), "region", "rev")


# ------------------------------------------------------------------ orchestrators
from ..operators import eda  # noqa: E402


@register("E3_run_eda_hr_group_comparisons")
def q_e3(spark, sf):
    h = hr_view(spark, sf).select("dept", "salary", "satisfaction", "hours", "tenure")
    return rounded(eda.run_eda(h, "hr")["group_comparisons"].drop("group_stats"))


@register("E3_run_eda_hr_findings")
def q_e3f(spark, sf):
    h = hr_view(spark, sf).select("dept", "salary", "satisfaction", "hours", "tenure")
    return eda.run_eda(h, "hr")["findings"]


@register("E6_numeric_stats_lineitem")
def q_e6(spark, sf):
    return rounded(eda.numeric_stats(read_table(spark, sf, "lineitem"), LI))


@register("E6_numeric_stats_customer_shapiro")
def q_e6s(spark, sf):
    return rounded(eda.numeric_stats(read_table(spark, sf, "customer"), ["c_acctbal", "c_custkey", "c_nationkey"]))


@register("E7_categorical_stats_orders", """
WITH long AS (SELECT 'o_orderstatus' AS "column", CAST(o_orderstatus AS VARCHAR) AS value FROM orders
              UNION ALL SELECT 'o_orderpriority', CAST(o_orderpriority AS VARCHAR) FROM orders)
, c AS (SELECT "column", value, count(*) AS cnt FROM long WHERE value IS NOT NULL GROUP BY ALL)
, m AS (SELECT "column", count(*) AS u, max(cnt) AS top FROM c GROUP BY "column")
, a AS (SELECT m."column", u, top, min(value) FILTER (WHERE cnt = top) AS top_value FROM m JOIN c ON c."column" = m."column" GROUP BY ALL)
SELECT "column", CAST(u AS BIGINT) AS n_unique, top_value, round(top * 100.0 / (SELECT count(*) FROM orders), 6) AS top_pct,
       CASE WHEN u <= 2 THEN 'binary' WHEN u <= 10 THEN 'low' WHEN u <= 50 THEN 'medium' ELSE 'high' END AS cardinality FROM a""")
def q_e7(spark, sf):
    return rounded(eda.categorical_stats(read_table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))


@register("E8_dataset_insights_orders")
def q_e8i(spark, sf):
    return eda.stats_analyze(read_table(spark, sf, "orders"))["insights"]


@register("E8_recommended_analyses_orders")
def q_e8(spark, sf):
    return eda.stats_analyze(read_table(spark, sf, "orders"))["recommended_analyses"]


@register("B6_run_bi_sales_pareto")
def q_b6(spark, sf):
    s = sales_view(spark, sf).select("region", "rev", "margin")
    return rounded(eda.run_bi(s, "sales")["pareto"])


@register("B6_run_bi_sales_root_cause")
def q_b6r(spark, sf):
    s = sales_view(spark, sf).select("region", "product", "rev", "margin", "target")
    return rounded(eda.run_bi(s, "sales")["root_cause"])
