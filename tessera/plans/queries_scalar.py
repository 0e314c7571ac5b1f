"""Registered queries: scalar helpers and small table operators
(P-2, P-4, P-5, P-8, P-9, P-10, P-13, V-9, A-3, A-9, A-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.binning import fixed_bins
from ..operators import aggregate as agg, select as sel, tools
from ..operators.domains.ecommerce import RATING_BAND_EDGES, RATING_BAND_LABELS
from ..sources.tables import read_table
from .catalog import register, rounded
from .views import ecommerce_view, hr_view, sales_view, with_views


@register("P2_truthy_flag_counts_hr", with_views("""
SELECT "left", CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN lower(trim(CAST("left" AS VARCHAR))) IN ('yes', '1', '1.0', 'true', 'left') THEN 1 ELSE 0 END) AS BIGINT) AS n_truthy
FROM hr GROUP BY "left" """, "hr"))
def q_p2(spark, sf):
    h = hr_view(spark, sf)
    return h.groupBy("left").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                 F.sum(sc.truthy("left")).cast("bigint").alias("n_truthy"))


@register("P4_head_preview_lineitem")
def q_p4(spark, sf):
    return sel.head(read_table(spark, sf, "lineitem"), 5, 10)


@register("V9_reproducible_sample_orders")
def q_v9(spark, sf):
    return sel.reproducible_sample(read_table(spark, sf, "orders"), 1000, key_cols=["o_orderkey"])


@register("P5_rating_bands_ecommerce", with_views("""
SELECT CASE WHEN rating > 0 AND rating <= 2 THEN '<2' WHEN rating > 2 AND rating <= 3 THEN '2–3'
            WHEN rating > 3 AND rating <= 3.5 THEN '3–3.5' WHEN rating > 3.5 AND rating <= 4 THEN '3.5–4'
            WHEN rating > 4 AND rating <= 5 THEN '4–5' END AS band, CAST(count(*) AS BIGINT) AS n
FROM ecommerce GROUP BY 1""", "ecommerce"))
def q_p5(spark, sf):
    e = ecommerce_view(spark, sf)
    return e.groupBy(fixed_bins(F.col("rating"), RATING_BAND_EDGES, RATING_BAND_LABELS).alias("band")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("P9_P10_region_gap_and_rag", with_views("""
, g AS (SELECT region, avg(rev) AS r FROM sales WHERE region IS NOT NULL GROUP BY region)
, o AS (SELECT avg(rev) AS overall FROM sales)
SELECT region, round(r, 6) AS avg_rev, round(abs(r - overall) / abs(overall) * 100.0, 6) AS gap_pct,
       CASE WHEN abs(r - overall) / abs(overall) * 100.0 >= 2 THEN 'critical'
            WHEN abs(r - overall) / abs(overall) * 100.0 >= 1 THEN 'high' ELSE 'ok' END AS rag
FROM g, o""", "sales"))
def q_p9(spark, sf):
    s = sales_view(spark, sf)
    overall = s.agg(F.avg("rev")).first()[0]
    g = agg.aggregate(s, "region", "rev", "mean").withColumnRenamed("rev", "avg_rev")
    gap = sc.pct_gap_value(F.col("avg_rev"), F.lit(overall))
    return rounded(g.select("region", "avg_rev", gap.alias("gap_pct"), sc.rag(gap, 2.0, 1.0).alias("rag")))


@register("P9_safe_pct_gap_text_by_segment")
def q_p9t(spark, sf):
    s = sales_view(spark, sf)
    overall = s.agg(F.avg("rev")).first()[0]
    g = agg.aggregate(s, "product", "rev", "mean")
    return g.select("product", sc.safe_pct_gap(F.col("rev"), F.lit(overall)).alias("gap"))


@register("P13_action_priority_of_insight_actions")
def q_p13(spark, sf):
    from ..operators import insights as ins
    top = ins.hr_top_insights(hr_view(spark, sf), "left", dept="dept", satisfaction="satisfaction")
    return top.select("title", "action", sc.action_priority("action").alias("horizon"),
                      sc.priority_rank_label(F.col("sev_rank") + 1).alias("priority"))


@register("A3_describe_column_dispatch")
def q_a3(spark, sf):
    return rounded(tools.describe_column(read_table(spark, sf, "lineitem"), "l_extendedprice"))


@register("A9_crosstab_status_by_priority", """
SELECT o_orderstatus, """ + ", ".join(
    f"CAST(count(*) FILTER (WHERE o_orderpriority = '{p}') AS BIGINT) AS \"{p}\""
    for p in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) + """
FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY o_orderstatus""")
def q_a9(spark, sf):
    return agg.crosstab_counts(read_table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority",
                               ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) \
        .select("o_orderstatus", *[F.col(c).cast("bigint").alias(c) for c in
                                   ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]])


@register("A10_crosstab_mean_won_by_region_segment", with_views("""
SELECT region, """ + ", ".join(
    f"round(coalesce(avg(CASE WHEN won = 'won' THEN 1.0 ELSE 0.0 END) FILTER (WHERE product = '{p}') * 100.0, 0.0), 6) AS \"{p}\""
    for p in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + """
FROM sales WHERE region IS NOT NULL AND product IS NOT NULL GROUP BY region""", "sales"))
def q_a10(spark, sf):
    s = sales_view(spark, sf).withColumn("won_flag", F.when(F.col("won") == "won", 1.0).otherwise(0.0))
    return rounded(agg.crosstab_mean(s, "region", "product", "won_flag",
                                     ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))
