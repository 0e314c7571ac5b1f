"""Sales operators (N-60..N-68).  Roles: rev, target, rep, region, product,
margin, won, period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.scalars import truthy
from ..aggregate import histogram
from ..bi import group_gap
from ..quantiles import exact_quantiles
from ..ranks import row_positions
from ..stats import col_stats
from . import kpi, kpi_table

WON_TOKENS = ("won", "yes", "1", "true", "closed won")


def revenue_overview(df: DataFrame, rev: str) -> DataFrame:
    """N-60: revenue stats with CV (> 0.5 volatile) and skew (> 1 / 1.5) signals."""
    s = col_stats(df, [rev])
    return s.select("n", "mean", "median", "std", "cv", "skew",
                    (F.col("cv") > 0.5).alias("volatile"),
                    F.when(F.col("skew") > 1.5, "highly concentrated").when(F.col("skew") > 1, "concentrated")
                     .otherwise("balanced").alias("distribution"))


def target_achievement(df: DataFrame, rev: str, target: str) -> DataFrame:
    """N-61: achievement = mean revenue / mean target (70 / 80 / 100 tiers)."""
    a = df.agg(F.avg(rev).alias("avg_rev"), F.avg(target).alias("avg_target"))
    ach = F.try_divide(F.col("avg_rev") * 100.0, F.col("avg_target"))
    return a.select("avg_rev", "avg_target", ach.alias("achievement_pct"),
                    F.when(ach < 70, "critical").when(ach < 80, "warning").when(ach < 100, "below target")
                     .otherwise("on target").alias("tier"))


def regional_gap(df: DataFrame, region: str, rev: str, min_n: int = 3) -> DataFrame:
    """N-62: per region revenue (regions with ``min_n`` values), share, and the gap between the mean
    of the region with the largest revenue and that of the one with the smallest, in per cent of
    the latter (of 1, where that mean is below 1); null for a single region."""
    g = (df.where(F.col(region).isNotNull()).groupBy(region)
           .agg(F.sum(rev).alias("revenue"), F.avg(rev).alias("avg_revenue"), F.count(rev).cast("bigint").alias("n"))
           .where(F.col("n") >= min_n))
    of = F.struct("revenue", region)
    tot = g.agg(F.sum("revenue").alias("t"), F.max_by("avg_revenue", of).alias("best"),
                F.min_by("avg_revenue", of).alias("worst"), F.count(F.lit(1)).alias("regions")).first()
    gap = (tot["best"] - tot["worst"]) * 100.0 / max(tot["worst"], 1.0) if tot["regions"] > 1 else None
    return g.select(region, "revenue", "avg_revenue", "n", (F.col("revenue") / F.lit(tot["t"]) * 100.0).alias("share_pct"),
                    F.lit(gap).cast("double").alias("best_worst_gap_pct"))


def product_concentration(df: DataFrame, product: str, rev: str, min_n: int = 3) -> DataFrame:
    """N-63: top product share (> 40 % concentrated) and bottom-3 share, over the products with
    ``min_n`` values; no row for fewer than two such products."""
    g = (df.where(F.col(product).isNotNull()).groupBy(product).agg(F.sum(rev).alias("r"), F.count(rev).alias("n"))
           .where(F.col("n") >= min_n))
    total = g.agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("products")).first()
    schema = "top_product string, top_share_pct double, concentrated boolean, bottom3_share_pct double"
    if total["products"] < 2:
        return df.sparkSession.createDataFrame([], schema)
    top = g.orderBy(F.col("r").desc(), F.col(product)).first()
    bottom3 = g.orderBy(F.col("r").asc(), F.col(product)).limit(3).agg(F.sum("r")).first()[0]
    ts = top["r"] / total["r"] * 100.0
    return df.sparkSession.createDataFrame([(top[product], ts, ts > 40, bottom3 / total["r"] * 100.0)], schema)


def loss_rows(df: DataFrame, margin: str, warn_pct: float = 10.0) -> DataFrame:
    """N-64: rows with negative margin and their share (> 10 % flagged)."""
    a = df.agg(F.count_if(F.col(margin) < 0).cast("bigint").alias("loss_rows"), F.count(F.lit(1)).cast("bigint").alias("n"))
    pct = F.try_divide(F.col("loss_rows"), F.col("n")) * 100.0
    return a.select("loss_rows", "n", pct.alias("loss_pct"), (pct > warn_pct).alias("flag"))


def rep_ranking(df: DataFrame, rep: str, rev: str, target: str | None = None) -> DataFrame:
    """N-65: per rep revenue, deals, average deal, share, achievement, rank."""
    g = df.where(F.col(rep).isNotNull()).groupBy(rep).agg(
        F.sum(rev).alias("revenue"), F.count(F.lit(1)).cast("bigint").alias("deals"),
        F.avg(rev).alias("avg_deal"), *([F.sum(target).alias("target")] if target else []))
    total = df.agg(F.sum(rev)).first()[0]
    g = row_positions(g, "revenue", tiebreak=[rep], ascending=False).withColumnRenamed("_rn", "rank")
    g = g.withColumn("share_pct", F.col("revenue") / F.lit(total) * 100.0) \
         .withColumn("rank", F.col("rank").cast("bigint"))
    if target:
        g = g.withColumn("achievement_pct", F.try_divide(F.col("revenue") * 100.0, F.col("target")))
    return g


def revenue_vs_target_by(df: DataFrame, dim: str, rev: str, target: str) -> DataFrame:
    """N-66: revenue vs target per region / segment."""
    g = df.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.sum(rev).alias("revenue"), F.sum(target).alias("target"))
    return g.withColumn("achievement_pct", F.try_divide(F.col("revenue") * 100.0, F.col("target")))


def deal_size_distribution(df: DataFrame, rev: str) -> DataFrame:
    """N-67: deal-size median and 80th percentile."""
    q = exact_quantiles(df.select(F.col(rev).cast("double").alias("v")), [], "v", [0.5, 0.8])
    return q.select(F.col("n").cast("bigint").alias("n"), F.col("q0").alias("median_deal"), F.col("q1").alias("p80_deal"))


def margin_by_segment(df: DataFrame, segment: str, margin: str) -> DataFrame:
    """N-66: mean margin of each segment, its distance from the best one, and best and worst of all."""
    g = df.where(F.col(segment).isNotNull() & F.col(margin).isNotNull()).groupBy(F.col(segment).cast("string").alias("name")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(F.col(margin).cast("double")).alias("mean"))
    ends = group_gap(g, least=1).first()
    if ends is None:
        return g.select("name", "n", "mean", F.lit(0.0).alias("below_best"), F.lit(None).cast("string").alias("position")).limit(0)
    position = F.when(F.col("name") == ends["best"], "best").when(F.col("name") == ends["worst"], "worst").otherwise("middle")
    return g.select("name", "n", "mean", (F.lit(ends["best_value"]) - F.col("mean")).alias("below_best"), position.alias("position"))


def deal_size_histogram(df: DataFrame, rev: str, bins: int = 20) -> DataFrame:
    """N-67: histogram of deal sizes with the median, and whether a bin lies above the 80th percentile."""
    p80 = deal_size_distribution(df, rev).first()
    h = histogram(df, rev, bins)
    if p80 is None:
        return h.withColumn("above_p80", F.lit(None).cast("boolean"))
    return h.withColumn("above_p80", F.col("bin_lo") > F.lit(p80["p80_deal"]))


def sales_kpis(df: DataFrame, rev: str, target: str, rep: str, margin: str, won: str) -> DataFrame:
    """N-68: total revenue, quota attainment (ratio of sums), top-rep share,
    average margin, win rate."""
    top = (df.where(F.col(rep).isNotNull()).groupBy(rep).agg(F.sum(rev).alias("r"))
             .agg(F.max("r").alias("top_r")).first()["top_r"])
    a = df.agg(F.sum(rev).alias("rev"), F.sum(target).alias("target"), F.avg(margin).alias("margin"),
               F.avg(truthy(won, WON_TOKENS)).alias("win"))
    quota = F.try_divide(F.col("rev") * 100.0, F.col("target"))
    share = F.try_divide(F.lit(top) * 100.0, F.col("rev"))
    rows = [kpi("Total Revenue", F.col("rev"), F.format_number(F.col("rev"), 0)),
            kpi("Quota Attainment", quota, F.concat(F.format_number(quota, 1), F.lit("%")), "",
                F.when(quota < 80, "red").when(quota < 100, "amber").otherwise("green")),
            kpi("Top Rep Share", share, F.concat(F.format_number(share, 1), F.lit("%"))),
            kpi("Avg Margin", F.col("margin"), F.concat(F.format_number(F.col("margin"), 1), F.lit("%"))),
            kpi("Win Rate", F.col("win") * 100.0, F.concat(F.format_number(F.col("win") * 100.0, 1), F.lit("%")))]
    return kpi_table(a, rows)
