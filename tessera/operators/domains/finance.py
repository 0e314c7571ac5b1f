"""Finance operators (N-20..N-30).  Roles: rev, cost, profit, budget, actual,
opex, period, cat.  Formulas follow each screen (trap T19): ratio of sums
for totals, mean of row ratios where the screen averages rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..timeseries import first_last_growth, halves_trend
from . import kpi, kpi_table


def gross_margin(df: DataFrame, rev: str, cost: str, profit: str | None = None) -> DataFrame:
    """N-20: gross margin % (ratio of sums), loss rows, tier 10 / 25."""
    p = F.col(profit) if profit else F.col(rev) - F.col(cost)
    a = df.agg(F.sum(rev).alias("total_rev"), F.sum(cost).alias("total_cost"),
               F.count_if(p < 0).cast("bigint").alias("loss_rows"), F.count(F.lit(1)).cast("bigint").alias("n"))
    gm = F.try_divide((F.col("total_rev") - F.col("total_cost")) * 100.0, F.col("total_rev"))
    return a.select("total_rev", "total_cost", gm.alias("gross_margin_pct"), "loss_rows",
                    (F.col("loss_rows") / F.col("n") * 100.0).alias("loss_pct"),
                    F.when(gm < 10, "critical").when(gm < 25, "warning").otherwise("healthy").alias("tier"))


def revenue_trend(df: DataFrame, rev: str, period: str) -> DataFrame:
    """N-21: first- vs second-half revenue trend (W-4)."""
    return halves_trend(df, period, rev)


def budget_variance(df: DataFrame, budget: str, actual: str) -> DataFrame:
    """N-22: total variance % (ratio of sums), over / under budget row counts, tiers 10 / 20."""
    a = df.agg(F.sum(budget).alias("total_budget"), F.sum(actual).alias("total_actual"),
               F.count_if(F.col(actual) > F.col(budget)).cast("bigint").alias("over_budget_rows"),
               F.count_if(F.col(actual) < F.col(budget)).cast("bigint").alias("under_budget_rows"))
    v = F.try_divide((F.col("total_actual") - F.col("total_budget")) * 100.0, F.col("total_budget"))
    return a.select("*", v.alias("variance_pct"),
                    F.when(F.abs(v) > 20, "critical").when(F.abs(v) > 10, "warning").otherwise("on_track")
                    .alias("tier"))


def budget_vs_actual_by(df: DataFrame, dim: str, budget: str, actual: str, top: int = 12) -> DataFrame:
    """N-23: per period/category budget, actual, variance and variance %, top by |variance %|."""
    g = df.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.sum(budget).alias("budget"), F.sum(actual).alias("actual"))
    g = g.withColumn("variance", F.col("actual") - F.col("budget")) \
         .withColumn("variance_pct", F.try_divide(F.col("variance") * 100.0, F.col("budget")))
    return g.orderBy(F.abs(F.col("variance_pct")).desc_nulls_last(), F.col(dim)).limit(top)


def cost_concentration(df: DataFrame, cat: str, cost: str, rev: str, opex: str | None = None) -> DataFrame:
    """N-24: top / top-2 category share of the cost that has a category (> 60 % concentrated) and OpEx ratio (> 80 %)."""
    g = df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.sum(cost).alias("c"))
    w = Window.orderBy(F.col("c").desc(), F.col(cat))
    top2 = g.orderBy(F.col("c").desc(), F.col(cat)).limit(2).withColumn("rk", F.row_number().over(w))
    tot = df.agg(F.sum(F.when(F.col(cat).isNotNull(), F.col(cost))).alias("total_cost"), F.sum(rev).alias("total_rev"),
                 *([F.sum(opex).alias("total_opex")] if opex else [])).first()
    t = top2.agg(F.max_by(cat, F.struct(F.col("c"), F.lit(0))).alias("top_category"),
                 F.max("c").alias("top_cost"), F.sum("c").alias("top2_cost"))
    top_share = F.col("top_cost") / F.lit(tot["total_cost"]) * 100.0
    out = t.select("top_category", top_share.alias("top_share_pct"),
                   (F.col("top2_cost") / F.lit(tot["total_cost"]) * 100.0).alias("top2_share_pct"),
                   (top_share > 60).alias("concentrated"))
    if opex:
        oer = tot["total_opex"] / tot["total_rev"] * 100.0 if tot["total_rev"] else None
        out = out.withColumn("opex_ratio_pct", F.lit(oer).cast("double")) \
                 .withColumn("opex_high", F.lit(oer is not None and oer > 80))
    return out


def revenue_concentration(df: DataFrame, cat: str, rev: str, cost: str, period: str) -> DataFrame:
    """N-25: top category share of the revenue that has a category (> 50 %) and first -> last period cost growth (> 15 %)."""
    g = df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.sum(rev).alias("r"))
    top = g.orderBy(F.col("r").desc(), F.col(cat)).first()
    total = g.agg(F.sum("r")).first()[0]
    growth = first_last_growth(df, period, cost).first()
    spark = df.sparkSession
    share = top["r"] / total * 100.0 if total else None
    return spark.createDataFrame([(top[cat], share, share is not None and share > 50,
                                   growth["growth_pct"], growth["growth_pct"] is not None and growth["growth_pct"] > 15)],
                                 "top_category string, top_share_pct double, revenue_concentrated boolean, "
                                 "cost_growth_pct double, cost_growth_high boolean")


def pnl_summary(df: DataFrame, rev: str, cost: str, opex: str | None = None) -> DataFrame:
    """N-26: P&L lines with % of revenue (one aggregate, stacked to rows)."""
    a = df.agg(F.sum(rev).alias("rev"), F.sum(cost).alias("cost"),
               *([F.sum(opex).alias("opex")] if opex else [F.lit(0.0).alias("opex")]))
    lines = [("Revenue", F.col("rev")), ("Cost of Goods", F.col("cost")),
             ("Gross Profit", F.col("rev") - F.col("cost")), ("Operating Expenses", F.col("opex")),
             ("Operating Profit (proxy)", F.col("rev") - F.col("cost") - F.col("opex"))]
    return a.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("line_no"), F.lit(name).alias("line"), v.alias("amount"),
                 F.try_divide(v * 100.0, F.col("rev")).alias("pct_of_revenue")) for i, (name, v) in enumerate(lines)])))


def cost_by_category(df: DataFrame, cat: str, cost: str, top: int = 10) -> DataFrame:
    """N-27: cost per category, top ``top`` with share of total and top-1 / top-3 shares."""
    total = df.agg(F.sum(cost)).first()[0]
    g = (df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.sum(cost).alias("cost"))
           .orderBy(F.col("cost").desc(), F.col(cat)).limit(top))
    w = Window.orderBy(F.col("cost").desc(), F.col(cat))  # <= top rows
    g = g.withColumn("rank", F.row_number().over(w).cast("bigint")) \
         .withColumn("share_pct", F.col("cost") / F.lit(total) * 100.0) \
         .withColumn("cum_share_pct", F.sum("share_pct").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g


def revenue_cost_by_period(df: DataFrame, period: str, rev: str, cost: str) -> DataFrame:
    """N-28: revenue, cost, profit and margin % per period."""
    g = df.where(F.col(period).isNotNull()).groupBy(period).agg(F.sum(rev).alias("revenue"), F.sum(cost).alias("cost"))
    return g.select(period, "revenue", "cost", (F.col("revenue") - F.col("cost")).alias("profit"),
                    F.try_divide((F.col("revenue") - F.col("cost")) * 100.0, F.col("revenue")).alias("margin_pct"))


def category_profitability(df: DataFrame, cat: str, rev: str, cost: str) -> DataFrame:
    """N-29: category revenue, gross profit and margin %."""
    g = df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.sum(rev).alias("revenue"), F.sum(cost).alias("cost"))
    return g.select(cat, "revenue", (F.col("revenue") - F.col("cost")).alias("gross_profit"),
                    F.try_divide((F.col("revenue") - F.col("cost")) * 100.0, F.col("revenue")).alias("margin_pct"))


def finance_kpis(df: DataFrame, rev: str, cost: str, profit: str, budget: str, actual: str,
                 opex: str | None = None) -> DataFrame:
    """N-30: total revenue, gross margin (ratio of sums), net profit, mean row
    variance % (mean of row ratios; zero budgets excluded), OpEx ratio."""
    row_var = F.try_divide((F.col(actual) - F.col(budget)) * 100.0, F.when(F.col(budget) != 0, F.col(budget)))
    a = df.agg(F.sum(rev).alias("rev"), F.sum(cost).alias("cost"), F.sum(profit).alias("profit"),
               F.avg(row_var).alias("row_var"), *([F.sum(opex).alias("opex")] if opex else []))
    gm = F.try_divide((F.col("rev") - F.col("cost")) * 100.0, F.col("rev"))
    npm = F.try_divide(F.col("profit") * 100.0, F.col("rev"))
    rows = [kpi("Total Revenue", F.col("rev"), F.format_number(F.col("rev"), 0)),
            kpi("Gross Margin", gm, F.concat(F.format_number(gm, 1), F.lit("%")), "",
                F.when(gm < 10, "red").when(gm < 25, "amber").otherwise("green")),
            kpi("Net Profit", F.col("profit"), F.format_number(F.col("profit"), 0),
                F.concat(F.lit("Net margin "), F.format_number(npm, 1), F.lit("%"))),
            kpi("Avg Budget Variance", F.col("row_var"), F.concat(F.format_number(F.col("row_var"), 1), F.lit("%")),
                "mean of row-level variance")]
    if opex:
        oer = F.try_divide(F.col("opex") * 100.0, F.col("rev"))
        rows.append(kpi("OpEx Ratio", oer, F.concat(F.format_number(oer, 1), F.lit("%")), "",
                        F.when(oer > 80, "red").otherwise("green")))
    return kpi_table(a, rows)
