"""E-commerce operators (N-40..N-45).  Roles: rating, price, discount,
category, revenue, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.binning import fixed_bins, quantile_bins
from ..corr import ols_trend, spearman_pairs
from ..quantiles import exact_quantiles
from ..stats import col_stats
from . import kpi, kpi_table

# ---- fixed values that must equal the reference's -------------------------
RATING_BAND_EDGES = [0, 2, 3, 3.5, 4, 5]
RATING_BAND_LABELS = ["<2", "2–3", "3–3.5", "3.5–4", "4–5"]
PRICE_BAND_LABELS = ["Bottom 20%", "20–40%", "40–60%", "60–80%", "Top 20%"]
# ---------------------------------------------------------------------------


def rating_analysis(df: DataFrame, rating: str) -> DataFrame:
    """N-40: mean rating tier (< 3.5 critical, < 4.0 warning), ratings below 3.0, outliers."""
    s = col_stats(df, [rating])
    low = df.agg(F.count_if(F.col(rating) < 3.0).cast("bigint").alias("n_below_3")).first()[0]
    return s.select("n", "mean", "median", "std", "outliers", F.lit(low).cast("bigint").alias("n_below_3"),
                    F.when(F.col("mean") < 3.5, "critical").when(F.col("mean") < 4.0, "warning")
                     .otherwise("healthy").alias("tier"))


def category_gap(df: DataFrame, category: str, rating: str, min_n: int = 5,
                 gap_warn: float = 0.3, gap_critical: float = 0.8) -> DataFrame:
    """N-41: mean rating per category (n >= 5) with best-worst gap (HAVING)."""
    g = (df.where(F.col(category).isNotNull()).groupBy(category)
           .agg(F.avg(F.col(rating).cast("double")).alias("avg_rating"), F.count(F.lit(1)).cast("bigint").alias("n"))
           .where(F.col("n") >= min_n))
    ext = g.agg(F.max("avg_rating").alias("best"), F.min("avg_rating").alias("worst")).first()
    gap = (ext["best"] - ext["worst"]) if ext["best"] is not None else None
    sev = None if gap is None else ("critical" if gap > gap_critical else "warning" if gap > gap_warn else "ok")
    return g.select(category, "avg_rating", "n", F.lit(gap).cast("double").alias("gap"),
                    F.lit(sev).alias("gap_severity"))


def price_discount_signals(df: DataFrame, price: str, discount: str) -> DataFrame:
    """N-42: price skew above 1.5 (mean vs median) and discount erosion (avg discount > 40 / 55 %)."""
    s = col_stats(df, [price, discount]).select("column", "mean", "median", "skew")
    return s.select("column", "mean", "median", "skew",
                    F.when((F.col("column") == price) & (F.col("skew") > 1.5), "right-skewed prices")
                     .when((F.col("column") == discount) & (F.col("mean") > 55), "critical discount erosion")
                     .when((F.col("column") == discount) & (F.col("mean") > 40), "discount erosion")
                     .otherwise("ok").alias("signal"))


def price_rating_link(df: DataFrame, price: str, rating: str, min_abs: float = 0.3) -> DataFrame:
    """N-43: Spearman price-rating with |r| >= 0.3 flag."""
    return spearman_pairs(df, [price, rating]).withColumn("linked", F.abs(F.col("r")) >= min_abs)


def price_rating_matrix(df: DataFrame, price: str, rating: str) -> DataFrame:
    """N-44: price quintile x rating band counts (qcut x cut, crosstab)."""
    d = df.where(F.col(price).isNotNull() & F.col(rating).isNotNull())
    q = exact_quantiles(d.select(F.col(price).cast("double").alias("v")), [], "v",
                        [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).first()
    edges = [q[f"q{i}"] for i in range(6)]
    d = d.select(quantile_bins(F.col(price), edges, PRICE_BAND_LABELS).alias("price_band"),
                 fixed_bins(F.col(rating), RATING_BAND_EDGES, RATING_BAND_LABELS).alias("rating_band"))
    d = d.where(F.col("price_band").isNotNull() & F.col("rating_band").isNotNull())
    return d.groupBy("price_band").pivot("rating_band", RATING_BAND_LABELS).count().fillna(0)


def ecommerce_kpis(df: DataFrame, price: str, rating: str, discount: str, revenue: str,
                   reviews: str | None = None) -> DataFrame:
    """N-45: products, average price, rating, discount and total revenue."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.avg(price).alias("price"), F.avg(rating).alias("rating"),
               F.avg(discount).alias("discount"), F.sum(revenue).alias("revenue"),
               *([F.sum(reviews).alias("reviews")] if reviews else []))
    rows = [kpi("Products", F.col("n"), F.format_number(F.col("n"), 0)),
            kpi("Avg Price", F.col("price"), F.format_number(F.col("price"), 2)),
            kpi("Avg Rating", F.col("rating"), F.concat(F.format_number(F.col("rating"), 2), F.lit("/5")), "",
                F.when(F.col("rating") < 3.5, "red").when(F.col("rating") < 4.0, "amber").otherwise("green")),
            kpi("Avg Discount", F.col("discount"), F.concat(F.format_number(F.col("discount"), 1), F.lit("%")), "",
                F.when(F.col("discount") > 55, "red").when(F.col("discount") > 40, "amber").otherwise("green")),
            kpi("Total Revenue", F.col("revenue"), F.format_number(F.col("revenue"), 0))]
    if reviews:
        rows.append(kpi("Total Reviews", F.col("reviews"), F.format_number(F.col("reviews"), 0)))
    return kpi_table(a, rows)


def discount_rating_trend(df: DataFrame, discount: str, rating: str) -> DataFrame:
    """N-45: OLS of rating on discount."""
    return ols_trend(df, discount, rating)
