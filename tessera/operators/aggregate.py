"""Aggregation operators (A-1..A-15).

All group operators drop null keys first (pandas ``groupby`` semantics,
trap T1) and let Spark's partial aggregation combine map-side, so a hot
key costs one pre-aggregated row per task, not a hot reducer.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import hist_bin
from .quantiles import exact_quantiles

# ---- fixed values that must equal the reference's -------------------------
# Metric names averaged (not summed) when aggregated per group (A-4).
SCORE_METRICS = ("satisfaction", "rating", "score", "evaluation", "performance",
                 "satisfaction_level", "last_evaluation")
# ---------------------------------------------------------------------------

_AGG = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "max": F.max,
        "min": F.min, "median": F.median}


def is_score_metric(name: str) -> bool:
    low = name.lower()
    return any(k in low for k in SCORE_METRICS)


def aggregate(df: DataFrame, group_col: str, value_col: str, agg_func: str = "sum") -> DataFrame:
    """A-1: ``agg_func`` of ``value_col`` per group, sorted descending."""
    if agg_func not in _AGG:
        raise ValueError(f"unknown agg_func {agg_func}")
    f = _AGG[agg_func]
    out = (df.where(F.col(group_col).isNotNull())
             .groupBy(group_col).agg(f(value_col).alias(value_col)))
    if agg_func == "count":
        out = out.withColumn(value_col, F.col(value_col).cast("bigint"))
    return out.orderBy(F.col(value_col).desc_nulls_last(), F.col(group_col))


def count_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """A-2: top-k value counts (count desc, then value asc)."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col(column)).limit(k))


def metric_by_group(df: DataFrame, dim: str, metric: str, top: int = 15,
                    ascending: bool = False, agg: str | None = None) -> DataFrame:
    """A-4 / A-5: mean for score-like metrics, sum otherwise; ranked top ``top``."""
    agg = agg or ("mean" if is_score_metric(metric) else "sum")
    g = (df.where(F.col(dim).isNotNull()).groupBy(dim)
           .agg(_AGG[agg](F.col(metric).cast("double")).alias(metric)))
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return g.orderBy(order, F.col(dim)).limit(top).withColumn("agg_func", F.lit(agg))


def share_of_total(df: DataFrame, dim: str, metric: str, top: int = 8) -> DataFrame:
    """A-6: top groups by summed metric and their share of the *retained* total."""
    top_g = (df.where(F.col(dim).isNotNull()).groupBy(dim)
               .agg(F.sum(F.col(metric).cast("double")).alias("value"))
               .orderBy(F.col("value").desc(), F.col(dim)).limit(top))
    # ``top`` rows at most: the window over them is bounded.
    w = Window.partitionBy()
    return top_g.withColumn("share_pct",
                            F.try_divide(F.col("value") * 100.0, F.sum("value").over(w)))


def above_below_average(df: DataFrame, dim: str, metric: str, agg: str = "mean") -> DataFrame:
    """A-7: group aggregate with a marker against the mean of the groups."""
    g = (df.where(F.col(dim).isNotNull()).groupBy(dim)
           .agg(_AGG[agg](F.col(metric).cast("double")).alias("value")))
    avg_of_groups = g.agg(F.avg("value")).first()[0]
    return g.select(dim, "value",
                    F.lit(avg_of_groups).cast("double").alias("group_avg"),
                    F.when(F.col("value") >= F.lit(avg_of_groups), "above").otherwise("below")
                    .alias("marker"))


def distribution(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """A-8 / M-12: normalised value counts (share of non-null rows)."""
    g = (df.where(F.col(column).isNotNull()).groupBy(column)
           .agg(F.count(F.lit(1)).alias("count")))
    n = df.where(F.col(column).isNotNull()).count()
    g = g.withColumn("share", F.col("count") / F.lit(float(n)) if n else F.lit(None))
    if k:
        g = g.orderBy(F.col("count").desc(), F.col(column)).limit(k)
    return g


def crosstab_counts(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """A-9: pivot counts; ``values`` fixes the output columns (no distinct job)."""
    return (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
              .groupBy(row).pivot(col, values).count().fillna(0))


def crosstab_mean(df: DataFrame, row: str, col: str, value: str, values: list[str],
                  scale: float = 100.0) -> DataFrame:
    """A-10: pivot of ``mean(value)·scale``, empty cells filled with 0."""
    p = (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
           .groupBy(row).pivot(col, values).agg(F.avg(F.col(value).cast("double")) * scale))
    return p.fillna(0.0)


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-11: Shannon entropy ``-sum p log2(p + 1e-10)`` per column over non-null values."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    tot = counts.groupBy("column").agg(F.sum("cnt").alias("n"))
    p = counts.join(F.broadcast(tot), "column").withColumn("p", F.col("cnt") / F.col("n"))
    return p.groupBy("column").agg(
        (-F.sum(F.col("p") * F.log2(F.col("p") + F.lit(1e-10)))).alias("entropy"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """A-12: equal-width histogram over [min, max] (last bin closed), every bin
    present (empty bins have count 0), plus mean/median reference lines."""
    v = F.col(column).cast("double")
    s = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean")).first()
    lo, hi = s["lo"], s["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin bigint, bin_lo double, bin_hi double, count bigint")
    med = exact_quantiles(df.select(v.alias("value")), [], "value", [0.5]).first()["q0"]
    width = (hi - lo) / bins if hi > lo else 0.0
    counts = (df.where(v.isNotNull()).select(hist_bin(v, lo, hi, bins).alias("bin"))
                .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    all_bins = spark.range(bins).select(F.col("id").alias("bin"))
    return (all_bins.join(counts, "bin", "left")
            .select("bin",
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
                    F.lit(s["mean"]).cast("double").alias("mean"),
                    F.lit(med).cast("double").alias("median")))


def box_summary(df: DataFrame, value: str, group: str | None = None, top_groups: int = 10,
                whisker: float = 1.5) -> DataFrame:
    """A-13: five-number summary with 1.5·IQR whiskers and outlier counts,
    per group for the ``top_groups`` most frequent groups."""
    v = F.col(value).cast("double")
    if group:
        top = (df.where(F.col(group).isNotNull()).groupBy(group).count()
                 .orderBy(F.col("count").desc(), F.col(group)).limit(top_groups)
                 .select(F.col(group).cast("string").alias("grp")))
        base = (df.where(F.col(group).isNotNull())
                  .select(F.col(group).cast("string").alias("grp"), v.alias("value"))
                  .join(F.broadcast(top), "grp"))
    else:
        base = df.select(F.lit("all").alias("grp"), v.alias("value"))
    base = base.where(F.col("value").isNotNull())
    q = exact_quantiles(base, ["grp"], "value", [0.25, 0.5, 0.75]).select(
        "grp", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("lo_fence", F.col("q1") - whisker * F.col("iqr")) \
         .withColumn("hi_fence", F.col("q3") + whisker * F.col("iqr"))
    j = base.join(q, "grp")
    inside = (F.col("value") >= F.col("lo_fence")) & (F.col("value") <= F.col("hi_fence"))
    return j.groupBy("grp", "q1", "median", "q3", "iqr").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))


def dominant_value(df: DataFrame, columns: list[str], share: float = 0.60,
                   min_unique: int = 3) -> DataFrame:
    """A-15: numeric columns whose most frequent value holds > ``share`` of
    non-null rows while the column has more than ``min_unique`` distinct values."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    per = counts.groupBy("column").agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("n_unique"),
        F.max(F.struct(F.col("cnt"), (-F.col("value")).alias("negv"))).alias("top"))
    return per.select(
        "column", "n", "n_unique",
        (-F.col("top.negv")).alias("top_value"),
        (F.col("top.cnt") / F.col("n")).alias("top_share"),
        ((F.col("top.cnt") / F.col("n") > share) & (F.col("n_unique") > min_unique))
        .alias("is_dominant"))
