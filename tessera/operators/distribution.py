"""Anderson-Darling (H-3), distribution fits with Kolmogorov-Smirnov (H-5),
consensus normality (H-4) and the univariate composite (E-1).

Both statistics need the sorted sample.  They are computed on the
distinct ``(column, value, count)`` table with distributed positions
(``ranks.ordered_running``): a value covering sorted positions
``s+1 .. s+c`` contributes closed-form sums, so ties and hot values cost
one row.  The CDFs are column expressions on that table, but for gamma's, which is
an array function in an Arrow batch; fitted parameters come from Spark aggregates (MLE).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import gamma_cdf, norm_cdf_col
from .ranks import ordered_running
from .stats import to_long, value_counts_long

# ---- fixed values (normal-case Anderson-Darling critical values) -----------
AD_CRIT_NORMAL = (0.576, 0.656, 0.787, 0.918, 1.092)   # 15, 10, 5, 2.5, 1 %
AD_SIGNIFICANCE = (15.0, 10.0, 5.0, 2.5, 1.0)
DISTRIBUTIONS = ("norm", "lognorm", "expon", "gamma", "uniform")
# -----------------------------------------------------------------------------


def _cdf_col(dist: Column, x: Column, p1: Column, p2: Column) -> Column:
    """Distribution function of every law but gamma, as a column expression."""
    z = (x - p1) / p2
    return (F.when(dist == "norm", norm_cdf_col(z))
             .when(dist == "lognorm", F.when(x > 0, norm_cdf_col((F.log(F.when(x > 0, x)) - p1) / p2)).otherwise(0.0))
             .when(dist == "expon", F.when(x >= p1, 1.0 - F.exp(-z)).otherwise(0.0))
             .when(dist == "uniform", F.greatest(F.lit(0.0), F.least(F.lit(1.0), z))))


@F.pandas_udf(T.DoubleType())
def _gamma_cdf_udf(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series(gamma_cdf((x / scale).to_numpy(float), shape.to_numpy(float)))


def _digamma(x: float) -> float:
    r = 0.0
    while x < 6:
        r -= 1 / x
        x += 1
    f = 1 / (x * x)
    return r + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def _trigamma(x: float) -> float:
    r = 0.0
    while x < 6:
        r += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return r + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def gamma_shape_mle(mean: float, mean_log: float) -> float:
    """Gamma shape MLE (loc fixed at 0) by Newton on log(k) - digamma(k) = s."""
    s = math.log(mean) - mean_log
    if s <= 0:
        return float("inf")
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(k) - _digamma(k) - s) / (1 / k - _trigamma(k))
        k -= step
        if abs(step) < 1e-12:
            break
    return k


def _positions(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    long = to_long(df, columns).where(F.col("value").isNotNull())
    counts = value_counts_long(long)
    pos = ordered_running(counts, "_v", part_cols=["column"], weight_col="_c", few_keys=True) \
        .select("column", "_v", "_c", (F.col("_pos") - F.col("_c")).alias("_s"))
    return long, pos


def anderson_darling(df: DataFrame, columns: list[str]) -> DataFrame:
    """H-3: A² for normality (mean and sample std estimated), with the 5 %
    critical value adjusted for n as in the textbook case."""
    long, pos = _positions(df, columns)
    m = long.groupBy("column").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mu"),
                                   F.stddev_samp("value").alias("sd"))
    j = pos.join(F.broadcast(m), "column")
    j = j.withColumn("cdf", norm_cdf_col((F.col("_v") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd"))))
    s, c, n = F.col("_s").cast("double"), F.col("_c").cast("double"), F.col("n")
    w_lo = (s + c) * (s + c) - s * s
    w_hi = c * (2 * n + 1) - ((s + c) * (s + c + 1) - s * (s + 1))
    eps = F.lit(1e-300)
    term = w_lo * F.log(F.greatest(F.col("cdf"), eps)) + w_hi * F.log(F.greatest(1 - F.col("cdf"), eps))
    a = j.groupBy("column", "n").agg(F.sum(term).alias("S"))
    a2 = -F.col("n") - F.col("S") / F.col("n")
    # the textbook table value adjusted for n, rounded to 3 decimals as published
    crit5 = F.bround(F.lit(AD_CRIT_NORMAL[2]) / (1 + 4.0 / F.col("n") - 25.0 / (F.col("n") * F.col("n"))), 3)
    return a.select("column", F.col("n").cast("bigint").alias("n"), a2.alias("anderson_stat"),
                    crit5.alias("anderson_critical"), (a2 < crit5).alias("anderson_normal"))


def fit_distributions(df: DataFrame, columns: list[str], min_n: int = 30) -> DataFrame:
    """H-5: MLE fits (norm, lognorm and gamma with loc 0, expon with loc = min,
    uniform on [min, max]) and the KS statistic D for each; asymptotic KS
    p-value; best fit = largest p.  Columns with fewer than 30 values skipped."""
    long, pos = _positions(df, columns)
    m = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.min("value").alias("mn"), F.max("value").alias("mx"),
        F.avg(F.when(F.col("value") > 0, F.log("value"))).alias("mlog"),
        F.stddev_pop(F.when(F.col("value") > 0, F.log("value"))).alias("sdlog"),
        F.count_if(F.col("value") <= 0).alias("nonpos")).where(F.col("n") >= min_n).collect()
    rows = []
    for r in m:
        params = {"norm": (r["mean"], r["sd"]), "uniform": (r["mn"], r["mx"] - r["mn"]),
                  "expon": (r["mn"], r["mean"] - r["mn"])}
        if r["nonpos"] == 0:
            params["lognorm"] = (r["mlog"], r["sdlog"])
            k = gamma_shape_mle(r["mean"], r["mlog"])
            if math.isfinite(k):
                params["gamma"] = (k, r["mean"] / k)
        for d, (p1, p2) in params.items():
            if p2 and p2 > 0:
                rows.append((r["column"], d, float(p1), float(p2), int(r["n"])))
    spark = df.sparkSession
    ptab = spark.createDataFrame(rows, "column string, dist string, p1 double, p2 double, n long")
    j = pos.join(F.broadcast(ptab), "column")  # columns x 5 rows: schema-bounded
    v, dist = F.col("_v"), F.col("dist")
    j = (j.where(dist != "gamma").withColumn("cdf", _cdf_col(dist, v, F.col("p1"), F.col("p2")))
         .unionByName(j.where(dist == "gamma").withColumn("cdf", _gamma_cdf_udf(v, F.col("p1"), F.col("p2")))))
    n = F.col("n").cast("double")
    dplus = (F.col("_s") + F.col("_c")) / n - F.col("cdf")
    dminus = F.col("cdf") - F.col("_s") / n
    ks = j.groupBy("column", "dist", "n", "p1", "p2").agg(F.max(F.greatest(dplus, dminus)).alias("ks_stat"))
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * F.col("ks_stat")
    series = sum(((-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 101))
    ks = ks.withColumn("ks_p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))
    return ks.select("column", "dist", "p1", "p2", F.col("n").cast("bigint").alias("n"), "ks_stat", "ks_p")


def best_fit(fits: DataFrame) -> DataFrame:
    return fits.groupBy("column").agg(F.max_by("dist", F.struct("ks_p", "dist")).alias("best_fit_dist"),
                                      F.max("ks_p").alias("ks_p"))


def normality_consensus(df: DataFrame, columns: list[str]) -> DataFrame:
    """H-4: normal when at least half of the available tests (Shapiro-Wilk,
    D'Agostino K², Anderson-Darling) do not reject at 5 %."""
    from .normality import shapiro_by_column
    from .stats import dagostino_k2
    sw = shapiro_by_column(df, columns).select("column", "shapiro_stat", "shapiro_p")
    dk = dagostino_k2(df, columns).select("column", F.col("k2").alias("dagostino_stat"),
                                          F.col("p_value").alias("dagostino_p"))
    ad = anderson_darling(df, columns).select("column", "anderson_stat", "anderson_critical", "anderson_normal")
    j = sw.join(dk, "column", "full").join(ad, "column", "full")
    votes = (F.coalesce((F.col("shapiro_p") > 0.05).cast("int"), F.lit(0)) +
             F.coalesce((F.col("dagostino_p") > 0.05).cast("int"), F.lit(0)) +
             F.coalesce(F.col("anderson_normal").cast("int"), F.lit(0)))
    avail = (F.col("shapiro_p").isNotNull().cast("int") + F.col("dagostino_p").isNotNull().cast("int") +
             F.col("anderson_stat").isNotNull().cast("int"))
    return j.withColumn("n_tests", avail).withColumn("n_normal", votes) \
            .withColumn("is_normal", (avail > 0) & (votes * 2 >= avail))


def univariate(df: DataFrame, columns: list[str]) -> DataFrame:
    """E-1: Q-1 superset per numeric column: variance, p5/p95, G1/G2 with labels,
    mode, normality tests and consensus, IQR / z / modified-z outliers,
    entropy and best-fitting distribution."""
    from .aggregate import entropy
    from .quantiles import exact_quantiles_from_counts
    from .stats import col_stats, kurt_G2, kurtosis_label, modified_z_outliers, skew_G1, skew_label, zscore_outliers
    cs = col_stats(df, columns)
    long = to_long(df, columns).where(F.col("value").isNotNull())
    counts = value_counts_long(long)
    q = exact_quantiles_from_counts(counts, ["column"], [0.05, 0.95], few_keys=True).select(
        "column", F.col("q0").alias("p5"), F.col("q1").alias("p95"))
    mode = counts.groupBy("column").agg(F.max(F.struct(F.col("_c"), (-F.col("_v")).alias("nv"))).alias("m")) \
        .select("column", (-F.col("m.nv")).alias("mode"))
    n = F.col("n").cast("double")
    out = (cs.join(q, "column").join(mode, "column")
             .join(zscore_outliers(df, columns), "column", "left")
             .join(modified_z_outliers(df, columns).select("column", "outliers_modz"), "column", "left")
             .join(normality_consensus(df, columns), "column", "left")
             .join(entropy(df, columns), "column", "left")
             .join(best_fit(fit_distributions(df, columns)), "column", "left"))
    g1, g2 = skew_G1(F.col("skew"), n), kurt_G2(F.col("kurtosis"), n)
    return out.select(
        "column", "n", "mean", "median", "mode", "std", (F.col("std") * F.col("std")).alias("variance"), "cv",
        "min", "max", (F.col("max") - F.col("min")).alias("range"), "q1", "q3", "iqr", "p5", "p95",
        g1.alias("skewness"), skew_label(g1).alias("skew_label"), g2.alias("kurtosis"),
        kurtosis_label(g2, 3.0, -1.0).alias("kurtosis_label"),
        "shapiro_stat", "shapiro_p", "dagostino_stat", "dagostino_p", "anderson_stat", "anderson_critical",
        "is_normal", F.col("outliers").alias("outliers_iqr"), "outliers_zscore", "outliers_modz",
        "outlier_pct", "entropy", "best_fit_dist", "ks_p")
