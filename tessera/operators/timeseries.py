"""Time-series, period and trend operators (W-1..W-13).

Row-level work is a ``groupBy`` on a period key (partial aggregation);
ordered logic (lag, halves, growth) runs on the period table, whose size
is the number of periods, not the number of rows.  Per-series model fits
(ADF) run per key with ``applyInPandas`` over those period tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_two_sided, t_two_sided_col
from .ranks import ordered_running, row_positions


def monthly_mean(df: DataFrame, ts_col: str, value_col: str, key_cols: list[str] | None = None) -> DataFrame:
    """W-1: month-end resample mean; months without data are absent."""
    key_cols = list(key_cols or [])
    return (df.where(F.col(ts_col).isNotNull() & F.col(value_col).isNotNull())
              .groupBy(*key_cols, F.last_day(F.col(ts_col)).alias("month_end"))
              .agg(F.avg(F.col(value_col).cast("double")).alias(value_col),
                   F.count(F.lit(1)).alias("n")))


def period_totals(df: DataFrame, period_col: str, value_cols: list[str]) -> DataFrame:
    """W-2: sums per period, sorted by period."""
    return (df.where(F.col(period_col).isNotNull()).groupBy(period_col)
              .agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in value_cols])
              .orderBy(period_col))


def change_vs_prior(period_table: DataFrame, period_col: str, value_col: str) -> DataFrame:
    """W-3: % change of each period vs the previous one (period table input)."""
    w = Window.orderBy(period_col)  # one row per period: bounded
    prev = F.lag(F.col(value_col)).over(w)
    return period_table.select(period_col, value_col, prev.alias("prev_value"),
                               F.try_divide((F.col(value_col) - prev) * 100.0, prev).alias("change_pct"))


def halves_trend(df: DataFrame, period_col: str, value_col: str) -> DataFrame:
    """W-4: mean of the first ⌊n/2⌋ period totals vs the rest; trend %."""
    p = (df.where(F.col(period_col).isNotNull()).groupBy(period_col)
           .agg(F.sum(F.col(value_col).cast("double")).alias("total")))
    w = Window.orderBy(period_col)
    p = p.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    first = F.col("rn") <= F.floor(F.col("n") / 2)
    r = p.agg(F.max("n").cast("bigint").alias("n_periods"),
              F.avg(F.when(first, F.col("total"))).alias("first_half"),
              F.avg(F.when(~first, F.col("total"))).alias("second_half"))
    trend = F.when(F.col("first_half") > 0,
                   (F.col("second_half") - F.col("first_half")) / F.col("first_half") * 100.0)
    return r.where(F.col("n_periods") >= 2).select(
        "n_periods", "first_half", "second_half", trend.alias("trend_pct"),
        F.when(trend > 0, "growing").when(trend.isNotNull(), "declining").alias("direction"),
        F.when(trend < -20, "critical").when(trend < -10, "warning")
         .when(trend > 15, "opportunity").otherwise("stable").alias("signal"))


def first_last_growth(df: DataFrame, period_col: str, value_col: str,
                      key_cols: list[str] | None = None) -> DataFrame:
    """W-5: growth from the first to the last period total (per key)."""
    key_cols = list(key_cols or [])
    p = (df.where(F.col(period_col).isNotNull()).groupBy(*key_cols, period_col)
           .agg(F.sum(F.col(value_col).cast("double")).alias("total")))
    g = p.groupBy(*key_cols).agg(
        F.min_by("total", period_col).alias("first_value"),
        F.max_by("total", period_col).alias("last_value"),
        F.count(F.lit(1)).cast("bigint").alias("n_periods"))
    return g.withColumn("growth_pct", F.try_divide(
        (F.col("last_value") - F.col("first_value")) * 100.0, F.col("first_value")))


def row_half_trend(df: DataFrame, order_col: str, value_col: str, tiebreak: list[str],
                   flat_pct: float = 2.0) -> DataFrame:
    """W-6: mean of the first ⌊n/2⌋ rows vs the rest in an explicit order (T22),
    with CV and an up/down/flat label (±2 %).

    No full row order is materialised: the split value of ``order_col`` is
    located on the distinct-value count table (a hot timestamp is one row
    there), and only the rows sharing that split value are ranked by the
    tiebreak — distributed again, since the tiebreak is unique."""
    d = df.where(F.col(value_col).isNotNull()).select(order_col, *tiebreak,
                                                      F.col(value_col).cast("double").alias("v"))
    n = d.count()
    half = n // 2
    first = F.lit(False)
    if half > 0:
        cnt = d.groupBy(order_col).agg(F.count(F.lit(1)).alias("_c"))
        pos = ordered_running(cnt, order_col, weight_col="_c")
        split = pos.where((F.col("_pos") - F.col("_c") < half) & (F.col("_pos") >= half)) \
            .select(F.col(order_col).cast("string").alias("s"), (F.col("_pos") - F.col("_c")).alias("before")).first()
        # round-trip the split value through its string form and the column's own type:
        # exact for numbers and time-zone independent for timestamp_ntz
        s_val = F.lit(split["s"]).cast(d.schema[order_col].dataType)
        before = split["before"]
        tied = d.where(F.col(order_col) == s_val)
        need = half - before
        if tiebreak:
            tied_pos = row_positions(tied, tiebreak[0], tiebreak=tiebreak[1:]).where(F.col("_rn") <= need) \
                .select(*tiebreak).withColumn("_first_tied", F.lit(True))
            d = d.join(tied_pos, tiebreak, "left")
            first = (F.col(order_col) < s_val) | \
                ((F.col(order_col) == s_val) & F.coalesce(F.col("_first_tied"), F.lit(False)))
        else:
            first = F.col(order_col) < s_val
    a = d.agg(F.avg(F.when(first, F.col("v"))).alias("first_half"),
              F.avg(F.when(~first, F.col("v"))).alias("second_half"),
              F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    chg = F.try_divide((F.col("second_half") - F.col("first_half")) * 100.0, F.abs(F.col("first_half")))
    return a.select(F.lit(n).cast("bigint").alias("n"), "first_half", "second_half", chg.alias("change_pct"),
                    F.try_divide(F.col("std"), F.abs(F.col("mean"))).alias("cv"),
                    F.when(chg > flat_pct, "up").when(chg < -flat_pct, "down").otherwise("flat")
                    .alias("trend"))


def linear_trend(series: DataFrame, period_col: str, value_col: str,
                 key_cols: list[str] | None = None, min_points: int = 2,
                 min_r: float = 0.2, alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """W-7: OLS of value on the 0-based period index (per key): slope, r, t, p, label."""
    key_cols = list(key_cols or [])
    w = Window.partitionBy(*key_cols).orderBy(period_col)
    s = series.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    g = s.groupBy(*key_cols).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.regr_slope(F.col(value_col), F.col("x")).alias("slope"),
        F.regr_intercept(F.col(value_col), F.col("x")).alias("intercept"),
        F.corr(F.col("x"), F.col(value_col)).alias("r"))
    g = g.where(F.col("n") >= min_points)
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("r") * F.col("r")))
    g = g.withColumn("t_stat", F.when(F.abs(F.col("r")) < 1, t))
    if with_p:
        g = g.withColumn("p_value", F.when(F.abs(F.col("r")) >= 1, F.lit(0.0))
                         .otherwise(t_two_sided_col(F.col("t_stat"), F.col("n") - 2)))
        sig = (F.abs(F.col("r")) >= min_r) & (F.col("p_value") <= alpha)
        g = g.withColumn("trend", F.when(~sig, "No significant trend")
                         .when(F.col("slope") > 0, "Upward trend").otherwise("Downward trend"))
    return g


# ---- ADF ------------------------------------------------------------------
# MacKinnon (2010) response-surface critical values, constant-only model:
# tau(T) = b0 + b1/T + b2/T^2 + b3/T^3 for the 1 %, 5 % and 10 % levels.
ADF_CRIT_C = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def _ols_t_aic(y: np.ndarray, X: np.ndarray):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    nobs, k = X.shape
    ssr = float(resid @ resid)
    sigma2 = ssr / (nobs - k)
    cov = sigma2 * np.linalg.pinv(X.T @ X)
    se = math.sqrt(cov[1, 1]) if cov[1, 1] > 0 else float("nan")
    llf = -nobs / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nobs) + 1)
    aic = -2 * llf + 2 * k
    return beta, se, aic


def adf_statistic(x: np.ndarray, maxlag: int | None = None):
    """Augmented Dickey-Fuller t statistic with a constant, lag chosen by AIC
    over a common sample, then re-estimated on the full sample at that lag."""
    x = np.asarray(x, dtype=float)
    nobs = len(x)
    if maxlag is None:
        maxlag = int(math.ceil(12.0 * (nobs / 100.0) ** 0.25))
        maxlag = min(nobs // 2 - 2, maxlag)
    maxlag = max(maxlag, 0)
    dx = np.diff(x)

    def design(lag, start):
        rows = range(start, len(dx))
        y = np.array([dx[t] for t in rows])
        X = np.column_stack([np.ones(len(y)), np.array([x[t] for t in rows])] +
                            [np.array([dx[t - j] for t in rows]) for j in range(1, lag + 1)])
        return y, X

    best_lag, best_aic = 0, float("inf")
    for lag in range(0, maxlag + 1):
        y, X = design(lag, maxlag)
        if len(y) <= X.shape[1]:
            continue
        _, _, aic = _ols_t_aic(y, X)
        if aic < best_aic:
            best_aic, best_lag = aic, lag
    y, X = design(best_lag, best_lag)
    beta, se, _ = _ols_t_aic(y, X)
    stat = beta[1] / se
    return float(stat), best_lag, len(y)


def _crit(level: str, T: int) -> float:
    b = ADF_CRIT_C[level]
    return b[0] + b[1] / T + b[2] / T ** 2 + b[3] / T ** 3


ADF_SCHEMA = ("key string, n_points long, adf_stat double, used_lag long, crit_1pct double, "
              "crit_5pct double, crit_10pct double, is_stationary boolean, trend_slope double, "
              "trend_r double, trend_p double, trend string, interpretation string")


def adf_by_key(period_table: DataFrame, key_col: str, period_col: str, value_col: str,
               min_points: int = 10) -> DataFrame:
    """W-8: one ADF + linear trend per series key.  Input is an already
    aggregated period table (e.g. ``monthly_mean``), so each group is one
    series of period values — small by construction."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(period_col)
        v = pdf[value_col].astype(float).dropna().to_numpy()
        key = str(pdf[key_col].iloc[0])
        if len(v) < min_points:
            return pd.DataFrame([{"key": key, "n_points": len(v), "adf_stat": None, "used_lag": None,
                                  "crit_1pct": None, "crit_5pct": None, "crit_10pct": None,
                                  "is_stationary": None, "trend_slope": None, "trend_r": None,
                                  "trend_p": None, "trend": None,
                                  "interpretation": "Too few time points for analysis (need 10+)."}])
        stat, lag, nused = adf_statistic(v)
        c1, c5, c10 = _crit("1%", nused), _crit("5%", nused), _crit("10%", nused)
        xi = np.arange(len(v), dtype=float)
        slope, _ = np.polyfit(xi, v, 1)
        r = float(np.corrcoef(xi, v)[0, 1]) if np.std(v) > 0 else 0.0
        tt = r * math.sqrt((len(v) - 2) / (1 - r * r)) if abs(r) < 1 else float("inf")
        p = t_two_sided(tt, len(v) - 2)
        trend = ("No significant trend" if abs(r) < 0.2 or p > 0.05
                 else "Upward trend" if slope > 0 else "Downward trend")
        stationary = stat < c5
        note = ("Stationary — mean and variance are stable over time." if stationary else
                "Non-stationary — trend or seasonality present. Differencing required before ARIMA modeling.")
        return pd.DataFrame([{"key": key, "n_points": len(v), "adf_stat": stat, "used_lag": lag,
                              "crit_1pct": c1, "crit_5pct": c5, "crit_10pct": c10,
                              "is_stationary": bool(stationary), "trend_slope": float(slope),
                              "trend_r": r, "trend_p": p, "trend": trend,
                              "interpretation": f"{trend} | {note}"}])

    return (period_table.select(F.col(key_col).cast("string").alias(key_col), period_col,
                                F.col(value_col).cast("double").alias(value_col))
            .groupBy(key_col).applyInPandas(fit, ADF_SCHEMA))


def group_rank_terciles(df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    """W-10: groups ranked by mean (desc, name tie-break) with top/mid/bottom third."""
    g = (df.where(F.col(group_col).isNotNull()).groupBy(group_col)
           .agg(F.avg(F.col(value_col).cast("double")).alias("mean"), F.count(F.lit(1)).alias("n")))
    r = row_positions(g.withColumn("_name", F.col(group_col).cast("string")), "mean",
                      tiebreak=["_name"], ascending=False)
    k = g.count()
    third = k / 3.0
    return r.select(group_col, "mean", "n", F.col("_rn").cast("bigint").alias("rank"),
                    F.when(F.col("_rn") <= math.ceil(third), "top")
                     .when(F.col("_rn") <= math.ceil(2 * third), "middle").otherwise("bottom")
                     .alias("tier"))


def quintile_bands(df: DataFrame, group_col: str, value_col: str, top: int = 20) -> DataFrame:
    """W-11: top ``top`` groups by total; band by position i/n into 5 bands."""
    g = (df.where(F.col(group_col).isNotNull()).groupBy(group_col)
           .agg(F.sum(F.col(value_col).cast("double")).alias("total"))
           .orderBy(F.col("total").desc(), F.col(group_col)).limit(top))
    w = Window.orderBy(F.col("total").desc(), F.col(group_col))  # <= top rows
    g = g.withColumn("pos", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    frac = (F.col("pos") - 1) / F.col("n")
    return g.select(group_col, "total", F.col("pos").cast("bigint").alias("rank"),
                    (F.floor(frac * 5) + 1).cast("int").alias("quintile"))


def consecutive_diff_ratio(df: DataFrame, column: str) -> DataFrame:
    """W-12: share of sorted consecutive differences equal to 1 (id-like test).

    Works on the distinct-value table: repeated values contribute zero
    differences, and each pair of neighbouring distinct values (found by
    joining sorted position ``p`` to ``p - 1`` — an equi-join, no
    single-partition window) contributes one difference."""
    d = (df.where(F.col(column).isNotNull())
           .groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")))
    r = row_positions(d, "v", tiebreak=[]).select("v", F.col("_rn").alias("p"))
    prev = r.select(F.col("v").alias("pv"), (F.col("p") + 1).alias("p"))
    n = d.agg(F.sum("c")).first()[0] or 0
    ones = r.join(prev, "p").agg(F.count_if((F.col("v") - F.col("pv")) == 1).alias("ones"))
    return ones.select(
        F.lit(n - 1).cast("bigint").alias("n_diffs"),
        F.try_divide(F.col("ones").cast("double"), F.lit(float(n - 1))).alias("ratio_diff_one"))


def sorted_group_mean(df: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """W-13: mean of ``y`` per distinct ``x`` sorted by ``x`` (line-chart data)."""
    return (df.where(F.col(x_col).isNotNull()).groupBy(x_col)
              .agg(F.avg(F.col(y_col).cast("double")).alias(y_col)).orderBy(x_col))
