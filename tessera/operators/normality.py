"""Normality tests that need the sorted sample: Shapiro-Wilk (H-1).

Shapiro-Wilk is defined on at most 5000 values.  Each column's sample is
a keyed bottom-k of its value table (``bottom_k``): fixed, exact in size and never
larger, however often a value repeats.  The statistic is computed per column with ``applyInPandas``.  Royston's (1995)
approximation for the coefficients and p-value is used.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import dim_join
from ..sources.store import store
from .stats import to_long

# ---- fixed values (Royston 1995 polynomial coefficients) --------------------
SW_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SW_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_C3 = (0.544, -0.39978, 0.025054, -6.714e-4)
SW_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
SW_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
SW_C6 = (-0.4803, -0.082676, 0.0030302)
SW_G = (-2.273, 0.459)
MAX_SW_N = 5000
# -----------------------------------------------------------------------------

_N01 = NormalDist()


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(x) -> tuple[float, float]:
    """(W, p) for a 1-d sample with 3 <= n <= 5000."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3:
        return float("nan"), float("nan")
    if x[-1] - x[0] == 0:
        return 1.0, 1.0
    nn2 = n // 2
    if n == 3:
        a = np.array([math.sqrt(0.5)])
    else:
        # normal scores of the lower half (negative), Royston's weights (positive)
        m = np.array([_N01.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, nn2 + 1)])
        summ2 = 2.0 * float(np.sum(m * m))
        ssumm2 = math.sqrt(summ2)
        rsn = 1.0 / math.sqrt(n)
        a1 = _poly(SW_C1, rsn) - m[0] / ssumm2
        if n > 5:
            a2 = -m[1] / ssumm2 + _poly(SW_C2, rsn)
            fac = math.sqrt((summ2 - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))
            a = -m / fac
            a[1] = a2
        else:
            fac = math.sqrt((summ2 - 2 * m[0] ** 2) / (1 - 2 * a1 ** 2))
            a = -m / fac
        a[0] = a1
    diffs = x[::-1][:nn2] - x[:nn2]
    ss = float(np.sum((x - x.mean()) ** 2))
    w = float(np.sum(a[:nn2] * diffs)) ** 2 / ss
    w = min(w, 1.0)
    if n == 3:
        p = max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, p
    y = math.log(1 - w) if w < 1 else -math.inf
    if n <= 11:
        gamma = _poly(SW_G, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu = _poly(SW_C3, n)
        s = math.exp(_poly(SW_C4, n))
    else:
        xx = math.log(n)
        mu = _poly(SW_C5, xx)
        s = math.exp(_poly(SW_C6, xx))
    if y == -math.inf:
        return w, 1.0
    return w, 1.0 - _N01.cdf((y - mu) / s)


SW_SCHEMA = "column string, n_sample long, shapiro_stat double, shapiro_p double"


def first_copies(counts: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """``(key, _v, _c, _u, _j)``: the copies of values that can be among the k first of their key (``bottom_k``).

    About n t of a key's n copies stand at t or before, and floor(c t - u) + 1 of a value's.  So the copies up to
    t = 1, 1/2, 1/4 .. are counted from the value table, and only those up to the last t that has k of
    them are made: some 2 k a key, whatever its size.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("_v")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    placed = counts.select(key, "_v", "_c", u.alias("_u"))
    upto = F.pow(F.lit(0.5), F.col("_h"))
    n_upto = F.least(F.col("_c"), F.floor(F.col("_c") * upto - F.col("_u")) + 1)
    last = F.floor(F.log2(F.col("_c") / F.greatest(F.col("_u"), F.lit(2.0 ** -53)))).cast("int")  # no copy beyond
    halves = (placed.select(key, "_c", "_u", F.explode(F.sequence(F.lit(0), last)).alias("_h")).groupBy(key, "_h").agg(F.sum(n_upto).alias("_n"))
              .where(F.col("_n") >= k).groupBy(key).agg(F.max("_h").alias("_h")))
    near = dim_join(placed, store(halves, "places"), key, "left").withColumn("_h", F.coalesce("_h", F.lit(0)))
    near = near.withColumn("_m", F.least(n_upto, F.lit(k)).cast("long")).where(F.col("_m") > 0)
    return near.select(key, "_v", "_c", "_u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("_j"))


def bottom_k(counts: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``(key, v)``: a fixed random sample of ``k`` values a key (all, if fewer), exact and bounded.

    ``counts`` is a value table ``(key, _v, _c)``, combined before its shuffle.  Copy j of a value with c
    copies stands at (j + u) / c, u being the value's seeded hash in [0, 1): copies are spread evenly, so
    a value is drawn in its share of the rows, however often it repeats.  The k smallest
    places win.  One task orders some 2 k rows a key (``first_copies``).
    """
    copies = first_copies(counts, key, k, seed)
    place = (F.col("_j") + F.col("_u")) / F.col("_c")
    order = Window.partitionBy(key).orderBy("_place", "_v", "_j")
    return (copies.withColumn("_place", place).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
            .select(key, F.col("_v").alias("v")))


def shapiro_by_column(df: DataFrame, columns: list[str], seed: int = 42,
                      max_n: int = MAX_SW_N, only_small: bool = False) -> DataFrame:
    """H-1 per column over at most ``max_n`` values; ``only_small`` leaves longer columns out."""
    return shapiro_long(to_long(df, columns), "column", "value", seed, max_n, only_small)


def shapiro_long(long: DataFrame, key: str, value: str, seed: int = 42,
                 max_n: int = MAX_SW_N, only_small: bool = False) -> DataFrame:
    """Shapiro-Wilk per ``key`` over its ``bottom_k`` sample."""
    values = long.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("column"), F.col(value).cast("double").alias("_v"))
    if only_small:
        few = values.groupBy("column").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_n).select("column")
        values = dim_join(values, store(few, "small"), "column", "left_semi")
    counts = values.groupBy("column", "_v").agg(F.count(F.lit(1)).alias("_c"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["v"].to_numpy())
        return pd.DataFrame([{"column": pdf["column"].iloc[0], "n_sample": len(pdf),
                              "shapiro_stat": w, "shapiro_p": p}])

    return bottom_k(counts, "column", max_n, seed).groupBy("column").applyInPandas(fit, SW_SCHEMA)
