"""HR operators (N-1..N-11, N-82).

Role arguments: ``left`` (attrition flag, any truthy form), ``dept``,
``salary``, ``satisfaction``, ``tenure``, ``evaluation``, ``hours``,
``projects``, ``promotion``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.binning import fixed_bins
from ...functions.scalars import truthy
from ..hypothesis import chi2_flag_long, mwu_long
from ..quantiles import exact_quantiles
from . import kpi, kpi_table

# ---- fixed values that must equal the reference's -------------------------
TENURE_EDGES = [0, 2, 4, 6, 8, 99]
TENURE_LABELS = ["1–2 yrs", "3–4 yrs", "5–6 yrs", "7–8 yrs", "9+ yrs"]
SATISFACTION_TARGET = 0.70
# ---------------------------------------------------------------------------


def with_flag(df: DataFrame, left: str) -> DataFrame:
    return df.withColumn("_left", truthy(left))


def attrition(df: DataFrame, left: str, critical: float = 25, high: float = 18,
              warning: float = 12) -> DataFrame:
    """N-1: attrition rate %, departures, total, severity (25 / 18 / 12)."""
    d = with_flag(df, left)
    a = d.agg(F.sum("_left").cast("bigint").alias("n_left"), F.count(F.lit(1)).cast("bigint").alias("n_total"))
    rate = F.col("n_left") / F.greatest(F.col("n_total"), F.lit(1)) * 100.0
    return a.select((rate).alias("rate"), "n_left", "n_total",
                    F.when(rate > critical, "critical").when(rate > high, "high")
                     .when(rate > warning, "warning").otherwise("normal").alias("severity"))


def attrition_by(df: DataFrame, left: str, dim: str, extra_means: list[str] | None = None) -> DataFrame:
    """N-2: per group n, departures, attrition % and means of extra columns."""
    d = with_flag(df, left).where(F.col(dim).isNotNull())
    return d.groupBy(dim).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.sum("_left").cast("bigint").alias("n_left"),
        (F.avg("_left") * 100.0).alias("attrition_pct"),
        *[F.avg(F.col(c).cast("double")).alias(f"avg_{c}") for c in (extra_means or [])])


def numeric_drivers(df: DataFrame, left: str, columns: list[str], with_p: bool = True, min_side: int = 5) -> DataFrame:
    """N-3: leavers vs stayers per numeric column with ``min_side`` values on either side: means, diff %, Mann-Whitney."""
    d = with_flag(df, left)
    long = d.select((F.col("_left") == 1).alias("flag"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
        .alias("kv")).select("kv.column", "flag", "kv.value")
    means = long.where(F.col("value").isNotNull()).groupBy("column").agg(
        F.avg(F.when(F.col("flag"), F.col("value"))).alias("left_mean"),
        F.avg(F.when(~F.col("flag"), F.col("value"))).alias("stay_mean"))
    out = means.join(mwu_long(long, with_p=with_p), "column").where(
        (F.col("n_flag") >= min_side) & (F.col("n_rest") >= min_side))
    out = out.withColumn("diff_pct", F.try_divide((F.col("left_mean") - F.col("stay_mean")) * 100.0,
                                                  F.abs(F.col("stay_mean"))))
    if with_p:
        out = out.withColumn("is_driver", F.col("p_value") < 0.05)
    return out


def categorical_drivers(df: DataFrame, left: str, columns: list[str], with_p: bool = True) -> DataFrame:
    """N-4: chi-square per categorical column + best / worst category rates."""
    d = with_flag(df, left)
    long = d.select((F.col("_left") == 1).alias("flag"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
        .alias("kv")).select("kv.column", "flag", "kv.value")
    rates = (long.where(F.col("value").isNotNull()).groupBy("column", "value")
                 .agg((F.avg(F.col("flag").cast("double")) * 100.0).alias("rate")))
    ext = rates.groupBy("column").agg(
        F.max_by("value", F.struct(F.col("rate"), F.col("value"))).alias("worst_category"),
        F.max("rate").alias("worst_rate"),
        F.min_by("value", F.struct(F.col("rate"), F.col("value"))).alias("best_category"),
        F.min("rate").alias("best_rate"))
    return ext.join(chi2_flag_long(long, with_p=with_p), "column")


def flight_risk(df: DataFrame, left: str, satisfaction: str, pct: float = 0.25,
                tenure: str | None = None, min_tenure: float | None = None,
                promotion: str | None = None) -> DataFrame:
    """N-5 (engine: stayers below their 25th pct satisfaction) and N-6 (page:
    40th pct, tenure >= 3, not promoted) flight-risk counts."""
    d = with_flag(df, left)
    stay = d.where(F.col("_left") == 0)
    thr = exact_quantiles(stay.select(F.col(satisfaction).cast("double").alias("v")),
                          [], "v", [pct]).first()
    t = thr["q0"] if thr else None
    cond = F.col(satisfaction) < F.lit(t)
    if tenure and min_tenure is not None:
        cond = cond & (F.col(tenure) >= min_tenure)
    if promotion:
        cond = cond & (truthy(promotion) == 0)
    a = stay.agg(F.count(F.lit(1)).cast("bigint").alias("n_stayers"), F.count_if(cond).cast("bigint").alias("n_flight_risk"))
    return a.select(F.lit(t).cast("double").alias("satisfaction_threshold"), "n_stayers", "n_flight_risk",
                    (F.col("n_flight_risk") / F.greatest(F.col("n_stayers"), F.lit(1)) * 100.0).alias("flight_risk_pct"))


def tenure_cohorts(df: DataFrame, left: str, tenure: str, satisfaction: str | None = None,
                   hours: str | None = None, edges=TENURE_EDGES, labels=TENURE_LABELS) -> DataFrame:
    """N-7: right-closed tenure bands (tenure 0 falls outside, trap T9)."""
    d = with_flag(df, left).withColumn("band", fixed_bins(F.col(tenure), edges, labels))
    d = d.where(F.col("band").isNotNull())
    extra = []
    if satisfaction:
        extra.append(F.avg(F.col(satisfaction).cast("double")).alias("avg_satisfaction"))
    if hours:
        extra.append(F.avg(F.col(hours).cast("double")).alias("avg_hours"))
    return d.groupBy("band").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                 F.sum("_left").cast("bigint").alias("n_left"),
                                 (F.avg("_left") * 100.0).alias("rate"), *extra)


def satisfaction_bins(df: DataFrame, left: str, satisfaction: str, lo: float = 0.05,
                      step: float = 0.05, hi: float = 1.0) -> DataFrame:
    """N-8: attrition % per right-closed satisfaction bin of width 0.05 (bin midpoints)."""
    d = with_flag(df, left).where((F.col(satisfaction) > lo) & (F.col(satisfaction) <= hi))
    k = F.ceil((F.col(satisfaction) - F.lit(lo)) / F.lit(step)).cast("bigint")
    d = d.withColumn("k", k)
    return d.groupBy("k").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                              (F.avg("_left") * 100.0).alias("rate")) \
        .select((F.lit(lo) + (F.col("k") - F.lit(0.5)) * F.lit(step)).alias("mid"), "n", "rate")


def tenure_salary_heatmap(df: DataFrame, left: str, tenure: str, salary: str, salary_levels: list[str],
                          edges=TENURE_EDGES, labels=TENURE_LABELS) -> DataFrame:
    """N-9: tenure band x salary attrition % (pivot; empty cells 0)."""
    d = with_flag(df, left).withColumn("band", fixed_bins(F.col(tenure), edges, labels)) \
        .where(F.col("band").isNotNull() & F.col(salary).isNotNull())
    return d.groupBy("band").pivot(salary, salary_levels).agg(F.avg("_left") * 100.0).fillna(0.0)


def hr_kpis(df: DataFrame, left: str, satisfaction: str, tenure: str, evaluation: str,
            salary: str | None = None, low: str = "low", high: str = "high") -> DataFrame:
    """N-10: records, attrition, satisfaction vs 0.70, median tenure, high
    performers (> 0.70), low-vs-high salary attrition gap."""
    d = with_flag(df, left)
    med_t = exact_quantiles(d.select(F.col(tenure).cast("double").alias("v")),
                            [], "v", [0.5]).first()
    med_t = med_t["q0"] if med_t else None
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("_left").alias("att"), F.sum("_left").alias("n_left"),
            F.avg(F.col(satisfaction).cast("double")).alias("sat"), F.avg(F.col(evaluation).cast("double")).alias("ev"),
            F.count_if(F.col(evaluation) > 0.70).alias("high_perf")]
    if salary:
        s = F.lower(F.col(salary).cast("string"))
        aggs += [F.avg(F.when(s == low, F.col("_left"))).alias("lo_rate"),
                 F.avg(F.when(s == high, F.col("_left"))).alias("hi_rate")]
    a = d.agg(*aggs)
    att = F.col("att") * 100.0
    rows = [
        kpi("Total Records", F.col("n"), F.format_number(F.col("n"), 0), "employees analysed"),
        kpi("Attrition Rate", att, F.concat(F.format_number(att, 1), F.lit("%")),
            F.concat(F.format_number(F.col("n_left"), 0), F.lit(" employees departed")),
            F.when(att > 20, "red").when(att > 12, "amber").otherwise("green")),
        kpi("Avg Satisfaction", F.col("sat"), F.concat(F.format_number(F.col("sat"), 2), F.lit("/1.0")),
            F.format_string("Target: 0.70 | Gap: %+.2f", F.col("sat") - SATISFACTION_TARGET),
            F.when(F.col("sat") >= 0.70, "green").when(F.col("sat") >= 0.55, "amber").otherwise("red")),
        kpi("Median Tenure", F.lit(med_t), F.concat(F.format_number(F.lit(med_t), 1), F.lit(" yrs")),
            "Use median — right-skewed distribution"),
        kpi("Avg Evaluation", F.col("ev"), F.concat(F.format_number(F.col("ev"), 2), F.lit("/1.0")),
            F.concat(F.format_number(F.col("high_perf"), 0), F.lit(" high performers (>0.70)"))),
    ]
    if salary:
        gap = (F.col("lo_rate") - F.col("hi_rate")) * 100.0
        rows.append(kpi("Salary Attrition Gap", gap, F.concat(F.format_number(gap, 1), F.lit("pp")),
                        F.format_string("Low: %.1f%% | High: %.1f%%", F.col("lo_rate") * 100.0, F.col("hi_rate") * 100.0),
                        F.when(gap > 10, "amber").otherwise("slate")))
    return kpi_table(a, rows)


def replacement_cost(df: DataFrame, left: str, salary_value: str, low: float = 0.5,
                     high: float = 1.5) -> DataFrame:
    """N-82: scenario cost of replacing leavers (n_left x salary x 0.5 .. 1.5)."""
    d = with_flag(df, left)
    a = d.agg(F.sum("_left").alias("n_left"), F.avg(F.col(salary_value).cast("double")).alias("avg_salary"))
    return a.select("n_left", "avg_salary",
                    (F.col("n_left") * F.col("avg_salary") * low).alias("cost_low"),
                    (F.col("n_left") * F.col("avg_salary") * high).alias("cost_high"))
