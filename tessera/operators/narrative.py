"""Narratives (D-13..D-15, D-17): chart-title dispatch, raw summary lines,
executive summary and per-domain benchmark context — all built from the
aggregate operators' result tables with ``format_string``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import truthy
from . import aggregate as agg
from .chart_facts import kind_of_title
from .stats import col_stats


def chart_kind_from_title(title: str) -> str:
    """D-13: the narrative family of a chart title; a title of no kind is a bar chart."""
    return kind_of_title(title) or "bar"


def raw_summary_lines(df: DataFrame, numeric: list[str], categorical: list[str], left: str | None = None,
                      by: list[str] | None = None) -> DataFrame:
    """D-14: median instead of mean when |skew| > 0.5; top category shares;
    attrition by department / salary band."""
    st = col_stats(df, numeric)
    lines = [st.select(F.lit("numeric").alias("kind"), "column", F.when(
        F.abs(F.col("skew")) > 0.5, F.format_string("%s: median %.2f (skewed, mean %.2f)", "column", "median", "mean"))
        .otherwise(F.format_string("%s: mean %.2f", "column", "mean")).alias("line"))]
    for c in categorical:
        d = agg.distribution(df, c, 3)
        lines.append(d.agg(F.concat_ws(", ", F.collect_list(F.format_string("%s %.1f%%", F.col(c).cast("string"),
                                                                            F.col("share") * 100.0))).alias("s"))
                     .select(F.lit("categorical").alias("kind"), F.lit(c).alias("column"),
                             F.concat(F.lit(f"{c}: "), F.col("s")).alias("line")))
    if left:
        for c in by or []:
            g = df.where(F.col(c).isNotNull()).groupBy(c).agg((F.avg(truthy(left)) * 100.0).alias("r"))
            lines.append(g.agg(F.concat_ws(", ", F.sort_array(F.collect_list(F.format_string(
                "%s %.1f%%", F.col(c).cast("string"), F.col("r"))))).alias("s"))
                .select(F.lit("attrition").alias("kind"), F.lit(c).alias("column"),
                        F.concat(F.lit(f"attrition by {c}: "), F.col("s")).alias("line")))
    return reduce(lambda a, b: a.unionByName(b), lines)


def executive_summary(df: DataFrame, numeric: list[str], domain: str) -> DataFrame:
    """D-15 (rule fallback): size, completeness, duplicates, strongest Pearson
    pair and the most variable metric in one paragraph."""
    from .corr import pearson_matrix
    from .profile import duplicate_rows
    n = df.count()
    miss = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    mp = sum(miss[c] for c in df.columns) / len(df.columns) * 100
    dups = duplicate_rows(df)
    top = pearson_matrix(df, numeric).orderBy(F.abs(F.col("r")).desc(), "col_a", "col_b").first() if len(numeric) > 1 else None
    var = col_stats(df, numeric).orderBy(F.col("cv").desc(), "column").first()
    parts = [f"This {domain} dataset has {n:,} records and {len(df.columns)} columns, {100 - mp:.1f}% complete "
             f"with {dups:,} duplicate rows."]
    if top is not None and top["r"] is not None:
        parts.append(f"The strongest linear relationship is '{top['col_a']}' vs '{top['col_b']}' (r={top['r']:+.2f}).")
    if var is not None:
        parts.append(f"'{var['column']}' is the most variable metric (CV {var['cv'] * 100:.0f}%).")
    return df.sparkSession.createDataFrame([(domain, " ".join(parts))], "domain string, summary string")


def benchmark_context(df: DataFrame, metrics: list[str], domain: str) -> DataFrame:
    """D-17: per-domain context rows — mean, median and range of the key metrics."""
    st = col_stats(df, metrics, min_n=1)
    return st.select(F.lit(domain).alias("domain"), F.col("column").alias("metric"), "mean", "median", "min", "max",
                     F.format_string("%s: typical %.2f (median), range %.2f–%.2f", "column", "median", "min", "max")
                     .alias("context"))
