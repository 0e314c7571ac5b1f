"""Structured tool-call registry (D-16): ``dispatch(df, tool, params)``.

A tool call names one operator and its parameters; the result is a
DataFrame (chart tools return their chart data).  Unknown tools or
missing columns produce a one-row error table instead of raising.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregate as agg
from . import corr, select
from .stats import col_stats

TOOLS = ("aggregate", "filter", "top_n", "describe_column", "correlation", "count_values",
         "plot_bar", "plot_histogram", "plot_scatter", "plot_line", "plot_pie", "plot_box", "none")


def _error(df: DataFrame, msg: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(False, msg)], "success boolean, error string")


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """A-3: type, non-null, unique, and numeric stats or the top-5 values."""
    dt = df.schema[column].dataType.simpleString()
    base = df.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("non_null"),
                  F.countDistinct(column).alias("unique")).first()
    head = [F.lit(column).alias("column"), F.lit(dt).alias("type"), F.lit(base["n"]).cast("bigint").alias("n"),
            F.lit(base["non_null"]).cast("bigint").alias("non_null"), F.lit(base["unique"]).cast("bigint").alias("unique")]
    if dt in ("double", "float", "int", "bigint", "smallint", "tinyint") or dt.startswith("decimal"):
        s = col_stats(df, [column], min_n=1)
        return s.select(*head, "mean", "median", "std", "min", "max")
    top = agg.count_values(df, column, 5).agg(F.collect_list(F.col(column).cast("string")).alias("top_values"))
    return top.select(*head, "top_values")


def dispatch(df: DataFrame, tool: str, params: dict | None = None) -> DataFrame:
    p = params or {}
    if tool not in TOOLS:
        return _error(df, f"Unknown tool: {tool}")
    cols = [v for k, v in p.items() if k.endswith("col") or k in ("column", "col_a", "col_b", "x", "y")]
    missing = [c for c in cols if isinstance(c, str) and c not in df.columns]
    if missing:
        return _error(df, f"Column not found: {', '.join(missing)}")
    if tool == "aggregate":
        return agg.aggregate(df, p["group_col"], p["value_col"], p.get("agg_func", "sum"))
    if tool == "filter":
        return select.filter_rows(df, p["column"], p["operator"], p["value"])
    if tool == "top_n":
        return select.top_n(df, p["sort_col"], int(p.get("n", 10)), bool(p.get("ascending", False)))
    if tool == "describe_column":
        return describe_column(df, p["column"])
    if tool == "correlation":
        return corr.pearson(df, p["col_a"], p["col_b"])
    if tool == "count_values":
        return agg.count_values(df, p["column"], 20)
    if tool == "plot_bar":
        return agg.metric_by_group(df, p["x"], p["y"])
    if tool == "plot_histogram":
        return agg.histogram(df, p["column"], int(p.get("bins", 20)))
    if tool == "plot_scatter":
        return select.reproducible_sample(df.select(p["x"], p["y"]), int(p.get("n", 2000)))
    if tool == "plot_line":
        return df.where(F.col(p["x"]).isNotNull()).groupBy(p["x"]).agg(F.avg(p["y"]).alias(p["y"])).orderBy(p["x"])
    if tool == "plot_pie":
        return agg.share_of_total(df, p["column"], p["value_col"], int(p.get("top", 8)))
    if tool == "plot_box":
        return agg.box_summary(df, p["value_col"], p.get("group_col"))
    return df.sparkSession.createDataFrame([(True, "no tool")], "success boolean, error string")
