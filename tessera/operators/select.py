"""Row selection: predicate filter (P-1), top-n (P-3), head / sample (P-4, V-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_rows(df: DataFrame, column: str, operator: str, value) -> DataFrame:
    """P-1: ``>`` ``<`` numeric, ``==`` ``!=`` on the string form, ``contains``
    case-insensitive (null never matches ``contains``)."""
    c = F.col(column)
    if operator == ">":
        cond = c.cast("double") > F.lit(float(value))
    elif operator == "<":
        cond = c.cast("double") < F.lit(float(value))
    elif operator == "==":
        cond = c.cast("string") == F.lit(str(value))
    elif operator == "!=":
        cond = ~c.cast("string").eqNullSafe(F.lit(str(value)))
    elif operator == "contains":
        cond = F.coalesce(F.lower(c.cast("string")).contains(str(value).lower()), F.lit(False))
    else:
        raise ValueError(f"Unknown operator: {operator}")
    return df.where(cond)


def top_n(df: DataFrame, sort_col: str, n: int = 10, ascending: bool = False,
          tiebreak: list[str] | None = None) -> DataFrame:
    """P-3: first ``n`` rows by ``sort_col`` (nulls last both ways); a top-k
    TakeOrdered, so only ``n`` rows per task travel to the final merge."""
    o = F.col(sort_col).asc_nulls_last() if ascending else F.col(sort_col).desc_nulls_last()
    return df.orderBy(o, *[F.col(t) for t in (tiebreak or [])]).limit(n)


def head(df: DataFrame, n: int = 5, max_cols: int = 10) -> DataFrame:
    """P-4: preview of the first ``max_cols`` columns."""
    return df.select(*df.columns[:max_cols]).limit(n)


def reproducible_sample(df: DataFrame, n: int, seed: int = 42,
                        key_cols: list[str] | None = None) -> DataFrame:
    """V-9: deterministic uniform sample of ``n`` rows: order by a seeded hash of
    the row (or key) and keep the first ``n`` (a top-k, independent of layout)."""
    cols = key_cols or df.columns
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])
    return df.withColumn("_h", h).orderBy("_h", *cols).limit(n).drop("_h")
