"""Binning (P-5 fixed right-closed, P-6 quantile, P-7 equal width)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_bins(col: str | Column, edges: list[float], labels: list[str] | None = None,
               right: bool = True, include_lowest: bool = False) -> Column:
    """``pd.cut`` semantics: intervals ``(lo, hi]``; a value equal to the first
    edge falls outside (null) unless ``include_lowest`` (trap T9)."""
    c = F.col(col) if isinstance(col, str) else col
    labels = labels or [f"({edges[i]}, {edges[i + 1]}]" for i in range(len(edges) - 1)]
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        if right:
            cond = (c > lo) & (c <= hi)
            if include_lowest and i == 0:
                cond = (c >= lo) & (c <= hi)
        else:
            cond = (c >= lo) & (c < hi)
        expr = F.when(cond, labels[i]) if expr is None else expr.when(cond, labels[i])
    return expr


def fixed_bins_sql(col: str, edges: list[float], labels: list[str]) -> str:
    arms = " ".join(f"WHEN {col} > {edges[i]} AND {col} <= {edges[i + 1]} THEN '{labels[i]}'"
                    for i in range(len(edges) - 1))
    return f"CASE {arms} END"


def step_bins(col: str | Column, lo: float, step: float) -> Column:
    """N-8: right-closed bins of width ``step`` starting at ``lo``; index k covers
    ``(lo + (k-1)·step, lo + k·step]``. Returns the bin's upper edge."""
    c = F.col(col) if isinstance(col, str) else col
    k = F.ceil((c - F.lit(lo)) / F.lit(step))
    return k


def quantile_bins(col: str | Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """``qcut(duplicates='drop')``: distinct quantile edges; first interval closed on the left."""
    e = sorted(set(edges))
    labels = labels or [f"Q{i + 1}" for i in range(len(e) - 1)]
    return fixed_bins(col, e, labels[: len(e) - 1], include_lowest=True)


def equal_width_bin(col: str | Column, lo: float, hi: float, n: int) -> Column:
    """0-based equal-width bin over ``[lo, hi]``, right-closed, first bin includes ``lo``
    (``pd.cut(bins=n)``).  Degenerate range -> bin 0."""
    c = F.col(col) if isinstance(col, str) else col
    if hi <= lo:
        return F.lit(0).cast("bigint")
    width = (hi - lo) / n
    k = F.ceil((c - F.lit(lo)) / F.lit(width)).cast("bigint") - 1
    return F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)).cast("bigint")


def equal_width_bin_sql(col: str, lo: float, hi: float, n: int) -> str:
    if hi <= lo:
        return "CAST(0 AS BIGINT)"
    width = (hi - lo) / n
    return (f"CAST(least(greatest(CAST(ceil(({col} - {lo!r}) / {width!r}) AS BIGINT) - 1, 0), {n - 1}) AS BIGINT)")


def hist_bin(col: str | Column, lo: float, hi: float, n: int) -> Column:
    """A-12 histogram bin (``np.histogram``): left-closed, last bin closed."""
    c = F.col(col) if isinstance(col, str) else col
    if hi <= lo:
        return F.lit(0).cast("bigint")
    width = (hi - lo) / n
    k = F.floor((c - F.lit(lo)) / F.lit(width)).cast("bigint")
    return F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)).cast("bigint")
