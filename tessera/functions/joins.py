"""Join helpers with an explicit, checked broadcast bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is only hinted for broadcast when it provably has at most this
# many rows; beyond it the planner's shuffle join (or AQE) takes over.
BROADCAST_MAX_ROWS = 100_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Bounded size check: scans at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def dim_join(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
             max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join a dimension table, broadcasting it only when its size is checked small."""
    if fits_broadcast(dim, max_rows):
        return fact.join(F.broadcast(dim), on, how)
    return fact.join(dim, on, how)


def scalar_row(df: DataFrame) -> dict:
    """Collect a one-row aggregate (bounded by construction) as a dict."""
    row = df.first()
    return row.asDict() if row is not None else {}
