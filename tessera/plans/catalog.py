"""Query catalog: every registered operator bound to the test tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the operator is
SQL-expressible, ``ORACLE[name]`` holds the equivalent DuckDB SQL over
the same parquet tables.  Doubles are rounded identically on both sides
(``round(x, 6)`` for ratios/statistics, ``round(x, 2)`` for money) so the
order-insensitive value hash is stable across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: dict[str, int] | None = None, default: int = 6) -> DataFrame:
    """Round every double column (per-column digits override the default)."""
    digits = digits or {}
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(F.round(F.col(f.name), digits.get(f.name, default)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import the modules whose import registers queries."""
    from . import (queries_core, queries_corr, queries_domains, queries_misc, queries_ml,  # noqa: F401
                   queries_quality,
                   queries_scalar, queries_stats, queries_story, queries_time, queries_extra,
                   queries_extra2, queries_facts)
    from . import queries_oracles  # noqa: F401  (attaches SQL to the keys above)


def attach_oracle(name: str, sql: str) -> None:
    """Give an already registered query its oracle SQL."""
    if name not in QUERIES:
        raise KeyError(name)
    ORACLE[name] = sql
