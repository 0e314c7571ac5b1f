"""Validation (V-1..V-8): blocking checks and warnings as a checks table.

All checks come from one wide aggregate plus the duplicate count; the
result is one row per check ``(check, severity, value, passed, message)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import duplicate_rows
from .stats import NUMERIC_TYPES

# ---- fixed values that must equal the reference's -------------------------
MIN_ROWS = 2
MIXED_TYPE_LOW, MIXED_TYPE_HIGH = 0.30, 0.85
# ---------------------------------------------------------------------------

CHECK_SCHEMA = "check string, severity string, value double, passed boolean, message string"


def bad_column_names(columns: list[str]) -> list[str]:
    """V-5: blank, ``Unnamed`` or padded names."""
    return [c for c in columns
            if not str(c).strip() or str(c).startswith("Unnamed") or str(c) != str(c).strip()]


def validate(df: DataFrame, max_rows: int | None = None, max_cols: int | None = None) -> DataFrame:
    """Validation checks; the size limits are off unless given."""
    max_rows = float("inf") if max_rows is None else max_rows
    max_cols = float("inf") if max_cols is None else max_cols
    fields = df.schema.fields
    cols = [f.name for f in fields]
    num = [f.name for f in fields if isinstance(f.dataType, NUMERIC_TYPES)]
    fl = [f.name for f in fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    strs = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count(F.col(c)).alias(f"nn__{i}") for i, c in enumerate(cols)]
    if cols:
        aggs.append(F.count_if(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNull())
                    .alias("all_null_rows"))
    aggs += [F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"inf__{i}") for i, c in enumerate(fl)]
    aggs += [F.avg(F.when(F.col(c).isNotNull(),
                          F.expr(f"try_cast(`{c}` AS DOUBLE)").isNotNull().cast("double")))
             .alias(f"numlike__{i}") for i, c in enumerate(strs)]
    a = df.agg(*aggs).first().asDict()
    n, k = a["n"], len(cols)
    rows = []

    def add(check, severity, value, passed, message):
        rows.append((check, severity, None if value is None else float(value), bool(passed), message))

    add("empty", "error", n, n > 0, "Dataset is empty — no rows found." if n == 0 else "")
    add("no_columns", "error", k, k > 0, "Dataset has no columns." if k == 0 else "")
    add("min_rows", "error", n, n >= MIN_ROWS, "" if n >= MIN_ROWS else f"Only {n} rows")
    add("max_cols", "error", k, k <= max_cols, "" if k <= max_cols else f"{k} columns exceeds {max_cols}")
    add("max_rows", "error", n, n <= max_rows, "" if n <= max_rows else f"{n} rows exceeds {max_rows}")
    non_empty = sum(1 for i in range(k) if a[f"nn__{i}"] > 0)
    add("all_columns_empty", "error", non_empty, non_empty > 0 or k == 0,
        "All columns are empty." if k and not non_empty else "")
    missing = sum(n - a[f"nn__{i}"] for i in range(k))
    mpct = missing / max(n * k, 1) * 100
    add("missing_cells_pct", "warning", mpct, mpct <= 20,
        "very high missing" if mpct > 50 else "high missing" if mpct > 20 else "")
    anr = a.get("all_null_rows", 0) or 0
    add("all_null_rows", "warning", anr, anr == 0, f"{anr} completely empty rows" if anr else "")
    dups = duplicate_rows(df) if k else 0
    add("duplicate_rows", "warning", dups, dups == 0,
        f"{dups} duplicate rows ({dups / max(n, 1) * 100:.1f}%)" if dups else "")
    add("duplicate_rows_pct", "warning", dups / max(n, 1) * 100, dups == 0, "")
    bad = bad_column_names(cols)
    add("bad_column_names", "warning", len(bad), not bad, ", ".join(bad))
    infs = sum(a[f"inf__{i}"] for i in range(len(fl)))
    add("infinite_values", "warning", infs, infs == 0, f"{infs} infinite values" if infs else "")
    for i, c in enumerate(strs):
        r = a[f"numlike__{i}"]
        if r is not None and MIXED_TYPE_LOW < r < MIXED_TYPE_HIGH:
            add(f"mixed_type:{c}", "warning", r * 100, False,
                f"Column '{c}' looks mixed-type ({r * 100:.0f}% numeric)")
    return df.sparkSession.createDataFrame(rows, CHECK_SCHEMA)


def validate_upload(size_mb: float, rows: int, cols: int, max_mb: float = 150.0,
                    max_rows: int = 500_000, max_cols: int = 200) -> list[str]:
    """V-8: limit messages for an upload of the given size/shape."""
    msgs = []
    if size_mb > max_mb:
        msgs.append(f"File is {size_mb:.0f} MB; limit is {max_mb:.0f} MB")
    if rows > max_rows:
        msgs.append(f"{rows:,} rows; limit is {max_rows:,}")
    if cols > max_cols:
        msgs.append(f"{cols} columns; limit is {max_cols}")
    return msgs
