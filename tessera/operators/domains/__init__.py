"""Domain operators (HR, finance, e-commerce, sales, general).

Roles (revenue, cost, attrition flag, ...) are explicit column-name
arguments; ``roles.find_col`` offers keyword auto-binding as a default.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def kpi(label: str, value: Column, formatted: Column, sub: Column | str = "",
        status: Column | str = "") -> Column:
    """One KPI row as a struct (label, value, formatted, sub, status)."""
    return F.struct(F.lit(label).alias("label"), value.cast("double").alias("value"),
                    formatted.alias("formatted"),
                    (F.lit(sub) if isinstance(sub, str) else sub).alias("sub"),
                    (F.lit(status) if isinstance(status, str) else status).alias("status"))


def kpi_table(one_row_agg, structs: list[Column]):
    """Turn a one-row aggregate into KPI rows (lazy; ``inline`` of structs)."""
    return one_row_agg.select(F.inline(F.array(*structs)))
