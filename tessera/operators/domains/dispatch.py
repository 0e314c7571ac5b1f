"""Domain dispatch for KPI tables with a general fallback (N-81)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..roles import detect_domain, find_col
from ..stats import numeric_columns
from . import ecommerce, finance, hr, kpi, kpi_table, sales


def general_kpis(df: DataFrame) -> DataFrame:
    """General KPIs: records, columns, completeness and numeric column count."""
    cols = df.columns
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"nn_{i}") for i, c in enumerate(cols)])
    filled = sum((F.col(f"nn_{i}") for i in range(len(cols))), F.lit(0))
    comp = filled / (F.col("n") * len(cols)) * 100.0
    num = sum(1 for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short"))
    return kpi_table(a, [kpi("Total Records", F.col("n"), F.format_number(F.col("n"), 0)),
                         kpi("Columns", F.lit(len(cols)), F.lit(str(len(cols)))),
                         kpi("Completeness", comp, F.concat(F.format_number(comp, 1), F.lit("%"))),
                         kpi("Numeric Columns", F.lit(num), F.lit(str(num)))])


#: The roles of each domain's KPIs in the order of its function: words of the column's name, whether it must be numeric, whether it must exist.
ROLES = {
    "hr": (hr.hr_kpis, ((("left", "attrition", "churned", "exited"), False, True), (("satisfaction",), True, True), (("tenure", "time_spend", "years_at"), True, True),
                        (("evaluation", "performance"), True, True), (("salary",), False, False))),
    "finance": (finance.finance_kpis, ((("rev", "sales", "income"), True, True), (("cost", "expense"), True, True), (("profit",), True, True), (("budget",), True, True),
                                       (("actual",), True, True), (("opex",), True, False))),
    "ecommerce": (ecommerce.ecommerce_kpis, ((("price",), True, True), (("rating",), True, True), (("discount",), True, True), (("revenue", "amount", "sales"), True, True))),
    "sales": (sales.sales_kpis, ((("rev", "sales", "amount"), True, True), (("target", "quota"), True, True), (("rep", "owner"), False, True), (("margin",), True, True),
                                 (("won", "status", "closed"), False, True))),
}


def domain_kpis(df: DataFrame, domain: str | None = None) -> tuple[str, DataFrame]:
    """N-81: detect (or take) the domain and bind roles by keyword; the general KPIs where a required role is missing
    or stands on a column that is not numeric and should be.  Any other error is raised."""
    domain = domain or detect_domain(df.columns)[0]
    if domain in ROLES:
        kpis, roles = ROLES[domain]
        numeric = set(numeric_columns(df))
        bound = [find_col(df.columns, list(words)) for words, _, _ in roles]
        bound = [None if c and need_number and c not in numeric else c for c, (_, need_number, _) in zip(bound, roles)]
        if all(c or not required for c, (_, _, required) in zip(bound, roles)):
            return domain, kpis(df, *bound)
    return "general", general_kpis(df)
