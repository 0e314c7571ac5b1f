"""Domain views: bind the analytics roles (revenue, cost, rating, ...) to
columns of the star-schema tables.

Each view exists twice, as a lazy Spark ``DataFrame`` builder and as a
DuckDB CTE body used by the oracle SQL, and both must stay equivalent.
Dimension joins (nation, region) are tiny fixed-size tables; fact-to-fact
joins (orders-customer, lineitem-part) are left to the planner, so AQE
picks broadcast vs sort-merge from the runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from ..functions.joins import dim_join

# Fixed per-segment target rates for the sales view (a binding choice).
SEGMENT_TARGET_RATE = {
    "AUTOMOBILE": 1.10,
    "BUILDING": 0.95,
    "FURNITURE": 1.05,
    "HOUSEHOLD": 0.90,
    "MACHINERY": 1.00,
}


def _rate_expr(col: str) -> F.Column:
    e = None
    for k, v in SEGMENT_TARGET_RATE.items():
        e = (F.when(F.col(col) == k, F.lit(v)) if e is None
             else e.when(F.col(col) == k, F.lit(v)))
    return e.otherwise(F.lit(1.0))


def _rate_sql(col: str) -> str:
    arms = " ".join(f"WHEN {col} = '{k}' THEN CAST({v} AS DOUBLE)"
                    for k, v in SEGMENT_TARGET_RATE.items())
    return f"CASE {arms} ELSE CAST(1.0 AS DOUBLE) END"


# ---------------------------------------------------------------- sales
def sales_view(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    geo = dim_join(n, r, F.col("n_regionkey") == F.col("r_regionkey"))
    cust = dim_join(c, geo, F.col("c_nationkey") == F.col("n_nationkey"))
    df = o.join(cust, o.o_custkey == cust.c_custkey)
    return df.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").alias("rev"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("rep"),
        F.col("c_mktsegment").alias("product"),
        F.when(F.col("o_orderstatus") == "F", "won").otherwise("open").alias("won"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        (F.col("o_totalprice") * _rate_expr("c_mktsegment")).alias("target"),
        (F.col("c_acctbal") / F.lit(100.0)).alias("margin"),
    )


SALES_SQL = f"""
SELECT o_orderkey AS order_id, o_totalprice AS rev, r_name AS region, n_name AS rep,
       c_mktsegment AS product,
       CASE WHEN o_orderstatus = 'F' THEN 'won' ELSE 'open' END AS won,
       strftime(o_orderdate, '%Y-%m') AS period,
       o_totalprice * {_rate_sql('c_mktsegment')} AS target,
       c_acctbal / CAST(100.0 AS DOUBLE) AS margin
FROM orders JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey"""


# ---------------------------------------------------------------- finance
def finance_view(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    p = read_table(spark, sf, "part")
    df = li.join(p, li.l_partkey == p.p_partkey)
    rev = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    cost = F.col("l_quantity") * F.col("p_retailprice")
    return df.select(
        rev.alias("rev"),
        cost.alias("cost"),
        (rev - cost).alias("profit"),
        F.col("l_extendedprice").alias("budget"),
        rev.alias("actual"),
        (F.col("l_tax") * F.col("l_extendedprice")).alias("opex"),
        F.col("p_brand").alias("cat"),
        F.concat(F.year("l_shipdate").cast("string"), F.lit("-Q"),
                 F.quarter("l_shipdate").cast("string")).alias("period"),
    )


FINANCE_SQL = """
SELECT l_extendedprice * (1.0 - l_discount) AS rev,
       l_quantity * p_retailprice AS cost,
       l_extendedprice * (1.0 - l_discount) - l_quantity * p_retailprice AS profit,
       l_extendedprice AS budget,
       l_extendedprice * (1.0 - l_discount) AS actual,
       l_tax * l_extendedprice AS opex,
       p_brand AS cat,
       CAST(year(l_shipdate) AS VARCHAR) || '-Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS period
FROM lineitem JOIN part ON l_partkey = p_partkey"""


# ---------------------------------------------------------------- e-commerce
def ecommerce_view(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    p = read_table(spark, sf, "part")
    df = li.join(p, li.l_partkey == p.p_partkey)
    return df.select(
        F.col("p_name").alias("product"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        (F.col("l_discount") * F.lit(100.0)).alias("discount"),
        (F.lit(1.0) + F.lit(4.0) * (F.col("p_size") - 1).cast("double") / F.lit(49.0)).alias("rating"),
        F.col("l_quantity").alias("reviews"),
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("revenue"),
    )


ECOMMERCE_SQL = """
SELECT p_name AS product, p_type AS category, p_retailprice AS price,
       l_discount * CAST(100.0 AS DOUBLE) AS discount,
       CAST(1.0 AS DOUBLE) + CAST(4.0 AS DOUBLE) * CAST(p_size - 1 AS DOUBLE) / CAST(49.0 AS DOUBLE) AS rating,
       l_quantity AS reviews,
       l_extendedprice * (1.0 - l_discount) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey"""


# ---------------------------------------------------------------- HR
def hr_view(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    c = read_table(spark, sf, "customer")
    first_day = o.select(F.min("o_orderdate")).scalar()
    df = o.join(c, o.o_custkey == c.c_custkey)
    return df.select(
        F.col("o_orderkey").alias("emp_id"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("left"),
        F.col("c_mktsegment").alias("dept"),
        F.col("o_orderpriority").alias("salary"),
        ((F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11000.0)).alias("satisfaction"),
        (F.datediff(F.col("o_orderdate"), first_day).cast("double") / F.lit(365.25)).alias("tenure"),
        (F.col("o_totalprice") / F.lit(500000.0)).alias("evaluation"),
        (F.lit(100.0) + F.col("o_totalprice") / F.lit(2500.0)).alias("hours"),
        (F.floor(F.col("o_totalprice") / F.lit(100000.0)) + 1).cast("bigint").alias("projects"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("promotion"),
        (F.col("o_totalprice") / F.lit(10.0)).alias("income"),
    )


HR_SQL = """
SELECT o_orderkey AS emp_id,
       CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS "left",
       c_mktsegment AS dept, o_orderpriority AS salary,
       (c_acctbal + CAST(1000.0 AS DOUBLE)) / CAST(11000.0 AS DOUBLE) AS satisfaction,
       CAST(date_diff('day', CAST((SELECT min(o_orderdate) FROM orders) AS DATE), CAST(o_orderdate AS DATE)) AS DOUBLE)
           / CAST(365.25 AS DOUBLE) AS tenure,
       o_totalprice / CAST(500000.0 AS DOUBLE) AS evaluation,
       CAST(100.0 AS DOUBLE) + o_totalprice / CAST(2500.0 AS DOUBLE) AS hours,
       CAST(floor(o_totalprice / CAST(100000.0 AS DOUBLE)) + 1 AS BIGINT) AS projects,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS promotion,
       o_totalprice / CAST(10.0 AS DOUBLE) AS income
FROM orders JOIN customer ON o_custkey = c_custkey"""


VIEW_SQL = {"sales": SALES_SQL, "finance": FINANCE_SQL,
            "ecommerce": ECOMMERCE_SQL, "hr": HR_SQL}
VIEWS = {"sales": sales_view, "finance": finance_view,
         "ecommerce": ecommerce_view, "hr": hr_view}


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the named views."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{sql}"


# ---------------------------------------------------------------- messy (cleaning / validation input)
def messy_view(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem projected with injected data-quality problems: nulls, a >55 %
    sparse column, a constant column, padded boolean-like text, duplicates."""
    li = read_table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag"),
        F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_linenumber")).alias("linenumber"),
        F.col("l_quantity"),
        F.col("l_tax"),
        F.when(F.col("l_orderkey") % 10 < 6, None).otherwise(F.col("l_discount")).alias("sparse_discount"),
        F.lit("lineitem").alias("source"),
        F.when(F.col("l_returnflag") == "A", " yes").when(F.col("l_returnflag") == "N", "no ")
         .otherwise("Yes").alias("returned_flag"),
        F.when(F.col("l_linestatus") == "F", None).otherwise(F.col("l_linestatus")).alias("status_or_null"),
    )


MESSY_SQL = """
SELECT l_returnflag,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS linenumber,
       l_quantity, l_tax,
       CASE WHEN l_orderkey % 10 < 6 THEN NULL ELSE l_discount END AS sparse_discount,
       'lineitem' AS source,
       CASE WHEN l_returnflag = 'A' THEN ' yes' WHEN l_returnflag = 'N' THEN 'no ' ELSE 'Yes' END AS returned_flag,
       CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_linestatus END AS status_or_null
FROM lineitem"""
VIEW_SQL["messy"] = MESSY_SQL
VIEWS["messy"] = messy_view
