"""Registered queries: roles / domain detection (D-1..D-5), tool dispatch
(D-16), file sources and sinks (L-*), fingerprint (F-1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import roles, tools
from ..session import ensure_checkpoint_dir
from ..sources import files, sinks
from ..sources.tables import read_table
from .catalog import register, rounded
from .views import ecommerce_view, hr_view, sales_view


def _shared_dir(spark, name: str) -> str:
    """A fresh folder under the cluster-shared ``spark.checkpoint.dir``."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tessera-exports/{name}-{uuid.uuid4().hex[:8]}"


@register("D4_column_roles_orders")
def q_d4(spark, sf):
    return roles.column_roles(read_table(spark, sf, "orders"))


@register("D4_column_roles_hr")
def q_d4b(spark, sf):
    return roles.column_roles(hr_view(spark, sf))


@register("D16_tool_aggregate_sum_price_by_status", """
SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def q_d16a(spark, sf):
    return rounded(tools.dispatch(read_table(spark, sf, "orders"), "aggregate",
                                  {"group_col": "o_orderstatus", "value_col": "o_totalprice", "agg_func": "sum"}),
                   default=2)


@register("D16_tool_filter_contains_segment", """
SELECT * FROM customer WHERE coalesce(contains(lower(CAST(c_mktsegment AS VARCHAR)), 'build'), false)""")
def q_d16b(spark, sf):
    return tools.dispatch(read_table(spark, sf, "customer"), "filter",
                          {"column": "c_mktsegment", "operator": "contains", "value": "BUILD"})


@register("D16_tool_describe_column_price")
def q_d16c(spark, sf):
    return rounded(tools.dispatch(read_table(spark, sf, "orders"), "describe_column", {"column": "o_totalprice"}))


def _encoded(spark, sf, enc, sep):
    path = _shared_dir(spark, f"nation_{enc.lower()}")
    n = read_table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(" é ñ ü")).alias("label"), F.lit("ß").alias("sign"))
    n.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", enc).csv(path)
    found, cut = files.sniff_csv(spark, path + "/*.csv")
    df = files.load_file(spark, path + "/*.csv", max_mb=None)
    return df.select("n_nationkey", "label", "sign", F.lit(found).alias("encoding"), F.lit(cut).alias("separator"))


def _encoded_sql(enc, sep):
    return f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name || ' é ñ ü' AS label, 'ß' AS sign, '{enc}' AS encoding, '{sep}' AS separator FROM nation"


@register("L2_csv_latin1_detected", _encoded_sql("ISO-8859-1", ";"))
def q_l2_latin(spark, sf):
    return _encoded(spark, sf, "ISO-8859-1", ";")


@register("L2_csv_utf16_detected", _encoded_sql("UTF-16", "|"))
def q_l2_wide(spark, sf):
    return _encoded(spark, sf, "UTF-16", "|")


@register("L2_csv_semicolon_roundtrip_orders_summary", """
SELECT CAST(count(*) AS BIGINT) AS rows, round(sum(o_totalprice), 2) AS total_price,
       CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers,
       CAST(min(o_orderdate) AS VARCHAR) AS first_date, CAST(max(o_orderdate) AS VARCHAR) AS last_date,
       'bigint,bigint,string,double,timestamp,string' AS inferred_types FROM orders""")
def q_l2(spark, sf):
    path = _shared_dir(spark, "orders_csv")
    (read_table(spark, sf, "orders").write.mode("overwrite").option("header", True).option("sep", ";")
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    df = files.load_file(spark, path + "/*.csv", max_mb=None)
    types = ",".join(f.dataType.simpleString() for f in df.schema.fields)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total_price"),
                  F.countDistinct("o_custkey").alias("customers"),
                  F.min("o_orderdate").cast("string").alias("first_date"),
                  F.max("o_orderdate").cast("string").alias("last_date"), F.lit(types).alias("inferred_types"))


@register("L4_json_roundtrip_customer_summary", """
SELECT CAST(count(*) AS BIGINT) AS rows, round(sum(c_acctbal), 2) AS total_balance,
       CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS segments FROM customer""")
def q_l4(spark, sf):
    path = _shared_dir(spark, "customer_json")
    sinks.export_json(read_table(spark, sf, "customer"), path)
    df = files.load_file(spark, path + "/*.json", max_mb=None)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("c_acctbal"), 2).alias("total_balance"),
                  F.countDistinct("c_mktsegment").alias("segments"))


@register("L13_workbook_tables_statistics_part")
def q_l13(spark, sf):
    path = _shared_dir(spark, "part_workbook")
    sinks.export_workbook_tables(read_table(spark, sf, "part"), path)
    return rounded(spark.read.parquet(f"{path}/statistics"))


@register("F1_fingerprint_lineitem")
def q_f1(spark, sf):
    return sinks.fingerprint(read_table(spark, sf, "lineitem"))


@register("S1_stream_batch_profiles_orders")
def q_s1(spark, sf):
    """Streaming form of upload -> profile: the orders file arrives as a stream;
    every micro-batch is profiled and stored per epoch in the shared folder."""
    from ..streaming import ingest
    base = _shared_dir(spark, "stream_orders")
    schema = read_table(spark, sf, "orders").schema
    q = ingest.start_profiling(spark, f"{sf.rstrip('/')}/orders.parq*", schema, f"{base}/profiles",
                               f"{base}/checkpoint", base_path=sf)
    q.awaitTermination()
    return rounded(ingest.read_profiles(spark, f"{base}/profiles"))


from .views import with_views  # noqa: E402


@register("D16_tool_plot_bar_rating_by_category", with_views("""
SELECT category, round(avg(rating), 6) AS rating, 'mean' AS agg_func FROM ecommerce WHERE category IS NOT NULL
GROUP BY category ORDER BY rating DESC, category LIMIT 15""", "ecommerce"))
def q_d16_bar(spark, sf):
    return rounded(tools.dispatch(ecommerce_view(spark, sf), "plot_bar", {"x": "category", "y": "rating"}))


@register("D16_tool_plot_pie_revenue_share_by_segment", with_views("""
, t AS (SELECT product, sum(rev) AS value FROM sales WHERE product IS NOT NULL GROUP BY product ORDER BY value DESC, product LIMIT 8)
SELECT product, round(value, 2) AS value, round(value * 100.0 / sum(value) OVER (), 6) AS share_pct FROM t""", "sales"))
def q_d16_pie(spark, sf):
    return rounded(tools.dispatch(sales_view(spark, sf), "plot_pie", {"column": "product", "value_col": "rev"}),
                   {"value": 2})


@register("D16_tool_plot_line_price_by_quantity", """
SELECT l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1""")
def q_d16_line(spark, sf):
    return rounded(tools.dispatch(read_table(spark, sf, "lineitem"), "plot_line", {"x": "l_quantity", "y": "l_extendedprice"}))
