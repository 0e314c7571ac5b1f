"""Registered queries giving the remaining SURVEY §2 operators their own key:
scalar families (S-2..S-9), ML sub-steps (M-*), role bindings and
narratives (D-*), KPI dispatch (N-81)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, ml, narrative, roles, select as sel
from ..operators.domains import dispatch
from ..sources.tables import read_table
from .catalog import register, rounded
from .queries_corr import spearman_sql
from .views import ecommerce_view, hr_view, messy_view, sales_view, with_views


# ------------------------------------------------------------------ S-*
@register("S2_regex_match_and_substitution_documents", """
SELECT lang, CAST(count(*) FILTER (WHERE regexp_matches(lower(text), 'licen[cs]e')) AS BIGINT) AS n_license,
       CAST(sum(length(regexp_replace(text, '[0-9]', '#', 'g'))) AS BIGINT) AS chars_after_digit_mask
FROM documents GROUP BY lang""")
def q_s2(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count_if(F.lower("text").rlike("licen[cs]e")).cast("bigint").alias("n_license"),
                                 F.sum(F.length(F.regexp_replace("text", "[0-9]", "#"))).cast("bigint")
                                 .alias("chars_after_digit_mask"))


@register("S3_parse_and_cast_event_props", """
SELECT event_type, round(sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k_sum,
       CAST(count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NULL) AS BIGINT) AS k_unparsed
FROM events GROUP BY event_type""")
def q_s3(spark, sf):
    e = read_table(spark, sf, "events")
    k = F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)")
    return rounded(e.groupBy("event_type").agg(F.sum(k).alias("k_sum"),
                                               F.count_if(k.isNull()).cast("bigint").alias("k_unparsed")))


@register("S4_date_functions_orders", """
SELECT o_orderstatus, CAST(min(o_orderdate) AS VARCHAR) AS first_order, CAST(max(o_orderdate) AS VARCHAR) AS last_order,
       CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS INTEGER) AS span_days,
       CAST(count(DISTINCT last_day(o_orderdate)) AS BIGINT) AS n_months FROM orders GROUP BY 1""")
def q_s4(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.groupBy("o_orderstatus").agg(F.min("o_orderdate").cast("string").alias("first_order"),
                                          F.max("o_orderdate").cast("string").alias("last_order"),
                                          F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("span_days"),
                                          F.countDistinct(F.last_day("o_orderdate")).cast("bigint").alias("n_months"))


@register("S5_math_functions_lineitem", """
SELECT l_returnflag, round(sum(log2(l_quantity)), 6) AS log2_qty, round(sum(sqrt(l_extendedprice)), 6) AS sqrt_price,
       CAST(sum(ceil(l_extendedprice / 1000)) AS BIGINT) AS ceil_k, round(avg(least(greatest(l_discount * 1000, 0), 100)), 6) AS clipped,
       round(sum(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END), 6) AS safe_ratio FROM lineitem GROUP BY 1""")
def q_s5(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return rounded(li.groupBy("l_returnflag").agg(
        F.sum(F.log2("l_quantity")).alias("log2_qty"), F.sum(F.sqrt("l_extendedprice")).alias("sqrt_price"),
        F.sum(F.ceil(F.col("l_extendedprice") / 1000)).cast("bigint").alias("ceil_k"),
        F.avg(F.least(F.greatest(F.col("l_discount") * 1000, F.lit(0.0)), F.lit(100.0))).alias("clipped"),
        F.sum(F.try_divide(F.col("l_discount"), F.when(F.col("l_tax") != 0, F.col("l_tax")))).alias("safe_ratio")))


@register("S6_null_handling_messy", with_views("""
SELECT CAST(count(*) FILTER (WHERE linenumber IS NULL) AS BIGINT) AS null_linenumber,
       round(sum(coalesce(sparse_discount, 0)), 4) AS filled_discount_sum,
       CAST(count(*) FILTER (WHERE linenumber IS NOT NULL AND sparse_discount IS NOT NULL) AS BIGINT) AS pairwise_complete,
       CAST(count(*) FILTER (WHERE coalesce(CAST(linenumber AS VARCHAR), CAST(sparse_discount AS VARCHAR), status_or_null) IS NULL) AS BIGINT) AS all_null_rows
FROM messy""", "messy"))
def q_s6(spark, sf):
    m = messy_view(spark, sf)
    return m.agg(F.count_if(F.col("linenumber").isNull()).cast("bigint").alias("null_linenumber"),
                 F.round(F.sum(F.coalesce("sparse_discount", F.lit(0.0))), 4).alias("filled_discount_sum"),
                 F.lit(m.dropna(subset=["linenumber", "sparse_discount"]).count()).cast("bigint").alias("pairwise_complete"),
                 F.count_if(F.coalesce(*[F.col(c).cast("string") for c in ["linenumber", "sparse_discount", "status_or_null"]])
                            .isNull()).cast("bigint").alias("all_null_rows"))


@register("S7_sort_by_absolute_value_top10", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) - 50000, 4) AS deviation FROM lineitem
ORDER BY abs(l_extendedprice * (1 - l_discount) - 50000) DESC, l_orderkey, l_linenumber LIMIT 10""")
def q_s7(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumn(
        "deviation", F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")) - 50000)
    return rounded(li.orderBy(F.abs("deviation").desc(), "l_orderkey", "l_linenumber").limit(10)
                   .select("l_orderkey", "l_linenumber", "deviation"), default=4)


@register("S8_distinct_and_cardinality_orders", """
SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS priorities,
       CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS statuses FROM orders""")
def q_s8(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.agg(F.countDistinct("o_custkey").cast("bigint").alias("customers"),
                 F.countDistinct("o_orderpriority").cast("bigint").alias("priorities"),
                 F.countDistinct("o_orderstatus").cast("bigint").alias("statuses"))


@register("S9_sentence_templating_by_region", with_views("""
SELECT region, printf('%s has %d orders from %d customers-nations', region, count(*), count(DISTINCT rep)) AS sentence
FROM sales WHERE region IS NOT NULL GROUP BY region""", "sales"))
def q_s9(spark, sf):
    s = sales_view(spark, sf)
    return s.where(F.col("region").isNotNull()).groupBy("region").agg(
        F.format_string("%s has %d orders from %d customers-nations", F.col("region"), F.count(F.lit(1)),
                        F.countDistinct("rep")).alias("sentence"))


# ------------------------------------------------------------------ M-*
from .queries_ml import HR_FEATURES, _fit  # noqa: E402


@register("M3_prepare_features_hr")
def q_m3(spark, sf):
    d, stages, nums, cats = ml.prepare_features(hr_view(spark, sf), "left", HR_FEATURES, "classification")
    rows = [(c, "numeric (median-imputed)") for c in nums] + [(c, "categorical (alphabetical index)") for c in cats]
    kept = {r[0] for r in rows}
    rows += [(c, "dropped") for c in HR_FEATURES if c not in kept]
    return spark.createDataFrame(rows, "feature string, treatment string").withColumn("n_rows", F.lit(d.count()))


@register("M4_pipeline_stages_best_model")
def q_m4(spark, sf):
    res, fitted, _, _ = _fit(spark, sf)
    best = res.where(F.col("is_best")).first()["name"]
    return spark.createDataFrame([(i, type(s).__name__) for i, s in enumerate(fitted[best].stages)],
                                 "stage_no int, stage string")


@register("M6_classification_model_set")
def q_m6(spark, sf):
    res, _, _, _ = _fit(spark, sf)
    return rounded(res.select("name", "task", "metric_name", "test_score", "train_error"))


@register("M7_M8_split_and_fold_sizes", with_views("""
, c AS (SELECT "left", count(*) AS n, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS t FROM hr WHERE "left" IS NOT NULL GROUP BY 1)
SELECT "left", true AS is_test, -1 AS fold, t AS n FROM c
UNION ALL SELECT "left", false, CAST(k AS INTEGER), (n - t) // 5 + CASE WHEN k < (n - t) % 5 THEN 1 ELSE 0 END FROM c CROSS JOIN range(5) r(k)""", "hr"))
def q_m7(spark, sf):
    d = hr_view(spark, sf).where(F.col("left").isNotNull())
    split = ml._split_cols(d, ["emp_id"], "left")
    return split.select("left", "is_test", F.when(F.col("is_test"), -1).otherwise(F.col("fold")).alias("fold")).groupBy("left", "is_test", "fold").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


@register("M9_regression_metrics_hours")
def q_m9(spark, sf):
    res, _, _, _ = _fit(spark, sf, target="hours", task="regression",
                        features=["satisfaction", "tenure", "projects", "dept", "salary"])
    return rounded(ml.all_fitted(res).select("name", F.col("test_score").alias("r2"), "mae", "rmse"))


@register("M10_classification_metrics_attrition")
def q_m10(spark, sf):
    res, _, _, _ = _fit(spark, sf)
    return rounded(ml.all_fitted(res).select("name", F.col("test_score").alias("accuracy"), "f1", "roc_auc"))


@register("M12_class_balance_table_salary", with_views("""
SELECT CAST(salary AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / (SELECT count(salary) FROM hr), 6) AS share_pct,
       CASE WHEN count(*) * 100.0 / (SELECT count(salary) FROM hr) < 10 THEN 'severe imbalance'
            WHEN count(*) * 100.0 / (SELECT count(salary) FROM hr) < 20 THEN 'moderate imbalance' ELSE 'ok' END AS warning
FROM hr WHERE salary IS NOT NULL GROUP BY 1""", "hr"))
def q_m12(spark, sf):
    return rounded(ml.imbalance_warning(hr_view(spark, sf), "salary"))


@register("M18_run_ml_pipeline_promotion")
def q_m18(spark, sf):
    out = ml.run_ml_pipeline(hr_view(spark, sf), "promotion", ["satisfaction", "tenure", "hours", "dept", "salary"],
                             key_cols=["emp_id"])
    return rounded(out["results"].withColumn("task_reason", F.lit(out["reason"])))


# ------------------------------------------------------------------ D-*
@register("D3_hr_column_bindings_and_satisfaction_scale")
def q_d3(spark, sf):
    h = hr_view(spark, sf)
    sat = roles.find_col(h.columns, ["satisfaction"])
    return spark.createDataFrame([("satisfaction", sat, roles.satisfaction_scale(h, sat)),
                                  ("hours", roles.find_col(h.columns, ["hours"]), None),
                                  ("tenure", roles.find_col(h.columns, ["tenure", "time_spend"]), None)],
                                 "role string, column string, scale double")


@register("D5_analysis_columns_and_primary_metric")
def q_d5(spark, sf):
    rows = []
    for name, fn in [("hr", hr_view), ("sales", sales_view), ("ecommerce", ecommerce_view)]:
        df = fn(spark, sf)
        cols = charts.analysis_columns(df)
        rows.append((name, charts.pick_primary_metric(cols, name), cols["dimensions"][0] if cols["dimensions"] else None,
                     ",".join(cols["all_metrics"]), ",".join(cols["id_cols"])))
    return spark.createDataFrame(rows, "view string, primary_metric string, best_dimension string, metrics string, "
                                       "id_cols string")


@register("D9_headline_selection_hr")
def q_d9(spark, sf):
    from .queries_story import q_d8
    return q_d8(spark, sf).select("domain", "headline")


@register("D13_narrative_dispatch_by_title")
def q_d13(spark, sf):
    s = sales_view(spark, sf)
    specs = charts.recommend_charts(s, "sales").collect()
    return spark.createDataFrame([(sp["title"], narrative.chart_kind_from_title(sp["title"])) for sp in specs],
                                 "title string, narrative_kind string")


@register("D14_raw_summary_lines_hr")
def q_d14(spark, sf):
    return narrative.raw_summary_lines(hr_view(spark, sf), ["satisfaction", "hours", "tenure"], ["dept"],
                                       left="left", by=["dept", "salary"])


@register("D15_executive_summary_sales")
def q_d15(spark, sf):
    return narrative.executive_summary(sales_view(spark, sf), ["rev", "margin", "target"], "sales")


@register("D17_benchmark_context_ecommerce")
def q_d17(spark, sf):
    return rounded(narrative.benchmark_context(ecommerce_view(spark, sf), ["price", "rating", "discount"], "ecommerce"))


# ------------------------------------------------------------------ N-81
@register("N81_domain_kpi_dispatch_with_fallback")
def q_n81(spark, sf):
    parts = []
    for name, df in [("hr", hr_view(spark, sf)), ("sales", sales_view(spark, sf)),
                     ("orders", read_table(spark, sf, "orders"))]:
        dom, k = dispatch.domain_kpis(df)
        parts.append(k.select(F.lit(name).alias("input"), F.lit(dom).alias("domain"), "label", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, default=4)


# ------------------------------------------------------------------ S-1 (string family)
@register("S1_string_functions_part", """
SELECT p_type, CAST(count(*) FILTER (WHERE contains(lower(p_name), 'ring')) AS BIGINT) AS n_ring,
       CAST(sum(length(trim(p_name))) AS BIGINT) AS name_chars, min(substr(p_name, 1, 3)) AS min_prefix3,
       max(replace(lower(p_brand), '#', ' ')) AS max_brand_text FROM part GROUP BY p_type""")
def q_s1s(spark, sf):
    p = read_table(spark, sf, "part")
    return p.groupBy("p_type").agg(
        F.count_if(F.lower("p_name").contains("ring")).cast("bigint").alias("n_ring"),
        F.sum(F.length(F.trim("p_name"))).cast("bigint").alias("name_chars"),
        F.min(F.substring("p_name", 1, 3)).alias("min_prefix3"),
        F.max(F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" "))).alias("max_brand_text"))


@register("C2_correlation_analysis_stats", with_views(
    spearman_sql("hr", ["satisfaction", "tenure", "hours", "projects", "evaluation"], False), "hr"))
def q_c2s(spark, sf):
    from ..operators import corr
    return rounded(corr.spearman_pairs(hr_view(spark, sf), ["satisfaction", "tenure", "hours", "projects", "evaluation"],
                                       with_p=False))
