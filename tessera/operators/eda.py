"""Orchestrators (E-3, E-5..E-8, B-6) returning named result tables.

Each returns a dict of lazy DataFrames; the input is read once per
aggregate pass (callers may ``persist`` a cleaned input).  Column
selection follows the reference: numeric non-identifier columns,
categorical columns with 2..15 (EDA) or 2..25 (BI) levels — with no
caps on the number of columns or rows.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bi, corr, distribution as dist, hypothesis as hyp, insights as ins
from .charts import analysis_columns, pick_primary_metric
from .rules import FACTS, RECOMMENDED, STATISTICS_RULES, facts, fired
from .stats import col_stats, kurtosis_label, skew_label, to_long


def _levels(df: DataFrame, cols: list[str]) -> dict:
    if not cols:
        return {}
    a = df.agg(*[F.countDistinct(c).alias(c) for c in cols]).first()
    return {c: a[c] for c in cols}


def run_eda(df: DataFrame, domain: str = "general", max_levels: int = 15) -> dict:
    """E-3: univariate, pairwise Spearman with effect labels, group comparisons
    (categorical 2..15 levels x numeric), VIF, per-date-column ADF, findings."""
    cols = analysis_columns(df)
    nums = cols["all_metrics"]
    cat_candidates = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    lv = _levels(df, cat_candidates)
    cats = [c for c in cat_candidates if 2 <= lv[c] <= max_levels]
    out = {}
    out["univariate"] = dist.univariate(df, nums) if nums else None
    if len(nums) >= 2:
        pairs = corr.spearman_pairs(df, nums)
        out["correlations"] = pairs.withColumn("effect", corr.effect_label(F.col("r")))
        out["vif"] = corr.vif(df, nums)
    normal = {}
    if out["univariate"] is not None:
        normal = {r["column"]: bool(r["is_normal"]) for r in out["univariate"].select("column", "is_normal").collect()}
    out["group_comparisons"] = (hyp.group_comparisons_long(df, nums, cats, normal=normal)
                                if cats and nums else None)
    if cols["date_cols"] and nums:
        from .timeseries import adf_by_key, monthly_mean
        d0 = cols["date_cols"][0]
        series = monthly_mean(df, d0, nums[0]).withColumn("key", F.lit(nums[0]))
        out["time_series"] = adf_by_key(series, "key", "month_end", nums[0])
    if out["univariate"] is not None:
        out["findings"] = ins.eda_findings(out["univariate"], out.get("correlations"), out.get("group_comparisons"),
                                           out.get("vif"))
    return out


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """E-6: rounded Q-1 with skew / kurtosis labels (statistics-screen ladders:
    kurtosis > 1 heavy, < -1 light), IQR and z-score outliers, and normality by
    Shapiro-Wilk up to 5000 values, D'Agostino-Pearson above; the outlier method follows from it."""
    from .normality import MAX_SW_N, shapiro_by_column
    from .stats import dagostino_k2, kurt_G2, skew_G1, zscore_outliers
    st = col_stats(df, columns)
    k2 = dagostino_k2(df, columns).select("column", F.col("p_value").alias("k2_p"))
    sw = shapiro_by_column(df, columns, only_small=True).select("column", "shapiro_p")
    n = F.col("n").cast("double")
    g1, g2 = skew_G1(F.col("skew"), n), kurt_G2(F.col("kurtosis"), n)
    j = (st.join(k2, "column", "left").join(sw, "column", "left").join(zscore_outliers(df, columns), "column", "left")
         .withColumn("normality_p", F.when(F.col("n") <= MAX_SW_N, F.col("shapiro_p")).otherwise(F.col("k2_p"))))
    normal = F.col("normality_p") > 0.05
    return j.select("column", "n", *[F.round(c, 4).alias(c) for c in ["mean", "median", "std", "min", "max", "q1", "q3"]],
                    F.round(g1, 4).alias("skewness"), skew_label(g1).alias("skew_label"),
                    F.round(g2, 4).alias("kurtosis"), kurtosis_label(g2, 1.0, -1.0).alias("kurtosis_label"),
                    F.when(F.col("n") <= MAX_SW_N, "Shapiro-Wilk").otherwise("D'Agostino-Pearson").alias("normality_test"),
                    normal.alias("is_normal"), "outliers", "outlier_pct", "outliers_zscore",
                    F.when(normal, "Z-Score").otherwise("IQR").alias("outlier_method"))


def categorical_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """E-7: unique count, top value and its share of ALL rows (trap T24), cardinality label."""
    n = df.count()
    long = to_long(df, columns, "string")
    c = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    a = c.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.max("cnt").alias("top_cnt"))
    # ties at the top count: smallest value (trap T17), via partial aggregates only
    tv = c.join(a.select("column", "top_cnt"), "column").where(F.col("cnt") == F.col("top_cnt")) \
        .groupBy("column").agg(F.min("value").alias("top_value"))
    a = a.join(tv, "column")
    u = F.col("n_unique")
    return a.select("column", u.cast("bigint").alias("n_unique"), "top_value",
                    (F.col("top_cnt") / F.lit(float(max(n, 1))) * 100.0).alias("top_pct"),
                    F.when(u <= 2, "binary").when(u <= 10, "low").when(u <= 50, "medium").otherwise("high")
                    .alias("cardinality"))


def stats_analyze(df: DataFrame) -> dict:
    """E-5 / E-8: per-column numeric and categorical statistics, Spearman
    correlations with significance, and dataset-level insights / recommended analyses."""
    cols = analysis_columns(df)
    nums = cols["all_metrics"]
    cats = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    out = {"numeric": numeric_stats(df, nums) if nums else None,
           "categorical": categorical_stats(df, cats) if cats else None}
    if len(nums) >= 2:
        out["correlations"] = corr.spearman_pairs(df, nums)
    known = statistics_facts(df, out, cols, nums, cats)
    out["insights"] = fired(known, STATISTICS_RULES).select("rule", "scope", "column", "text")
    out["recommended_analyses"] = fired(known, RECOMMENDED).select(F.col("rule").alias("analysis"), F.col("text").alias("reason"))
    return out


#: A text column with more distinct values than this share of the rows is taken for an identifier.
HIGH_CARDINALITY = 0.8


def statistics_facts(df: DataFrame, out: dict, cols: dict, nums: list[str], cats: list[str]) -> DataFrame:
    """Facts of the statistics screen for ``rules``: one row a fact of a column, of a pair and of the dataset."""
    spark = df.sparkSession
    known = spark.createDataFrame([], FACTS)
    n_rows = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    single = {"n_numeric": len(nums), "n_categorical": len(cats), "n_dates": len(cols["date_cols"]),
              "n_missing_columns": sum(n_rows[f"m{i}"] > 0 for i in range(len(df.columns))), "n_non_normal": 0, "n_strong": 0, "n_high_cardinality": 0}
    if out["numeric"] is not None:  # one row a column
        num = spark.createDataFrame(out["numeric"].collect(), out["numeric"].schema)
        known = known.unionByName(facts(num, "numeric", F.col("column"), abs_skew=F.abs("skewness"), skew=F.col("skewness"), skew_label=F.col("skew_label"),
                                        mean=F.col("mean"), median=F.col("median"), non_normal=(~F.col("is_normal")).cast("int"), test=F.col("normality_test")))
        single["n_non_normal"] = num.where(~F.col("is_normal")).count()
    if out["categorical"] is not None:
        single["n_high_cardinality"] = out["categorical"].where(F.col("n_unique") > HIGH_CARDINALITY * n_rows["n"]).count()
    if out.get("correlations") is not None:  # one row a pair
        pairs = spark.createDataFrame(out["correlations"].collect(), out["correlations"].schema)
        by = Window.partitionBy("is_significant").orderBy(F.abs("r").desc(), "col_a", "col_b")
        ranked = pairs.where("strength <> 'weak'").withColumn("rank", F.row_number().over(by))
        known = known.unionByName(facts(ranked, "pair", F.concat("col_a", F.lit(" / "), "col_b"), significant=F.col("is_significant").cast("int"),
                                        rank=F.col("rank"), r=F.col("r"), strength=F.col("strength"), direction=F.col("direction")))
        single["n_strong"] = pairs.where("is_significant and strength = 'strong'").count()
    single["n_other"] = sum((single["n_numeric"] >= 2 and single["n_strong"] > 0, single["n_non_normal"] > 0,
                             single["n_categorical"] > 0 and single["n_numeric"] > 0, single["n_dates"] > 0, single["n_numeric"] >= 3))
    return known.unionByName(spark.createDataFrame([("dataset", None, k, float(v), None) for k, v in single.items()], FACTS)
                             .withColumn("column", F.lit("dataset")))


def run_bi(df: DataFrame, domain: str = "general", max_levels: int = 25) -> dict:
    """B-6: benchmarks for numeric columns; Pareto, cohort and segment health on
    the first dimension (2..25 levels); root cause of the primary metric; insights.
    Sum vs mean follows the metric name (rate / score / rating -> mean)."""
    cols = analysis_columns(df)
    nums = cols["all_metrics"]
    cat_candidates = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    lv = _levels(df, cat_candidates)
    dims = [c for c in cat_candidates if 2 <= lv[c] <= max_levels]
    m = pick_primary_metric(cols, domain)
    out = {"benchmarks": bi.benchmark(df, nums) if nums else None}
    if m and dims:
        fn = "mean" if any(k in m.lower() for k in ("rate", "score", "rating")) else "sum"
        out["pareto"] = bi.pareto(df, dims[0], m, fn)
        out["cohort"] = bi.cohort(df, dims[0], m)
        out["segments"] = bi.segment_health(df, dims[0], nums)
        others = [c for c in nums if c != m]
        out["root_cause"] = bi.root_cause(df, m, others, dims)
        out["insights"] = ins.bi_insights(out["benchmarks"], out["pareto"], out["cohort"], out["segments"])
    return out
