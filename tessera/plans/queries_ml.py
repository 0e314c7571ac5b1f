"""Registered queries: AutoML (M-*).  Model fits have no SQL oracle; the
class-balance and range tables do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml
from .catalog import register, rounded
from .views import hr_view, with_views

HR_FEATURES = ["satisfaction", "tenure", "hours", "projects", "promotion", "dept", "salary"]


def _fit(spark, sf, target="left", task=None, features=HR_FEATURES):
    return ml.train_models(hr_view(spark, sf), target, features, key_cols=["emp_id"], task=task)


@register("M1_detect_task_hr_columns")
def q_m1(spark, sf):
    d = hr_view(spark, sf)
    rows = [(c,) + ml.detect_task(d, c) for c in ["left", "dept", "projects", "satisfaction", "hours"]]
    return spark.createDataFrame(rows, "column string, task string, reason string")


@register("M2_suggest_targets_hr")
def q_m2(spark, sf):
    return rounded(ml.suggest_targets(hr_view(spark, sf), ["left", "dept", "salary", "satisfaction", "projects"]))


@register("M11_class_imbalance_left_hr", with_views("""
SELECT CAST("left" AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS n,
       round(count(*) * 100.0 / (SELECT count("left") FROM hr), 6) AS share_pct,
       CASE WHEN count(*) * 100.0 / (SELECT count("left") FROM hr) < 10 THEN 'severe imbalance'
            WHEN count(*) * 100.0 / (SELECT count("left") FROM hr) < 20 THEN 'moderate imbalance' ELSE 'ok' END AS warning
FROM hr WHERE "left" IS NOT NULL GROUP BY 1""", "hr"))
def q_m11(spark, sf):
    return rounded(ml.imbalance_warning(hr_view(spark, sf), "left"))


@register("M13_model_comparison_attrition_classification")
def q_m13(spark, sf):
    res, _, _, _ = _fit(spark, sf)
    return rounded(res)


@register("M5_model_comparison_hours_regression")
def q_m5(spark, sf):
    res, _, _, _ = _fit(spark, sf, target="hours", task="regression",
                        features=["satisfaction", "tenure", "projects", "dept", "salary"])
    return rounded(res)


@register("M14_feature_importance_best_model")
def q_m14(spark, sf):
    res, fitted, prepared, names = _fit(spark, sf)
    best = res.where(F.col("is_best")).first()["name"]
    return rounded(ml.feature_importance(fitted[best], names, prepared))


@register("M15_feature_ranges_hr", with_views("""
WITH long AS (SELECT 'satisfaction' AS feature, CAST(satisfaction AS DOUBLE) AS v FROM hr
              UNION ALL SELECT 'tenure', CAST(tenure AS DOUBLE) FROM hr UNION ALL SELECT 'hours', CAST(hours AS DOUBLE) FROM hr)
SELECT feature, round(min(v), 6) AS "min", round(max(v), 6) AS "max", round(avg(v), 6) AS mean,
       round(quantile_cont(v, 0.5), 6) AS median FROM long WHERE v IS NOT NULL GROUP BY feature""", "hr").replace(
    "\nWITH long AS", "\n, long AS"))
def q_m15(spark, sf):
    return rounded(ml.feature_ranges(hr_view(spark, sf), ["satisfaction", "tenure", "hours"]))


@register("M16_what_if_satisfaction_plus_0_1")
def q_m16(spark, sf):
    res, fitted, _, _ = _fit(spark, sf)
    best = res.where(F.col("is_best")).first()["name"]
    scen = (hr_view(spark, sf).withColumn("satisfaction", F.col("satisfaction") + 0.1)
            .withColumnRenamed("emp_id", "scenario_id"))
    for c in ["dept", "salary"]:
        scen = scen.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("Unknown")))
    for c in ["satisfaction", "tenure", "hours", "projects", "promotion"]:
        scen = scen.withColumn(c, F.col(c).cast("double"))
    pred = ml.predict_what_if(fitted[best], scen, "classification", labels=["No", "Yes"])
    ranges = ml.feature_ranges(hr_view(spark, sf), ["satisfaction", "tenure", "hours"])
    warn = ml.out_of_range_warnings(scen, ranges)
    return rounded(pred.join(warn, "scenario_id", "left").drop("probabilities"))


@register("M17_scenario_defaults_hr")
def q_m17(spark, sf):
    return rounded(ml.scenario_defaults(hr_view(spark, sf), ["satisfaction", "tenure", "hours"], ["dept", "salary"]))


@register("M19_ml_insights_attrition")
def q_m19(spark, sf):
    res, fitted, prepared, names = _fit(spark, sf)
    best = res.where(F.col("is_best")).first()["name"]
    return rounded(ml.ml_insights(res, "classification", ml.feature_importance(fitted[best], names, prepared),
                                  ml.imbalance_warning(hr_view(spark, sf), "left")))


@register("M20_smart_feature_defaults_hr")
def q_m20(spark, sf):
    feats = ml.smart_feature_defaults(hr_view(spark, sf), "left")
    return spark.createDataFrame([(f,) for f in feats], "feature string")
