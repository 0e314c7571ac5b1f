"""Session end-to-end: upload (CSV) -> clean -> profile -> domain -> KPIs ->
insights/story -> ML, on a domain view of the sf0.001 tables."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import clean, corr, insights as ins, ml, profile as prof, roles
from tessera.operators.domains import dispatch, hr
from tessera.plans.views import hr_view, sales_view
from tessera.sources import files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view,expected_domain", [(sales_view, "sales"), (hr_view, "hr")])
def test_upload_clean_profile_story_ml(spark, view, expected_domain):
    out = tempfile.mkdtemp(prefix="tessera-e2e-", dir="/tmp")
    view(spark, SF).write.mode("overwrite").option("header", True).csv(out)
    df = files.load_file(spark, out + "/*.csv", max_mb=None)
    cleaned, report = clean.auto_clean(df)
    assert cleaned.count() <= df.count()
    d = prof.dataset_profile(cleaned).first()
    assert 0 <= d["overall_quality_score"] <= 100 and d["grade"] in "ABCDF"
    domain, kpis = dispatch.domain_kpis(cleaned)
    assert roles.detect_domain(cleaned.columns)[0] == expected_domain
    assert domain == expected_domain and kpis.count() >= 4
    nums = [c for c, t in cleaned.dtypes if t in ("double", "bigint", "int") and c not in ("order_id", "emp_id")]
    story = ins.story(cleaned, nums, domain, ins.general_insights(cleaned, nums).select(
        F.col("text").alias("title"), F.col("text").alias("problem"), F.lit("").alias("cause"),
        F.lit("").alias("evidence"), F.lit("").alias("action"), F.lit("").alias("impact"),
        F.col("severity"), F.col("kind").alias("category")),
        corr_df=corr.spearman_pairs(cleaned, nums[:3], with_p=False)).first()
    assert story["headline"] and story["data_quality"] in ("GOOD", "FAIR", "POOR")
    target = nums[0]
    res, fitted, _, _ = ml.train_models(cleaned, target, nums[1:3], [nums[0], nums[1]], task="regression",
                                        folds=2, model_names=["Ridge Regression"])
    assert res.where(F.col("train_error").isNull()).count() == 1


def test_top_insights_are_at_most_six(spark):
    h = hr_view(spark, SF)
    top = ins.hr_top_insights(h, "left", dept="dept", satisfaction="satisfaction", salary="salary",
                              tenure="tenure", numeric=["satisfaction", "hours", "tenure"])
    assert top.count() <= 6
    assert hr.attrition(h, "left").first()["severity"] in ("critical", "high", "warning", "normal")
