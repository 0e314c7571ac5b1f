"""Integration tests shaped like the reference's real-world fixtures
(BOM headers, all-null column, single column, outlier pair, duplicates)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import clean, corr, profile as prof, validate as val
from tessera.sources import files


def test_bom_and_padded_headers_are_cleaned(spark):
    df = spark.createDataFrame([(1, 2, 3), (4, 5, 6), (7, 8, 9)], ["﻿Revenue", "Cost﻿", " Profit "])
    names = files.clean_column_names(df.columns)
    assert names == ["Revenue", "Cost", "Profit"]


def test_all_null_column_is_dropped_and_reported(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=100), "b": rng.normal(size=100), "target": rng.integers(0, 2, 100)})
    df = spark.createDataFrame(pdf).withColumn("all_null", F.lit(None).cast("double"))
    cleaned, report = clean.auto_clean(df)
    assert "all_null" not in cleaned.columns
    assert report.where(F.col("column") == "all_null").first()["issue"] == "100% empty"
    checks = {r["check"]: r for r in val.validate(df).collect()}
    assert checks["all_columns_empty"]["passed"]


def test_single_column_has_no_correlations(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "value double")
    assert corr.spearman_pairs(df, ["value"]).count() == 0
    assert corr.pearson_matrix(df, ["value"]).count() == 0


def test_spearman_robust_to_outliers_where_pearson_is_not(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    b = a + rng.normal(scale=0.1, size=200)
    a[:5] = [100, -100, 100, -100, 100]
    b[:5] = [-100, 100, -100, 100, -100]
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    s = corr.spearman_pairs(df, ["a", "b"], with_p=False).first()["r"]
    p = corr.pearson(df, "a", "b").first()["r"]
    assert s > 0.8 and p < 0


def test_sales_with_duplicates_profile_and_clean(spark):
    rng = np.random.default_rng(2)
    base = pd.DataFrame({"OrderID": np.arange(400), "Region": rng.choice(["N", "S", "E", "W"], 400),
                         "Revenue": rng.normal(1000, 300, 400)})
    pdf = pd.concat([base, base.sample(40, random_state=3)], ignore_index=True)
    df = spark.createDataFrame(pdf)
    d = prof.dataset_profile(df).first()
    assert d["duplicate_rows"] == 40 and d["duplicate_pct"] == pytest.approx(9.1)
    cleaned, _ = clean.auto_clean(df)
    assert cleaned.count() == 400
