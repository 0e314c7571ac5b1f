"""More unit and property tests: loaders, ML task rules, text gate, roles,
Pareto / quality-score invariants and streaming ingestion."""

import json
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.operators import bi, ml, profile as prof, quantiles, roles, text
from tessera.sources import files


def _tmp():
    return tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")


# ---------------------------------------------------------------- loaders (L-1, L-2, L-4, L-10, L-11)
def test_csv_semicolon_sniffing_and_type_inference(spark):
    d = _tmp()
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("name;age;score;created_date\n")
        for i in range(50):
            f.write(f"n{i};{20 + i};{i * 1.5};2024-01-{1 + i % 28:02d}\n")
    df = files.load_file(spark, p, max_mb=None)
    types = dict(df.dtypes)
    assert df.count() == 50
    assert types["age"] == "bigint" and types["score"] == "double"
    assert types["name"] == "string" and types["created_date"] == "timestamp"


def test_json_dict_of_lists_and_records(spark):
    d = _tmp()
    p1 = os.path.join(d, "a.json")
    json.dump({"x": [1, 2, 3], "y": ["a", "b", "c"]}, open(p1, "w"))
    df = files.load_file(spark, p1, max_mb=None)
    assert df.count() == 3 and set(df.columns) == {"x", "y"}
    p2 = os.path.join(d, "b.json")
    json.dump([{"x": 1}, {"x": 2}], open(p2, "w"), indent=2)
    assert files.load_file(spark, p2, max_mb=None).count() == 2


def test_unsupported_extension_rejected(spark):
    with pytest.raises(files.LoadError):
        files.load_file(spark, "/tmp/whatever.xml")


# ---------------------------------------------------------------- ML rules (M-1, T14)
def test_detect_task_rules(spark):
    df = spark.createDataFrame(pd.DataFrame({
        "binary": [0, 1] * 50, "few_int": list(range(11)) * 9 + [0],
        "cont": np.linspace(0, 1, 100), "label": ["a", "b", "c", "d"] * 25}))
    assert ml.detect_task(df, "binary")[0] == "classification"
    assert ml.detect_task(df, "few_int")[0] == "classification"
    assert ml.detect_task(df, "cont")[0] == "regression"
    assert ml.detect_task(df, "label")[0] == "classification"   # string targets (T14)


# ---------------------------------------------------------------- text gate, roles
def test_text_gate_reasons(spark):
    df = spark.createDataFrame([(1, "short"), (2, "x" * 50 + " powered by Groq"),
                                (3, "A long enough sentence about marketing spend and other things here."),
                                (4, "This pattern suggests the employee attrition is rising quite a lot now."),
                                (5, "A perfectly fine and sufficiently long sentence about the data set.")],
                               "id long, t string")
    got = {r["id"]: r["reason"] for r in text.text_quality_gate(df, "t", "ecommerce", "id").collect()}
    assert got[1] == "too short"
    assert got[2].startswith("blocked phrase")
    assert got[3].startswith("invented metric")
    assert got[4].startswith("domain contamination")
    assert got[5] is None


def test_find_col_and_identifier_names():
    assert roles.find_col(["Revenue_2024", "cost"], ["revenue"]) == "Revenue_2024"
    assert roles.find_col(["a", "b"], ["revenue"]) is None
    assert roles.is_identifier_by_name("employee_id") is True
    assert roles.is_identifier_by_name("salary") is False


# ---------------------------------------------------------------- invariants (property style)
def test_pareto_shares_sum_to_100(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"g": rng.choice(list("abcdefghij"), 500), "v": rng.random(500)}))
    p = bi.pareto(df, "g", "v").toPandas()
    assert p["pct_of_total"].sum() == pytest.approx(100.0)
    assert p["cumulative_pct"].max() == pytest.approx(100.0)
    assert p["rank"].tolist() == sorted(p["rank"].tolist()) or set(p["rank"]) == set(range(1, 11))
    assert p["in_top_20"].sum() == 2


def test_quality_scores_in_range(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.choice(["x", "y", None], 200), "c": [1.0] * 200})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).select(F.when(F.isnan("a"), None).otherwise(F.col("a")).alias("a"), "b", "c")
    p = prof.column_profiles(df).toPandas()
    assert ((p["quality_score"] >= 0) & (p["quality_score"] <= 100)).all()
    d = prof.dataset_profile(df).first()
    assert 0 <= d["overall_quality_score"] <= 100 and d["grade"] in "ABCDF"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=80))
def test_quantiles_property_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = quantiles.exact_quantiles(df.select(F.lit(1).alias("k"), "v"), ["k"], "v", [0.1, 0.5, 0.9], n_buckets=3).first()
    exp = np.percentile(np.array(values, dtype=float), [10, 50, 90])
    assert [got["q0"], got["q1"], got["q2"]] == pytest.approx(list(exp))


# ---------------------------------------------------------------- streaming
def test_streaming_profiles_each_arriving_file(spark):
    from tessera.streaming import ingest
    d = _tmp()
    src = os.path.join(d, "in")
    os.makedirs(src)
    for i in range(2):
        pd.DataFrame({"x": np.arange(10, dtype=float) + i * 100, "s": ["a"] * 10}).to_parquet(
            os.path.join(src, f"part{i}.parquet"))
    schema = spark.read.parquet(src).schema
    q = ingest.start_profiling(spark, src, schema, os.path.join(d, "out"), os.path.join(d, "ck"),
                               max_files_per_trigger=1)
    q.awaitTermination(120)
    out = ingest.read_profiles(spark, os.path.join(d, "out")).where(F.col("column") == "x").orderBy("epoch_id").collect()
    assert [r["rows"] for r in out] == [10, 10]
    assert sorted(r["mean"] for r in out) == pytest.approx([4.5, 104.5])


def test_row_half_trend_with_hot_timestamp(spark):
    """A third of the rows share one timestamp; halves must follow (ts, id) order exactly."""
    from tessera.operators import timeseries as ts
    rng = np.random.default_rng(9)
    n = 301
    tsv = np.where(np.arange(n) % 3 == 0, 50, rng.integers(0, 100, n))
    pdf = pd.DataFrame({"ts": tsv.astype("int64"), "id": rng.permutation(n).astype("int64"), "v": rng.normal(size=n)})
    got = ts.row_half_trend(spark.createDataFrame(pdf), "ts", "v", ["id"]).first()
    srt = pdf.sort_values(["ts", "id"])
    assert got["first_half"] == pytest.approx(srt["v"].iloc[: n // 2].mean())
    assert got["second_half"] == pytest.approx(srt["v"].iloc[n // 2:].mean())


def test_what_if_unseen_category_maps_to_first_label(spark):
    from tessera.operators import ml
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(200), "x": rng.normal(size=200), "cat": rng.choice(["b", "c"], 200)})
    pdf["y"] = pdf["x"] * 2 + (pdf["cat"] == "c") * 3 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame(pdf)
    res, fitted, _, _ = ml.train_models(df, "y", ["x", "cat"], ["id"], task="regression", folds=2,
                                        model_names=["Ridge Regression"])
    model = fitted["Ridge Regression"]
    scen = spark.createDataFrame([(1, 0.5, "zzz"), (2, 0.5, "b")], "scenario_id int, x double, cat string")
    out = {r["scenario_id"]: r["prediction"] for r in ml.predict_what_if(model, scen, "regression", rmse=1.0).collect()}
    assert out[1] == pytest.approx(out[2])


def test_ordering_keys_are_time_zone_independent(spark):
    """Half split on timestamp_ntz around a DST fall-back is the same in any session zone."""
    from tessera.operators import timeseries as ts
    rows = [(f"2024-11-03 01:{m:02d}:00", i, float(i)) for i, m in enumerate(range(0, 60, 5))] + \
           [(f"2024-11-03 00:{m:02d}:00", 100 + i, float(100 + i)) for i, m in enumerate(range(0, 60, 5))]
    df = spark.createDataFrame(rows, "t string, id long, v double").select(
        F.to_timestamp_ntz("t").alias("t"), "id", "v")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = ts.row_half_trend(df, "t", "v", ["id"]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    utc = ts.row_half_trend(df, "t", "v", ["id"]).first()
    assert ny["first_half"] == pytest.approx(utc["first_half"])
    pdf = df.toPandas().sort_values(["t", "id"])
    assert utc["first_half"] == pytest.approx(pdf["v"].iloc[:12].mean())


def test_col_stats_approx_quantiles_close_to_exact(spark):
    from tessera.operators import stats
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=5000)}))
    ex = stats.col_stats(df, ["x"]).first()
    ap = stats.col_stats(df, ["x"], quantiles="approx").first()
    for k in ("p10", "q1", "median", "q3", "p90"):
        assert abs(ex[k] - ap[k]) < 0.01
    assert ex["mean"] == pytest.approx(ap["mean"])


def test_rank_buckets_of_any_number(spark):
    """The bucket expression has the same size for 40,000 cut points as for 7, in both directions."""
    from bisect import bisect_left, bisect_right

    from pyspark.sql import functions as F

    from tessera.operators.ranks import _bounds_literal, _bucket_of, row_positions

    bounds = [float(i) for i in range(40_000)]
    values = [-1.0, 0.0, 0.5, 1.0, 7.25, 39_998.0, 39_999.0, 50_000.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    up = _bucket_of(F.col("v"), _bounds_literal(bounds), 40_000, True)
    down = _bucket_of(F.col("v"), _bounds_literal(bounds), 40_000, False)
    got = {r["v"]: (r["u"], r["d"]) for r in df.select("v", up.alias("u"), down.alias("d")).collect()}
    assert got == {**{v: (bisect_left(bounds, v), 40_000 - bisect_right(bounds, v)) for v in values}, None: (0, 0)}
    rows = spark.range(500).select((F.col("id") * 37 % 500).cast("double").alias("x"), "id")
    for n in (1, 3, 3000):
        out = row_positions(rows, "x", tiebreak=["id"], n_buckets=n).collect()
        assert all(r["_rn"] == r["x"] + 1 for r in out)


def test_mann_whitney_exact_of_unequal_samples():
    from tessera.functions.special import mwu_exact_sf

    assert mwu_exact_sf(0, 5, 2000) == 1.0
    assert 0.49 < mwu_exact_sf(5000, 5, 2000) < 0.51


def test_mixed_types_beyond_twenty_columns(spark):
    from tessera.operators.validate import validate

    df = spark.createDataFrame([tuple(["1"] * 25), tuple(["x"] * 25)] * 10, [f"c{i}" for i in range(25)])
    checks = [r[0] for r in validate(df).collect()]
    assert any("24" in c for c in checks) and any("c20" in c for c in checks)


def test_f1_of_the_positive_class(spark):
    from tessera.operators.ml import _metrics

    pred = spark.createDataFrame([(0.0, 0.0)] * 90 + [(0.0, 1.0)] * 10, "prediction double, label double")
    got = _metrics(pred, "classification", 2)
    assert got["f1"] == 0.0 and got["accuracy"] == 0.9
    pred = spark.createDataFrame([(1.0, 1.0)] * 3 + [(1.0, 0.0)] * 2 + [(0.0, 1.0)], "prediction double, label double")
    assert abs(_metrics(pred, "classification", 2)["f1"] - 2 * 3 / 9) < 1e-12


def test_loader_keeps_whole_numbers_and_nulls_nan_text(spark):
    p = os.path.join(_tmp(), "t.csv")
    with open(p, "w") as f:
        f.write("amount,rate,size\n9007199254740993,1.5,1e3\n-9007199254740993,NaN,2\n" + "1,inf,3\n" + "5,2.5,4\n" * 20)
    df = files.load_file(spark, p)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "bigint"]
    rows = [tuple(r) for r in df.collect()]
    assert rows[:3] == [(9007199254740993, 1.5, 1000), (-9007199254740993, None, 2), (1, None, 3)]


def test_more_than_50_classes_are_fitted_as_a_regression(spark):
    df = spark.createDataFrame([(i, i % 60, float(i % 60) + (i % 7) / 10, i % 5) for i in range(1500)],
                               "id long, y int, x double, z int")
    out = ml.train_models(df, "y", ["x", "z"], ["id"], task="classification", folds=2, model_names=["Ridge Regression"])
    row = out[0].first()
    assert row["task"] == "regression" and row["train_error"] is None and row["test_score"] > 0.9


def test_ml_insight_tiers(spark):
    def row(name, cv, test, best, error=None):
        return (name, "t", cv, 0.0, test, test, 0.0, "None", "m", None, None, None, None, best, error)

    def tier(task, score):
        res = spark.createDataFrame([row("a", 0.9, score, True), row("b", 0.7, 0.1, False), row("c", -999.0, 0.0, False, "e")],
                                    ml.RESULT_SCHEMA)
        return ml.ml_insights(res, task).first()
    assert [tier("regression", s)["performance"] for s in (0.85, 0.7, 0.5, 0.49)] == ["excellent", "good", "moderate", "weak"]
    assert [tier("classification", s)["performance"] for s in (0.9, 0.75, 0.74)] == ["excellent", "good", "weak"]
    r = tier("regression", 0.9)
    assert abs(r["model_cv_gap"] - 0.2) < 1e-9 and r["model_choice_matters"] and not r["dominant_class_warning"]


def test_sales_rules_leave_small_groups_out(spark):
    from tessera.operators.domains import sales
    df = spark.createDataFrame([("a", 10.0)] * 5 + [("b", 20.0)] * 3 + [("c", 5.0)] * 4 + [("d", 999.0)] * 2 + [(None, 7.0)],
                               "k string, v double")
    gap = {r["k"]: r for r in sales.regional_gap(df, "k", "v").collect()}
    assert set(gap) == {"a", "b", "c"} and gap["a"]["best_worst_gap_pct"] == 300.0  # b by sum over c by sum
    top = sales.product_concentration(df, "k", "v").first()
    assert top["top_product"] == "b" and abs(top["top_share_pct"] - 60 / 130 * 100) < 1e-9
    assert sales.product_concentration(df.where("k = 'a'"), "k", "v").count() == 0


def test_name_helpers(spark):
    from tessera.functions import scalars
    from tessera.operators import tools, validate
    assert set(validate.bad_column_names([" c_custkey", "Unnamed: 1", "c_nationkey", ""])) >= {"Unnamed: 1", ""}
    assert files.clean_column_names(["a", "a", ""], "sanitizer") == ["a", "a_1", "column_2"]
    df = spark.createDataFrame([("satisfaction_level",)], "column string")
    assert df.select(scalars.translate_name_col("column")).first()[0] == "Employee Satisfaction Score"
    assert tools.dispatch(df, "explode_everything", {}).count() == 1
    d, scores = roles.detect_domain(["employee_id", "salary", "left"]), roles.domain_scores(df)
    assert d[0] == "hr" and scores.count() > 0


def test_importance_of_the_best_model_whatever_its_kind(spark):
    from tessera.operators import ml
    rows = [(i, float(i % 10), float((i * 7) % 13), "c" + str(i % 10 // 4), "yes" if i % 10 > 5 else "no") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, z double, three string, two string")
    for target, model in (("two", "Random Forest"), ("three", "Logistic Regression")):
        res, fitted, prepared, names = ml.train_models(df, target, ["x", "z"], ["id"], task="classification", folds=2,
                                                       model_names=[model])
        row = res.first()
        assert row["train_error"] is None and row["roc_auc"] > 0.9
        top = ml.feature_importance(fitted[model], names, prepared).collect()
        assert top[0]["feature"] == "x" and abs(sum(r["importance"] for r in top) - 1) < 1e-9
        assert (top[0]["direction"] == "mixed") == (model == "Random Forest")


def test_linear_importance_is_the_mean_absolute_contribution(spark):
    import numpy as np
    from tessera.operators import ml
    rng = np.random.default_rng(4)
    x, z = rng.exponential(1.0, 300), rng.choice([-1.0, 1.0], 300)
    y = 2 * x - 3 * z + 0.01 * rng.standard_normal(300)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, z, y))], "id long, x double, z double, y double")
    _, fitted, prepared, names = ml.train_models(df, "y", ["x", "z"], ["id"], task="regression", folds=2,
                                                 model_names=["Ridge Regression"])
    got = {r["feature"]: r for r in ml.feature_importance(fitted["Ridge Regression"], names, prepared).collect()}
    part = {"x": 2 * np.abs(x - x.mean()).mean(), "z": 3 * np.abs(z - z.mean()).mean()}
    for f, v in part.items():
        assert abs(got[f]["importance"] - v / sum(part.values())) < 0.02
    assert got["x"]["direction"] == "positive" and got["z"]["direction"] == "negative"


def test_weighted_one_vs_rest_auc(spark):
    from pyspark.ml.linalg import Vectors
    from tessera.operators import ml
    p = [(0, .7, .2, .1), (0, .3, .4, .3), (1, .5, .4, .1), (1, .1, .8, .1), (2, .1, .1, .8), (2, .2, .6, .2), (2, .3, .3, .4)]
    df = spark.createDataFrame([(float(r[0]), Vectors.dense(r[1:])) for r in p], ["label", "probability"])

    def auc(k):
        pos, neg = [r[k + 1] for r in p if r[0] == k], [r[k + 1] for r in p if r[0] != k]
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    want = sum(auc(k) * sum(r[0] == k for r in p) for k in range(3)) / len(p)
    assert abs(ml._ovr_auc(df, 3) - want) < 1e-9 and ml._ovr_auc(df, 4) is None


def test_chart_facts_by_group_means_and_halves(spark):
    from tessera.operators import charts
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("c", 2.0), (None, 99.0), ("d", None)], "k string, v double")
    bar = charts.bar_facts(df, "k", "v").first()
    assert (bar["top"], bar["worst"], bar["n_groups"], bar["gap_pct"]) == ("b", "a", 3, 400.0)
    assert bar["avg_value"] == 23.0 and bar["n_above_avg"] == 0  # over all rows, the unnamed one too
    pie = charts.share_facts(df, "k", "v").first()
    assert pie["top"] == "b" and abs(pie["top_share"] - 1000 / 14) < 1e-9 and abs(pie["top2_share"] - 1200 / 14) < 1e-9
    assert pie["n_segments"] == 3 and not pie["balanced"]
    even = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 1.0)], "k string, v double")
    assert charts.share_facts(even, "k", "v").first()["top"] == "a" and charts.share_facts(even, "k", "v").first()["balanced"]
    none = df.where("k = 'z'")
    assert charts.bar_facts(none, "k", "v").count() == 0 and charts.share_facts(none, "k", "v").count() == 0
    up = charts.trend_facts(spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5])], "p int, v double"), "p", "v")
    assert tuple(up.first())[:3] == (1.5, 4.0, 5) and up.first()["direction"] == "improved"


def test_trees_of_cells_are_those_of_the_rows(spark):
    """Boosted trees fitted on cells are Spark's own of the rows; a forest draws the rows of a cell as often together as alone."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from tessera.operators.tree_cells import Cells
    rng = np.random.default_rng(6)
    n = 12_000  # more rows than Spark draws split candidates from
    x, z, q = rng.integers(0, 12, n), rng.integers(0, 3, n) * 0.37, np.round(rng.normal(size=n) * 2) / 2
    r = x * 2.0 + q * q + rng.normal(size=n)
    pdf = pd.DataFrame({"x": x * 1.0, "z": z, "q": q, "same": 1.0, "r": r, "y": (r + 9 * z > 14) * 1.0})
    d = spark.createDataFrame(pdf).repartition(3)
    scaling = Pipeline(stages=[VectorAssembler(inputCols=["x", "z", "q", "same"], outputCol="raw"),
                               StandardScaler(inputCol="raw", outputCol="features", withMean=True)])
    d = scaling.fit(d).transform(d).persist()
    for task, label, classes in (("classification", "y", 2), ("regression", "r", 0)):
        rows, models = d.select("features", F.col(label).alias("label")).persist(), ml._models(task, classes, 0.0)
        cells = Cells(models["Random Forest"], rows, classes)
        assert cells.n < 800 and cells.n_rows == n and cells.rows.agg(F.sum("n")).first()[0] == n
        boosted = models["Gradient Boosting"].setMaxIter(8)
        mine, theirs = cells.fit(boosted), boosted.fit(rows)
        both = theirs.transform(mine.transform(rows).select("features", F.col("prediction").alias("p")))
        worst = both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0]
        assert worst < 1e-9 and np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)
        if task == "classification":
            grown, alone = cells.fit(models["Random Forest"]), models["Random Forest"].fit(rows)
            p = alone.transform(grown.transform(rows).select("features", vector_to_array("probability")[1].alias("p")))
            assert p.agg(F.avg(F.abs(F.col("p") - vector_to_array("probability")[1]))).first()[0] < 0.02
            assert grown.getNumTrees == 100 and grown.numClasses == 2
            # draws of a tree: as many as rows, their sum Poisson(n)
            sizes = [t._java_obj.rootNode().impurityStats().rawCount() for t in grown.trees]
            assert abs(np.mean(sizes) - n) < 50 and 60 < np.std(sizes) < 160
        cells.unpersist()


def test_train_models_on_cells(spark, monkeypatch):
    """From ``cell_rows`` training rows on trees are fitted on cells, with the scores of the fits on rows."""
    every = ml._models

    def short(*a):
        models = every(*a)
        models["Gradient Boosting"].setMaxIter(5)
        return models
    monkeypatch.setattr(ml, "_models", short)
    rng = np.random.default_rng(8)
    n = 3000
    x, c = rng.integers(0, 9, n), rng.choice(["a", "b"], n)
    y = np.where(x + 3 * (c == "a") + rng.normal(size=n) > 6, "yes", "no")
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x * 1.0, "c": c, "y": y, "v": x * 2.0 + rng.normal(size=n)}))
    for target, names in (("y", ["Random Forest", "Gradient Boosting"]), ("v", ["Gradient Boosting"])):
        task = "classification" if target == "y" else "regression"

        def run(cell_rows):
            res, fitted, _, _ = ml.train_models(df, target, ["x", "c"], ["id"], task=task, folds=2, model_names=names, cell_rows=cell_rows)
            return {r["name"]: r for r in res.collect()}, [type(s).__name__ for s in fitted[names[-1]].stages]
        (rows, stages), (cells, stages_cells) = run(10 ** 9), run(0)
        assert stages == stages_cells
        for name in names:
            assert rows[name]["train_error"] is None and cells[name]["train_error"] is None
            near = 1e-9 if name == "Gradient Boosting" else 0.02
            assert all(abs(rows[name][k] - cells[name][k]) <= near for k in ("cv_score", "train_score", "test_score"))
