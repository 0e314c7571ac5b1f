"""Bounded samples, pairwise-complete ranks, bracketed quantiles and the distribution functions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.special import gamma_cdf, gammaincc, norm_cdf, norm_cdf_col
from tessera.operators import clean, corr, eda, ml, normality, quantiles, stats
from tessera.operators.ranks import ordered_running
from tessera.sources.store import clear_stored, store


def jobs_of(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = run()
        return out, len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc._jsc.sc().clearJobGroup()


def nulls(rng, n, share):
    return [None if rng.random() < share else float(v) for v in np.round(rng.standard_normal(n), 1)]


def test_spearman_pairwise_complete_equals_pandas(spark):
    rng = np.random.default_rng(3)
    n = 400
    cols = {"a": nulls(rng, n, 0), "b": nulls(rng, n, 0.3), "c": nulls(rng, n, 0.5), "d": nulls(rng, n, 0), "e": [None] * n,
            "f": [1.0] * n}
    cols["g"] = [None if b is None else -b for b in cols["b"]]  # the null pattern of b
    cols["h"] = [v if i < 12 else None for i, v in enumerate(cols["a"])]
    cols["z"] = [0.0 if i % 2 else -0.0 for i in range(n)]
    pdf = pd.DataFrame(cols, dtype=object)
    pdf = pd.concat([pdf, pdf.iloc[[0] * 150]], ignore_index=True)  # a hot row
    df = spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], ", ".join(f"{c} double" for c in pdf.columns))
    got = {(r["col_a"], r["col_b"]): (r["n"], r["r"]) for r in corr.spearman_pairs(df, list(pdf.columns), with_p=False).collect()}
    num = pdf.astype(float)
    for a, b in itertools.combinations(pdf.columns, 2):
        both = num[[a, b]].dropna()
        want = both[a].rank().corr(both[b].rank()) if len(both) >= 10 and both[a].nunique() > 1 and both[b].nunique() > 1 else None
        if want is None:
            assert (a, b) not in got
        else:
            assert got[a, b][0] == len(both) and got[a, b][1] == pytest.approx(want, abs=1e-12)
    assert got["b", "g"][1] == pytest.approx(-1.0)


def test_spearman_shares_ranks_by_null_pattern(spark):
    df = spark.createDataFrame([(1.0, 2.0, None, None), (2.0, 1.0, 3.0, 4.0), (3.0, 5.0, 1.0, 2.0)], "a double, b double, c double, d double")
    classes = corr.row_classes(df, ["a", "b", "c", "d"])
    assert sorted((c["n"], len(c["pairs"])) for c in classes) == [(2, 5), (3, 1)]


def test_spearman_job_count_does_not_grow_with_columns(spark):
    def frame(k):
        return spark.range(300).select(*[F.when(F.col("id") % (i + 2) > 0, (F.col("id") * (i + 7) % 31).cast("double")).alias(f"c{i}") for i in range(k)])

    counts = {}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for k in (3, 8):
            rows, counts[k] = jobs_of(spark, f"spearman{k}", lambda k=k: corr.spearman_pairs(frame(k), [f"c{i}" for i in range(k)], with_p=False).collect())
            assert len(rows) == k * (k - 1) // 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert counts[3] == counts[8]


def test_chi_square_two_by_two_with_unseen_cell(spark):
    def by_hand(cells):
        n = sum(cells.values())
        out = 0.0
        for x, y in itertools.product("xy", "pq"):
            e = sum(v for k, v in cells.items() if k[0] == x) * sum(v for k, v in cells.items() if k[1] == y) / n
            gap = abs(cells.get((x, y), 0) - e)
            out += (gap - min(0.5, gap)) ** 2 / e
        return out

    for cells in ({("x", "p"): 7, ("x", "q"): 3, ("y", "p"): 2, ("y", "q"): 9}, {("x", "p"): 6, ("y", "p"): 2, ("y", "q"): 9},
                  {("x", "p"): 6, ("y", "q"): 9}):
        df = spark.createDataFrame([k for k, c in cells.items() for _ in range(c)], "a string, b string")
        assert corr.chi_square(df, "a", "b", with_p=False).first()["chi2"] == pytest.approx(by_hand(cells), abs=1e-9)


def test_bottom_k_is_bounded_exact_and_proportional(spark):
    hot = spark.range(1_000_000).select(F.lit("one").alias("column"), F.lit(7.0).alias("value"))
    mixed = spark.range(100_000).select(F.lit("mix").alias("column"), F.when(F.col("id") % 3 == 0, -1.0).otherwise(F.col("id").cast("double")).alias("value"))
    few = spark.range(30).select(F.lit("few").alias("column"), (F.col("id") % 10).cast("double").alias("value"))
    long = hot.unionByName(mixed).unionByName(few)
    counts = long.groupBy("column", F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    got = normality.bottom_k(counts, "column", 5000).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == -1).alias("hot")).collect()
    by = {r["column"]: r for r in got}
    assert by["one"]["n"] == 5000 and by["mix"]["n"] == 5000 and by["few"]["n"] == 30
    assert abs(by["mix"]["hot"] - 5000 / 3) < 100  # a third of the rows, a third of the sample
    w = {r["column"]: r for r in normality.shapiro_long(long, "column", "value").collect()}
    assert w["one"]["n_sample"] == 5000 and w["one"]["shapiro_stat"] == 1.0
    again = normality.bottom_k(counts.repartition(7), "column", 5000).where("column = 'mix'").orderBy("v").collect()
    assert again == normality.bottom_k(counts.repartition(3), "column", 5000).where("column = 'mix'").orderBy("v").collect()


def test_normality_method_by_number_of_values(spark):
    normal = spark.range(4000).select(F.expr("sqrt(-2 * ln((id + 1) / 4001.0)) * cos(id * 2.399963)").alias("x"), F.lit(1.0).alias("flat"))
    small = eda.numeric_stats(normal, ["x"]).first()
    assert (small["normality_test"], small["is_normal"], small["outlier_method"]) == ("Shapiro-Wilk", True, "Z-Score")
    big = eda.numeric_stats(spark.range(6000).select(F.col("id").cast("double").alias("x")), ["x"]).first()
    assert (big["normality_test"], big["is_normal"], big["outlier_method"]) == ("D'Agostino-Pearson", False, "IQR")


@pytest.mark.parametrize("n", [1, 2, 3, 9_999, 10_001, 60_000])
def test_quantiles_of_any_length(spark, n):
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 104729) / 13.0).alias("v"))
    pdf = df.toPandas()
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    one = quantiles.exact_quantiles(df, [], "v", probs).first()
    assert one["n"] == n and [one[f"q{i}"] for i in range(len(probs))] == pytest.approx(np.quantile(pdf["v"], probs))
    for r in quantiles.exact_quantiles(df, ["g"], "v", probs).collect():
        assert [r[f"q{i}"] for i in range(len(probs))] == pytest.approx(np.quantile(pdf.loc[pdf["g"] == r["g"], "v"], probs))


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "v double"), [], "v", [0.5]).count() == 0
    assert quantiles.exact_quantiles(spark.createDataFrame([("a", None)], "g string, v double"), ["g"], "v", [0.5]).count() == 0


def test_column_statistics_of_shifted_and_constant_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, 1.0, 30_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "far": x + 1e7, "one": 4.0, "two": (x > 3).astype(float)}))
    got = {r["column"]: r for r in stats.col_stats(df).collect()}
    for c, v in {"x": x, "far": x + 1e7, "two": (x > 3).astype(float)}.items():
        s = pd.Series(v)
        m = s - s.mean()
        assert got[c]["mean"] == pytest.approx(s.mean(), rel=1e-12) and got[c]["std"] == pytest.approx(s.std(), rel=1e-7)
        assert got[c]["skew"] == pytest.approx((m ** 3).mean() / (m ** 2).mean() ** 1.5, rel=1e-6)
        assert got[c]["kurtosis"] == pytest.approx((m ** 4).mean() / (m ** 2).mean() ** 2 - 3, rel=1e-6)
        q1, q3 = s.quantile([0.25, 0.75])
        assert got[c]["outliers"] == ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
    assert (got["one"]["std"], got["one"]["skew"], got["one"]["kurtosis"]) == (0.0, None, None)


def test_distribution_functions_as_columns(spark):
    z = [-40.0, -9.0, -7.08, -7.07, -3.0, -0.5, 0.0, 1e-9, 1.0, 6.5, 7.2, 12.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(norm_cdf_col(F.col("z"))).collect()]
    assert np.abs(np.array(got) - [norm_cdf(v) for v in z]).max() < 1e-14
    x, a = np.array([0.0, -1.0, 1e-9, 0.2, 3.0, 50.0, 900.0, 1000.0]), np.array([1.0, 2.0, 0.5, 0.3, 3.5, 3.5, 900.0, 900.0])
    want = [1 - gammaincc(s, v) if v > 0 else 0.0 for s, v in zip(a, x)]
    assert np.abs(gamma_cdf(x, a) - want).max() < 1e-13
    assert math.isclose(float(gamma_cdf(np.array([2.0]), np.array([1.0]))[0]), 1 - math.exp(-2), rel_tol=1e-13)


def test_modes_need_no_value_map(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", None), ("a", "y"), (None, "y")], "p string, q string")
    out = clean.column_modes(df, ["p", "q"])
    assert {(r["column"], r["value"], r["cnt"]) for r in out.collect()} == {("p", "a", 2), ("q", "x", 2)}
    assert "mode(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_stored_tables_can_be_cleared(spark):
    kept = store(spark.range(5), "probe")
    assert kept.count() == 5 and clear_stored(spark) >= 1 and clear_stored(spark) == 0


@pytest.mark.parametrize("which", ["col_stats", "exact_quantiles"])
def test_values_of_a_key_are_not_brought_together(spark, which):
    df = spark.createDataFrame([(float(i % 97), float(i)) for i in range(500)], "a double, b double")
    if which == "col_stats":
        out = stats.col_stats(df, ["a", "b"])
    else:
        out = quantiles.exact_quantiles(stats.to_long(df, ["a", "b"]), ["column"], "value", [0.5])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r["column"]: r["median" if which == "col_stats" else "q0"] for r in out.collect()}
    assert got == {"a": float(np.median([i % 97 for i in range(500)])), "b": 249.5}


def test_only_copies_that_can_be_drawn_are_made(spark):
    long = spark.range(60000).select(F.lit("far").alias("column"), F.col("id").cast("double").alias("_v")).unionByName(
        spark.range(60000).select(F.lit("few").alias("column"), (F.col("id") % 3).cast("double").alias("_v"))).unionByName(
        spark.range(40).select(F.lit("short").alias("column"), F.col("id").cast("double").alias("_v")))
    counts = long.groupBy("column", "_v").agg(F.count(F.lit(1)).alias("_c"))
    made = {r["column"]: r["count"] for r in normality.first_copies(counts, "column", 1000, 42).groupBy("column").count().collect()}
    assert 1000 <= made["far"] < 3000 and 1000 <= made["few"] < 3000 and made["short"] == 40
    u = F.pmod(F.xxhash64(F.lit(42), "column", "_v"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    every = counts.select("column", "_v", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1), lambda j: (j + u) / F.col("_c"))).alias("p"))
    want = {c: sorted(r["_v"] for r in every.where(F.col("column") == c).orderBy("p").limit(1000).collect()) for c in made}
    got = normality.bottom_k(counts, "column", 1000).collect()
    assert {c: sorted(r["v"] for r in got if r["column"] == c) for c in made} == want


def test_cut_points_of_few_keys_are_broadcast(spark):
    df = spark.createDataFrame([("ab"[i % 2], float(i % 50), 1) for i in range(400)], "k string, v double, t int")
    out = ordered_running(df, "v", part_cols=["k"], weight_col="t", few_keys=True)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    plain = ordered_running(df, "v", part_cols=["k"], weight_col="t")
    assert out.agg(F.max("_pos")).first()[0] == plain.agg(F.max("_pos")).first()[0] == 200


def test_fits_at_once_fall_with_the_rows():
    assert ml.fits_at_once(1000, 18, 6) == 6 and ml.fits_at_once(1000, 2, 6) == 2
    assert ml.fits_at_once(7_200_000, 18, 6) == 2 and ml.fits_at_once(10 ** 9, 18, 6) == 1


def test_constant_numbers_are_found_without_counting_distinct_values(spark, monkeypatch):
    nan = float("nan")
    rows = [(i, i % 2, 3.0, nan, (0.0, -0.0)[i % 2], None, (None, 4)[i % 2], (nan, 1.0)[i % 2], (None, 2, 5)[i % 3], "ab"[i % 2], "a")
            for i in range(12)]
    names = ["y", "same", "nans", "zeros", "nulls", "one", "nan_or_one", "two", "kept", "single"]
    df = spark.createDataFrame(rows, "id int, y int, same double, nans double, zeros double, nulls double, one int, nan_or_one double, "
                                     "two int, kept string, single string")
    counted, real = [], F.countDistinct
    monkeypatch.setattr(F, "countDistinct", lambda c, *more: counted.append(c) or real(c, *more))
    _, stages, nums, cats = ml.prepare_features(df, "y", names[1:], "regression")
    assert (nums, cats) == (["nan_or_one", "two"], ["kept"]) and set(counted) == {"kept", "single"}


def test_training_rows_get_their_score_alone(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 10), "much text " * 9, "yes" if i % 10 > 5 else "no") for i in range(200)],
                               "id long, x double, note string, two string")
    areas, held = [], []
    evaluate, persist = ml.BinaryClassificationEvaluator.evaluate, type(df).persist
    monkeypatch.setattr(ml.BinaryClassificationEvaluator, "evaluate", lambda e, d, *a: areas.append(d.count()) or evaluate(e, d, *a))
    monkeypatch.setattr(type(df), "persist", lambda d, *a: held.append(d.columns) or persist(d, *a))
    res, fitted, prepared, _ = ml.train_models(df, "two", ["x"], ["id"], folds=2, model_names=["Logistic Regression"])
    row = res.first()
    train = fitted["Logistic Regression"].transform(prepared.where("not is_test"))
    assert row["train_score"] == train.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert areas == [prepared.where("is_test").count()] and row["roc_auc"] > 0.9  # the test rows only
    assert held[0] == ["x", "label", "is_test", "fold"]
