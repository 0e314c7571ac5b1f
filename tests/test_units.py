"""Unit and property tests for operators without a SQL oracle, on small
fixtures checked against brute-force NumPy / pandas computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import clean, corr, quantiles, ranks, roles, select
from tessera.operators.domains import hr
from tessera.operators.normality import shapiro_wilk


# ---------------------------------------------------------------- special functions
@pytest.mark.parametrize("t,df,expect", [(2.0, 10, 0.073388), (1.0, 1, 0.5), (0.0, 5, 1.0)])
def test_t_two_sided(t, df, expect):
    assert special.t_two_sided(t, df) == pytest.approx(expect, abs=1e-5)


@pytest.mark.parametrize("x,k,expect", [(3.841459, 1, 0.05), (10.0, 4, 0.040428), (5.991465, 2, 0.05)])
def test_chi2_sf(x, k, expect):
    assert special.chi2_sf(x, k) == pytest.approx(expect, abs=1e-5)


def test_f_sf():
    assert special.f_sf(3.0, 2, 20) == pytest.approx(0.072538, abs=1e-5)


def test_shapiro_textbook_sample():
    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.7888, abs=1e-4)
    assert p == pytest.approx(0.006704, abs=2e-5)


# ---------------------------------------------------------------- distributed primitives
def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 20, 300), rng.normal(size=200).round(2)])
    keys = np.where(np.arange(len(vals)) % 3 == 0, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "v": vals.astype(float)}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], "v", probs, n_buckets=5).collect()}
    for k in ("a", "b"):
        exp = np.percentile(vals[keys == k], [p * 100 for p in probs])
        for i, e in enumerate(exp):
            assert got[k][f"q{i}"] == pytest.approx(e, abs=1e-9)


def test_average_rank_sums_and_ties(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 5.0, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = {row["v"]: row["avg_rank"] for row in ranks.average_rank(df, "v", n_buckets=3).collect()}
    exp = pd.Series(vals).rank(method="average")
    for v, e in zip(vals, exp):
        assert r[v] == pytest.approx(e)
    assert sum(r[v] for v in vals) == pytest.approx(len(vals) * (len(vals) + 1) / 2)


def test_spearman_matches_pandas_with_nulls(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=120)
    b = a * 0.5 + rng.normal(size=120)
    b[::9] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b})
    df = spark.createDataFrame(pdf).select(F.col("a"), F.when(F.isnan("b"), None).otherwise(F.col("b")).alias("b"))
    got = corr.spearman_pairs(df, ["a", "b"], with_p=False).first()
    assert got["r"] == pytest.approx(pdf.corr(method="spearman").loc["a", "b"], abs=1e-12)
    assert got["n"] == int(pdf.dropna().shape[0])


def test_chi_square_with_zero_cells_matches_brute_force(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 3 + [("y", "p")] * 7 + [("z", "q")] * 6
    df = spark.createDataFrame(rows, "a string, b string")
    got = corr.chi_square(df, "a", "b", with_p=False).first()
    ct = pd.crosstab(pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows]))
    e = np.outer(ct.sum(1), ct.sum(0)) / ct.values.sum()
    assert got["chi2"] == pytest.approx(float(((ct.values - e) ** 2 / e).sum()))
    assert got["dof"] == 2


# ---------------------------------------------------------------- semantics
def test_tenure_zero_falls_outside_bands(spark):
    df = spark.createDataFrame([(0.0, "Yes"), (1.0, "No"), (2.0, "yes"), (9.5, "No")], "tenure double, left string")
    out = {r["band"]: r for r in hr.tenure_cohorts(df, "left", "tenure").collect()}
    assert out["1–2 yrs"]["n"] == 2 and out["1–2 yrs"]["n_left"] == 1
    assert sum(r["n"] for r in out.values()) == 3


def test_filter_not_equal_keeps_nulls_and_contains_skips_them(spark):
    df = spark.createDataFrame([("a",), (None,), ("B",)], "s string")
    assert select.filter_rows(df, "s", "!=", "a").count() == 2
    assert select.filter_rows(df, "s", "contains", "b").count() == 1


def test_detect_domain():
    assert roles.detect_domain(["employee_id", "salary", "department", "left", "satisfaction_level"])[0] == "hr"
    assert roles.detect_domain(["foo", "bar"]) == ("general", 0.0)


def test_auto_clean_never_adds_rows_and_is_idempotent(spark):
    pdf = pd.DataFrame({"x": [1.0, None, 3.0, 3.0, 100.0] * 4, "flag": [" yes", "no", "Yes", "Yes", "n"] * 4,
                        "const": ["k"] * 20})
    df = spark.createDataFrame(pdf)
    cleaned, report = clean.auto_clean(df)
    n = cleaned.count()
    assert n <= 20
    assert "const" not in cleaned.columns
    assert dict(cleaned.dtypes)["flag"] == "boolean"
    again, rep2 = clean.auto_clean(cleaned)
    assert again.count() == n


def test_no_single_partition_exchange_on_rows(spark):
    """The only single-partition exchange allowed is above the per-bucket totals
    (n_buckets rows) that yield the offsets; row-level data never goes there."""
    df = spark.range(0, 5000).select((F.col("id") % 97).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ranks.average_rank(df, "v", n_buckets=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate(keys=[_bucket" in lines[i + 1], lines[i + 1]


def test_anderson_and_ks_match_brute_force(spark):
    from statistics import NormalDist

    from tessera.operators import distribution as dist
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(10, 2, 400), 1)  # rounded: many ties
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = dist.anderson_darling(df, ["x"]).first()
    xs = np.sort(x)
    n = len(xs)
    z = (xs - xs.mean()) / xs.std(ddof=1)
    cdf = np.array([NormalDist().cdf(v) for v in z])
    i = np.arange(1, n + 1)
    a2 = -n - np.sum((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1]))) / n
    assert got["anderson_stat"] == pytest.approx(a2, rel=1e-9)
    fits = {r["dist"]: r for r in dist.fit_distributions(df, ["x"]).collect()}
    cdfn = np.array([NormalDist(xs.mean(), xs.std()).cdf(v) for v in xs])
    d = max(np.max(i / n - cdfn), np.max(cdfn - (i - 1) / n))
    assert fits["norm"]["ks_stat"] == pytest.approx(d, rel=1e-9)


def test_keyed_group_comparisons_equal_single_pair_versions(spark):
    from tessera.operators import hypothesis as hyp
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g1": rng.choice(["a", "b", "c"], 300), "g2": rng.choice(["x", "y"], 300),
                        "v1": rng.integers(0, 30, 300).astype(float), "v2": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    many = {(r["numeric_col"], r["group_col"]): r for r in
            hyp.group_comparisons_long(df, ["v1", "v2"], ["g1", "g2"]).collect()}
    assert len(many) == 4
    for n in ("v1", "v2"):
        for c in ("g1", "g2"):
            one = hyp.group_comparison(df, n, c).first()
            got = many[(n, c)]
            assert got["h_stat"] == pytest.approx(one["h_stat"], rel=1e-9)
            assert got["f_stat"] == pytest.approx(one["f_stat"], rel=1e-9)
            assert got["p_value"] == pytest.approx(one["p_value"], rel=1e-6, abs=1e-12)
            assert [g["median"] for g in got["group_stats"]] == pytest.approx([g["median"] for g in one["group_stats"]])


def test_mann_whitney_exact_small_sample():
    import itertools
    from tessera.functions.special import mwu_exact_sf, mwu_p
    # brute force over all splits of ranks 1..7 into 3 + 4
    n1, n2 = 3, 4
    us = []
    for pick in itertools.combinations(range(1, n1 + n2 + 1), n1):
        us.append(sum(pick) - n1 * (n1 + 1) / 2)
    for u in range(0, n1 * n2 + 1):
        assert mwu_exact_sf(u, n1, n2) == pytest.approx(sum(1 for x in us if x >= u) / len(us))
    # two-sided exact p for U1 = 0 (complete separation): 2 * P(U >= 12) = 2/35
    assert mwu_p(0.0, 3, 4, 0.0) == pytest.approx(2 / 35)
    # with ties the asymptotic form is used
    assert 0 < mwu_p(2.0, 3, 4, 6.0) <= 1


def _single_partition_only_above_aggregates(plan: str) -> list:
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = lines[i + 1] if i + 1 < len(lines) else ""
            if "HashAggregate" not in nxt and "ObjectHashAggregate" not in nxt:
                bad.append(nxt.strip())
    return bad


@pytest.mark.parametrize("which", ["col_stats", "exact_quantiles", "spearman"])
def test_plans_move_only_aggregates_to_one_partition(spark, which):
    from tessera.operators import stats
    df = spark.range(0, 20000).select((F.col("id") % 997).cast("double").alias("a"),
                                      (F.col("id") % 13).cast("double").alias("b"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        if which == "col_stats":
            out = stats.col_stats(df, ["a", "b"])
        elif which == "spearman":
            out = corr.spearman_moments(df, ["a", "b"])
        else:
            out = quantiles.exact_quantiles(stats.to_long(df, ["a", "b"]), ["column"], "value", [0.5])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert not _single_partition_only_above_aggregates(plan)
