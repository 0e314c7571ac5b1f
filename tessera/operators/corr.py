"""Correlation and association (C-1..C-10).

Spearman = Pearson on average ranks, pairwise complete: a pair is ranked on the rows where
both its columns are present.  Pairs whose sets of rows are the same form a class and share
their ranks; which pairs do is read from the null patterns of the rows, a table of
patterns and counts.  Ranks of every (class, column) come from ONE keyed ordering of the distinct-value
table, are joined back on the value and regrouped by row, so the number of passes depends
neither on the number of columns nor on where the nulls are.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf_col, t_two_sided_col
from .quantiles import exact_quantiles
from .ranks import ordered_running
from .stats import numeric_columns, to_long

PAIR_SCHEMA = "col_a string, col_b string, n long, r double"


def _constant(value, schema: str) -> Column:
    """A nested constant of any size as one foldable expression."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def row_classes(df: DataFrame, columns: list[str]) -> list[dict]:
    """Classes of column pairs that are complete on the same rows.

    Each is ``{"n": rows, "pairs": [(i, j), ...], "columns": [i, ...]}``.  The set of rows of a pair is the
    union of the null patterns that have both columns; two 64-bit sums of pattern hashes and the
    number of rows tell the sets apart.  One row a pair comes to the driver.
    """
    k = len(columns)
    patterns = df.groupBy(F.array(*[F.col(c).isNotNull() for c in columns]).alias("has")).agg(F.count(F.lit(1)).alias("n"))
    pairs = _constant([[i, j] for i, j in itertools.combinations(range(k), 2)], "array<array<int>>")
    both = patterns.select("n", "has", F.explode(F.filter(pairs, lambda p: F.get("has", p[0]) & F.get("has", p[1]))).alias("p"))
    wide = [F.sum(F.xxhash64(F.lit(seed), F.col("has")).cast("decimal(38,0)")) for seed in (17, 29)]
    rows = both.groupBy(F.col("p")[0].alias("i"), F.col("p")[1].alias("j")).agg(F.sum("n").alias("n"), wide[0].alias("a"), wide[1].alias("b")).collect()
    classes: dict[tuple, dict] = {}
    for r in sorted(rows, key=lambda r: (r["i"], r["j"])):
        c = classes.setdefault((r["n"], r["a"], r["b"]), {"n": int(r["n"]), "pairs": [], "columns": set()})
        c["pairs"].append((r["i"], r["j"]))
        c["columns"] |= {r["i"], r["j"]}
    return [{**c, "columns": sorted(c["columns"])} for c in classes.values()]


def spearman_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(col_a, col_b, n, sxy, sxx, syy)`` of the centred ranks of every pair with a complete row.

    Rows that are equal in all columns merge with a weight: their ranks are equal.  Two 64-bit
    hashes of all columns name a row.
    """
    classes = row_classes(df, columns)
    out = "col_a string, col_b string, n long, sxy double, sxx double, syy double"
    if not classes:
        return df.sparkSession.createDataFrame([], out)
    x = [F.when(F.col(c) == 0, 0.0).otherwise(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(columns)]  # one zero
    rows = df.select(*x)
    rows = rows.select("*", *[F.xxhash64(F.lit(seed), *rows.columns).alias(h) for seed, h in ((17, "h1"), (29, "h2"))])

    def complete(pair: tuple[int, int]) -> Column:
        return F.col(f"x{pair[0]}").isNotNull() & F.col(f"x{pair[1]}").isNotNull()

    cells = F.array(*[F.when(complete(x["pairs"][0]), F.struct(F.lit(c).alias("c"), F.lit(i).alias("i"), F.col(f"x{i}").alias("v")))
                      for c, x in enumerate(classes) for i in x["columns"]])
    long = rows.select("h1", "h2", F.explode(cells).alias("e")).where(F.col("e").isNotNull()).select("h1", "h2", "e.*")
    counts = long.groupBy("c", "i", "v").agg(F.count(F.lit(1)).alias("t"))
    order = ordered_running(counts, "v", part_cols=["c", "i"], weight_col="t", few_keys=True)
    ranks = order.select("c", "i", "v", (F.col("_pos") - F.col("t") + (F.col("t") + 1) / 2.0).alias("rk"))
    row = long.join(ranks, ["c", "i", "v"]).groupBy("h1", "h2", "c").agg(
        F.count(F.lit(1)).alias("m"), *[F.max(F.when(F.col("i") == i, F.col("rk"))).alias(f"r{i}") for i in range(len(columns))])
    # one row a class: sums of products of the ranks' distances from the class's middle rank
    middle = F.get(F.array(*[F.lit((x["n"] + 1) / 2.0) for x in classes]), F.col("c"))
    weight = F.col("m") / F.get(F.array(*[F.lit(len(x["columns"])) for x in classes]), F.col("c"))
    row = row.select("c", weight.alias("w"), *[(F.col(f"r{i}") - middle).alias(f"r{i}") for i in range(len(columns))])
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    sums = row.groupBy("c").agg(*[F.sum(F.col("w") * F.col(f"r{i}") * F.col(f"r{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    done = F.array(*[F.when(F.col("c") == c, F.struct(
        F.lit(columns[i]).alias("col_a"), F.lit(columns[j]).alias("col_b"), F.lit(x["n"]).cast("bigint").alias("n"), F.col(f"s{i}_{j}").alias("sxy"),
        F.col(f"s{i}_{i}").alias("sxx"), F.col(f"s{j}_{j}").alias("syy"))) for c, x in enumerate(classes) for i, j in x["pairs"]])
    return sums.select(F.explode(done).alias("p")).where(F.col("p").isNotNull()).select("p.*")


def _pair_rows(spark, rows):
    return spark.createDataFrame(rows, PAIR_SCHEMA)


def strength_label(r: Column, strong: float = 0.7, moderate: float = 0.4) -> Column:
    a = F.abs(r)
    return F.when(a >= strong, "strong").when(a >= moderate, "moderate").otherwise("weak")


def spearman_pairs(df: DataFrame, columns: list[str] | None = None, *, min_r: float = 0.0,
                   min_n: int = 10, with_p: bool = True) -> DataFrame:
    """C-1 / C-6: pairwise-complete Spearman for every column pair (i < j)."""
    columns = columns or numeric_columns(df)
    if len(columns) < 2:
        return _decorate(_pair_rows(df.sparkSession, []), "spearman", with_p)
    r = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    out = spearman_moments(df, columns).select("col_a", "col_b", "n", r.alias("r"))
    out = out.where((F.col("n") >= min_n) & (F.abs(F.col("r")) >= min_r))
    return _decorate(out, "spearman", with_p)


def _decorate(out: DataFrame, method: str, with_p: bool) -> DataFrame:
    r = F.col("r")
    out = out.select("col_a", "col_b", F.lit(method).alias("method"), "n", "r", (r * r).alias("r2"),
                     strength_label(r).alias("strength"),
                     F.when(r > 0, "positive").otherwise("negative").alias("direction"))
    if with_p:
        t = r * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - r * r))
        p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_two_sided_col(t, F.col("n") - 2))
        out = out.withColumn("p_value", p).withColumn("is_significant", F.col("p_value") < 0.05)
    return out


def effect_label(r: Column) -> Column:
    """C-3 effect-size ladder .1 / .3 / .5."""
    a = F.abs(r)
    return (F.when(a >= 0.5, "large").when(a >= 0.3, "medium").when(a >= 0.1, "small")
             .otherwise("negligible"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """C-4: pairwise-complete Pearson of two columns (``corr`` skips nulls)."""
    out = df.agg(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).cast("bigint").alias("n"),
                 F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))
    r = F.col("r")
    return out.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), "n", "r",
                      F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.4, "moderate")
                       .otherwise("weak").alias("strength"),
                      F.when(r > 0, "positive").otherwise("negative").alias("direction"))


def pearson_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C-5: every pair's Pearson r in ONE aggregate (pairwise complete), long form."""
    columns = columns or numeric_columns(df)
    pairs = list(itertools.combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, n long, r double")
    agg = df.agg(*[F.struct(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
                            F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))
                   .alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    long = agg.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.col(f"p{i}.n").cast("bigint").alias("n"), F.col(f"p{i}.r").alias("r"))
        for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
    return long


def top_pearson_pairs(df: DataFrame, columns: list[str] | None = None, min_abs: float = 0.2) -> DataFrame:
    """C-5 report form: pairs with |r| > 0.2, strength tiers .6 / .4."""
    m = pearson_matrix(df, columns).where(F.abs(F.col("r")) > min_abs)
    return m.withColumn("strength", F.when(F.abs(F.col("r")) >= 0.6, "strong")
                        .when(F.abs(F.col("r")) >= 0.4, "moderate").otherwise("weak"))


def ols_trend(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """C-8: OLS slope and intercept (per colour group)."""
    g = [group] if group else []
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return d.groupBy(*g).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                             F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
                             F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"))


def vif(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """C-9: variance inflation factors after median imputation.

    The Pearson matrix comes from one Spark aggregate; only the k x k matrix
    (k = number of columns, schema-bounded) is inverted on the driver."""
    columns = columns or numeric_columns(df)
    spark = df.sparkSession
    med = {r["column"]: r["q0"] for r in
           exact_quantiles(to_long(df, columns), ["column"], "value", [0.5]).collect()}
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med.get(c))).alias(c) for c in columns])
    pm = {(r["col_a"], r["col_b"]): r["r"] for r in pearson_matrix(filled, columns).collect()}
    k = len(columns)
    R = np.eye(k)
    for i in range(k):
        for j in range(i + 1, k):
            v = pm.get((columns[i], columns[j]))
            R[i, j] = R[j, i] = 0.0 if v is None else v
    try:
        inv = np.linalg.inv(R)
        vals = [float(inv[i, i]) for i in range(k)]
    except np.linalg.LinAlgError:
        vals = [float("inf")] * k
    rows = []
    for c, v in zip(columns, vals):
        verdict = ("severe" if v >= 20 else "high" if v >= 10 else "moderate" if v >= 5 else "low")
        rows.append((c, v, verdict))
    return spark.createDataFrame(rows, "feature string, vif double, verdict string")


def chi_square(df: DataFrame, a: str, b: str, with_p: bool = True) -> DataFrame:
    """C-10: chi-square test of independence on the a x b contingency table,
    with Yates' continuity correction when dof = 1 (as SciPy).

    Zero cells need no materialised grid: summed over all cells,
    ``sum (O-E)^2/E = sum_observed [(O-E)^2/E - E] + n`` because the expected
    counts of all cells add up to ``n``.  The Yates case is a 2 x 2 table
    (at most four cells), finished from its collected counts."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    obs = d.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) \
        .agg(F.count(F.lit(1)).alias("o"))
    ra = obs.groupBy("a").agg(F.sum("o").alias("na"))
    rb = obs.groupBy("b").agg(F.sum("o").alias("nb"))
    # one row of totals
    tot = obs.agg(F.sum("o").alias("n"), F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb")).first()
    n, ka, kb = tot["n"] or 0, tot["ka"], tot["kb"]
    dof = (ka - 1) * (kb - 1)
    e = F.col("na") * F.col("nb") / F.lit(float(n))
    cells = obs.join(ra, "a").join(rb, "b").select("o", e.alias("e"))
    if dof == 1:
        # all four cells of a 2 x 2 table, seen or not, are off by the same amount; 1/E sums to n (sum 1/na) (sum 1/nb)
        inverse = [m.agg(F.sum(1.0 / F.col(c))).first()[0] for m, c in ((ra, "na"), (rb, "nb"))]
        off = F.abs(F.col("o") - F.col("e"))
        part = cells.agg(F.max(off - F.least(F.lit(0.5), off)).alias("g"))
        chi2 = F.col("g") * F.col("g") * F.lit(float(n) * inverse[0] * inverse[1])
    else:
        part = cells.agg(F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e") - F.col("e")).alias("s"))
        chi2 = F.col("s") + F.lit(float(n))
    out = part.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.lit(n).cast("bigint").alias("n"),
                      F.lit(dof).cast("bigint").alias("dof"), chi2.alias("chi2"))
    if with_p:
        out = out.withColumn("p_value", chi2_sf_col(F.col("chi2"), F.col("dof")))
    return out
