"""Group-comparison hypothesis tests (H-9..H-15, E-2).

Statistics come from per-group partial aggregates (n, mean, variance,
rank sums) — tables with one row per group — and are finished in SQL
expressions; only the tail probability uses the special-function UDF.
Rank sums use the distinct ``(group, value, count)`` table joined to the
distributed average ranks of the pooled values, so raw rows are never
re-sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import dim_join
from ..functions.special import chi2_sf_col, f_sf, f_sf_col, norm_sf, t_two_sided
from .quantiles import exact_quantiles


def _prep(df: DataFrame, value: str, group: str, min_n: int = 1) -> DataFrame:
    d = (df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
           .select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v")))
    if min_n > 1:
        keep = d.groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_n).select("g")
        d = dim_join(d, keep, "g")
    return d


def group_moments(d: DataFrame) -> DataFrame:
    """Per group: n, mean, sample variance, population std, sum."""
    return d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"),
                              F.var_samp("v").alias("var"), F.stddev_pop("v").alias("std_pop"),
                              F.sum("v").alias("s"))


def anova_table(d: DataFrame) -> DataFrame:
    """H-10 / H-14: one-way ANOVA F and eta² from group moments."""
    m = group_moments(d)
    tot = d.agg(F.count(F.lit(1)).alias("N"), F.avg("v").alias("M"), F.var_pop("v").alias("vp")).first()
    N, M, vp = tot["N"], tot["M"], tot["vp"]
    a = m.agg(F.count(F.lit(1)).alias("k"),
              F.sum(F.col("n") * F.pow(F.col("mean") - F.lit(M), 2)).alias("ssb"),
              F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))).alias("ssw"))
    k = F.col("k")
    f = (F.col("ssb") / (k - 1)) / (F.col("ssw") / (F.lit(N) - k))
    sst = (vp or 0.0) * (N or 0)
    return a.select(k.cast("bigint").alias("k"), F.lit(N).cast("bigint").alias("n_total"), "ssb", "ssw",
                    f.alias("f_stat"),
                    (F.col("ssb") / F.lit(sst) if sst > 0 else F.lit(0.0)).alias("eta_sq"))


def kruskal_table(d: DataFrame) -> DataFrame:
    """H-9: Kruskal-Wallis H with tie correction over the pooled values."""
    cnt = d.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    vals = cnt.groupBy("v").agg(F.sum("c").alias("t"))
    ranks = _ranks_from_counts(vals)
    rs = cnt.join(ranks.select("v", "avg_rank"), "v").groupBy("g").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("avg_rank")).alias("R"))
    ties = vals.agg(F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("T"), F.sum("t").alias("N")).first()
    Nv = float(ties["N"] or 0)
    a = rs.agg(F.count(F.lit(1)).alias("k"), F.sum(F.pow(F.col("R"), 2) / F.col("n")).alias("q"))
    h = 12.0 / (Nv * (Nv + 1)) * F.col("q") - 3 * (Nv + 1) if Nv else F.lit(None)
    corr = 1.0 - (ties["T"] or 0.0) / (Nv ** 3 - Nv) if Nv > 1 else 0.0
    return a.select(F.col("k").cast("bigint").alias("k"), F.lit(int(Nv)).cast("bigint").alias("n_total"),
                    (h / F.lit(corr) if corr > 0 else F.lit(None).cast("double")).alias("h_stat"))


def _ranks_from_counts(vals: DataFrame) -> DataFrame:
    """Average ranks for a distinct-value table ``(v, t)`` (t = multiplicity)."""
    from .ranks import ordered_running
    r = ordered_running(vals, "v", weight_col="t")
    return r.select("v", "t", (F.col("_pos") - F.col("t") + (F.col("t") + 1) / 2.0).alias("avg_rank"))


def group_comparison(df: DataFrame, value: str, group: str, is_normal: bool = False,
                     min_n: int = 3, with_p: bool = True) -> DataFrame:
    """E-2: ANOVA (normal) or Kruskal-Wallis, eta², labels, per-group stats."""
    d = _prep(df, value, group, min_n)
    an = anova_table(d)
    kw = kruskal_table(d).select(F.col("h_stat"))
    med = exact_quantiles(d, ["g"], "v", [0.5]).select("g", F.col("q0").alias("median"))
    gs = group_moments(d).join(med, "g").agg(F.sort_array(F.collect_list(F.struct(
        F.col("g").alias("group"), F.col("n").cast("bigint").alias("n"), "mean", "median",
        F.col("std_pop").alias("std")))).alias("group_stats")).first()["group_stats"]
    h = kw.first()["h_stat"]
    gs_type = "array<struct<group:string,n:bigint,mean:double,median:double,std:double>>"
    j = an.select("*", F.lit(h).cast("double").alias("h_stat"),
                  F.from_json(F.lit(_to_json(gs)), gs_type).alias("group_stats"))
    stat = F.col("f_stat") if is_normal else F.col("h_stat")
    out = j.select(F.lit(value).alias("numeric_col"), F.lit(group).alias("group_col"),
                   F.col("k").alias("n_groups"),
                   F.lit("One-Way ANOVA" if is_normal else "Kruskal-Wallis").alias("test_used"),
                   stat.alias("statistic"), "f_stat", "h_stat", "eta_sq",
                   F.when(F.col("eta_sq") < 0.01, "Negligible").when(F.col("eta_sq") < 0.06, "Small")
                    .when(F.col("eta_sq") < 0.14, "Medium").otherwise("Large").alias("effect_label"),
                   "group_stats", "n_total")
    if with_p:
        p = (f_sf_col(F.col("f_stat"), F.col("n_groups") - 1, F.col("n_total") - F.col("n_groups"))
             if is_normal else chi2_sf_col(F.col("h_stat"), F.col("n_groups") - 1))
        out = out.withColumn("p_value", p).withColumn("is_significant", F.col("p_value") < 0.05)
    return out.where(F.col("n_groups") >= 2)


def _to_json(rows) -> str:
    import json
    return json.dumps([r.asDict() for r in (rows or [])])


def levene(df: DataFrame, value: str, group: str, min_n: int = 3) -> DataFrame:
    """H-13: Levene (Brown-Forsythe, centre = median): ANOVA on |x - median_g|."""
    d = _prep(df, value, group, min_n)
    med = exact_quantiles(d, ["g"], "v", [0.5]).select("g", F.col("q0").alias("med"))
    z = dim_join(d, med, "g").select("g", F.abs(F.col("v") - F.col("med")).alias("v"))
    return anova_table(z).select("k", "n_total", F.col("f_stat").alias("w_stat"))


def two_group_tests(df: DataFrame, value: str, group: str, a: str, b: str,
                    with_p: bool = True) -> DataFrame:
    """H-11 pooled t-test, H-12 Mann-Whitney U (asymptotic, tie + continuity
    correction, two-sided), H-15 Cohen's d (population std) for groups a, b."""
    d = _prep(df, value, group).where(F.col("g").isin(a, b))
    m = {r["g"]: r for r in group_moments(d).collect()}
    if a not in m or b not in m:
        return df.sparkSession.createDataFrame([], "group_a string, group_b string")
    cnt = d.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    vals = cnt.groupBy("v").agg(F.sum("c").alias("t"))
    ranks = _ranks_from_counts(vals)
    r1 = cnt.where(F.col("g") == a).join(ranks.select("v", "avg_rank"), "v") \
        .agg(F.sum(F.col("c") * F.col("avg_rank"))).first()[0]
    T = vals.agg(F.sum(F.pow(F.col("t"), 3) - F.col("t"))).first()[0] or 0.0
    ma, mb = m[a], m[b]
    n1, n2 = ma["n"], mb["n"]
    n = n1 + n2
    u1 = r1 - n1 * (n1 + 1) / 2.0
    u2 = n1 * n2 - u1
    mu = n1 * n2 / 2.0
    sd = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - T / (n * (n - 1)))) if n > 1 else float("nan")
    big = max(u1, u2)
    z = (big - mu - 0.5) / sd if sd and sd > 0 else float("nan")
    dfree = n1 + n2 - 2
    sp2 = (((n1 - 1) * (ma["var"] or 0.0) + (n2 - 1) * (mb["var"] or 0.0)) / dfree) if dfree > 0 else float("nan")
    t = (ma["mean"] - mb["mean"]) / math.sqrt(sp2 * (1.0 / n1 + 1.0 / n2)) if sp2 and sp2 > 0 else float("nan")
    pooled = math.sqrt(((ma["std_pop"] or 0.0) ** 2 + (mb["std_pop"] or 0.0) ** 2) / 2.0)
    dval = (ma["mean"] - mb["mean"]) / pooled if pooled > 0 else 0.0
    ad = abs(dval)
    dlabel = "negligible" if ad < 0.2 else "small" if ad < 0.5 else "medium" if ad < 0.8 else "large"
    row = dict(group_a=a, group_b=b, n_a=int(n1), n_b=int(n2), mean_a=float(ma["mean"]),
               mean_b=float(mb["mean"]), t_stat=float(t), t_df=int(dfree), u_stat=float(u1),
               mwu_z=float(z), cohens_d=float(dval), d_label=dlabel)
    if with_p:
        from ..functions.special import mwu_p
        row["t_p"] = t_two_sided(t, dfree) if not math.isnan(t) else None
        row["mwu_p"] = mwu_p(u1, int(n1), int(n2), float(T))
    return df.sparkSession.createDataFrame([row])


def mwu_long(long: DataFrame, key: str = "column", flag: str = "flag", value: str = "value",
             with_p: bool = True) -> DataFrame:
    """H-12 for many columns at once: ``long`` has ``(key, flag boolean, value)``;
    per key, Mann-Whitney U of the ``flag = true`` sample vs the rest
    (asymptotic, tie and continuity corrected).  Ranks are per key over the
    distinct values; ``U`` is reported for the flagged sample."""
    d = long.where(F.col(value).isNotNull() & F.col(flag).isNotNull())
    cnt = d.groupBy(key, flag, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    vals = cnt.groupBy(key, "v").agg(F.sum("c").alias("t"))
    from .ranks import ordered_running
    r = ordered_running(vals, "v", part_cols=[key], weight_col="t", few_keys=True)
    ranks = r.select(key, "v", "t", (F.col("_pos") - F.col("t") + (F.col("t") + 1) / 2.0).alias("rk"))
    rs = cnt.join(ranks.select(key, "v", "rk"), [key, "v"]).groupBy(key).agg(
        F.sum(F.when(F.col(flag), F.col("c"))).alias("n1"), F.sum(F.when(~F.col(flag), F.col("c"))).alias("n2"),
        F.sum(F.when(F.col(flag), F.col("c") * F.col("rk"))).alias("r1"))
    ties = vals.groupBy(key).agg(F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("T"))
    j = rs.join(ties, key)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    big = F.greatest(u1, n1 * n2 - u1)
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("T"), n * (n - 1))))
    z = F.try_divide(big - n1 * n2 / 2.0 - 0.5, sd)
    out = j.select(key, F.col("n1").cast("bigint").alias("n_flag"), F.col("n2").cast("bigint").alias("n_rest"),
                   u1.alias("u_stat"), z.alias("z"), F.col("T").alias("_tie_sum"))
    if with_p:
        from ..functions.special import mwu_p_col
        out = out.withColumn("p_value", mwu_p_col(F.col("u_stat"), F.col("n_flag"), F.col("n_rest"), F.col("_tie_sum")))
    out = out.drop("_tie_sum")
    return out


def chi2_flag_long(long: DataFrame, key: str = "column", flag: str = "flag", cat: str = "value",
                   with_p: bool = True) -> DataFrame:
    """C-10 for many categorical columns against one boolean flag: per key,
    chi-square of the (category x flag) table, Yates-corrected when dof = 1.
    The zero cells of the full grid are generated per category (two flag
    values), so no cross join is needed."""
    d = long.where(F.col(cat).isNotNull() & F.col(flag).isNotNull())
    obs = d.groupBy(key, F.col(cat).cast("string").alias("a"), F.col(flag).alias("b")).agg(
        F.count(F.lit(1)).alias("o"))
    cats = obs.groupBy(key, "a").agg(F.sum("o").alias("na"))
    flags = obs.groupBy(key, "b").agg(F.sum("o").alias("nb"))
    tot = obs.groupBy(key).agg(F.sum("o").alias("n"), F.countDistinct("a").alias("ka"),
                               F.countDistinct("b").alias("kb"))
    grid = cats.select(key, "a", "na", F.explode(F.array(F.lit(True), F.lit(False))).alias("b"))
    cells = (grid.join(flags, [key, "b"]).join(obs, [key, "a", "b"], "left").join(tot, key)
                 .withColumn("o", F.coalesce(F.col("o"), F.lit(0))))
    e = F.col("na") * F.col("nb") / F.col("n").cast("double")
    dof = (F.col("ka") - 1) * (F.col("kb") - 1)
    diff = e - F.col("o")
    adj = F.when(dof == 1, F.least(F.lit(0.5), F.abs(diff)) * F.signum(diff)).otherwise(0.0)
    out = cells.groupBy(key, "n", "ka", "kb").agg(F.sum(F.pow(F.col("o") + adj - e, 2) / e).alias("chi2"))
    out = out.select(key, F.col("n").cast("bigint").alias("n"), dof.cast("bigint").alias("dof"), "chi2")
    if with_p:
        out = out.withColumn("p_value", chi2_sf_col(F.col("chi2"), F.col("dof")))
    return out


def group_comparisons_long(df: DataFrame, numeric: list[str], categorical: list[str], min_n: int = 3,
                           normal: dict | None = None, with_p: bool = True) -> DataFrame:
    """E-2 for every (numeric, categorical) pair at once.

    The table is exploded once into ``(numeric_col, group_col, g, v)``; group
    moments, pooled average ranks (keyed by pair), tie terms and group
    medians are keyed aggregates over that long table, so the number of
    passes does not grow with the number of pairs.  ``normal`` maps a numeric
    column to True to report ANOVA instead of Kruskal-Wallis."""
    from .ranks import ordered_running
    pairs = [(n, c) for c in categorical for n in numeric]
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "numeric_col string, group_col string")
    pk = ["numeric_col", "group_col"]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("numeric_col"), F.lit(c).alias("group_col"), F.col(c).cast("string").alias("g"),
                 F.col(n).cast("double").alias("v")) for n, c in pairs])).alias("x")).select("x.*") \
        .where(F.col("g").isNotNull() & F.col("v").isNotNull())
    sizes = long.groupBy(*pk, "g").agg(F.count(F.lit(1)).alias("_n"))
    # one row per (pair, group): broadcast when its checked size allows, so a
    # group holding a large share of the rows does not become a hot join key
    f = dim_join(long, sizes.where(F.col("_n") >= min_n).drop("_n"), pk + ["g"])
    gm = f.groupBy(*pk, "g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"),
                                 F.var_samp("v").alias("var"), F.stddev_pop("v").alias("std_pop"))
    tot = f.groupBy(*pk).agg(F.count(F.lit(1)).alias("ntot"), F.avg("v").alias("gmean"), F.var_pop("v").alias("vp"))
    an = gm.join(tot, pk).groupBy(*pk).agg(
        F.count(F.lit(1)).alias("k"), F.first("ntot").alias("ntot"), F.first("vp").alias("vp"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("gmean"), 2)).alias("ssb"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))).alias("ssw"))
    k, N = F.col("k"), F.col("ntot").cast("double")
    an = an.select(*pk, "k", "ntot", F.try_divide(F.col("ssb") / (k - 1), F.col("ssw") / (N - k)).alias("f_stat"),
                   F.when(F.col("vp") * N > 0, F.col("ssb") / (F.col("vp") * N)).otherwise(0.0).alias("eta_sq"))
    cnt = f.groupBy(*pk, "g", "v").agg(F.count(F.lit(1)).alias("c"))
    vals = cnt.groupBy(*pk, "v").agg(F.sum("c").alias("t"))
    r = ordered_running(vals, "v", part_cols=pk, weight_col="t", few_keys=True)
    ranks = r.select(*pk, "v", (F.col("_pos") - F.col("t") + (F.col("t") + 1) / 2.0).alias("rk"))
    rs = cnt.join(ranks, pk + ["v"]).groupBy(*pk, "g").agg(F.sum("c").alias("n"),
                                                           F.sum(F.col("c") * F.col("rk")).alias("R"))
    q = rs.groupBy(*pk).agg(F.sum(F.pow(F.col("R"), 2) / F.col("n")).alias("q"))
    ties = vals.groupBy(*pk).agg(F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("tie_sum"))
    kw = q.join(ties, pk).join(tot.select(*pk, F.col("ntot").alias("nk")), pk)
    Nn = F.col("nk").cast("double")
    h = 12.0 / (Nn * (Nn + 1)) * F.col("q") - 3 * (Nn + 1)
    corr_ = F.lit(1.0) - F.try_divide(F.col("tie_sum"), Nn * Nn * Nn - Nn)
    kw = kw.select(*pk, F.when(corr_ > 0, h / corr_).alias("h_stat"))
    med = exact_quantiles(f, pk + ["g"], "v", [0.5]).select(*pk, "g", F.col("q0").alias("median"))
    gs = gm.join(med, pk + ["g"]).groupBy(*pk).agg(F.sort_array(F.collect_list(F.struct(
        F.col("g").alias("group"), F.col("n").cast("bigint").alias("n"), "mean", "median",
        F.col("std_pop").alias("std")))).alias("group_stats"))
    normal = normal or {}
    is_norm = F.lit(False)
    for col_name, flag in normal.items():
        if flag:
            is_norm = F.when(F.col("numeric_col") == col_name, F.lit(True)).otherwise(is_norm)
    j = an.join(kw, pk).join(gs, pk).where(F.col("k") >= 2)
    out = j.select(*pk, F.col("k").cast("bigint").alias("n_groups"),
                   F.when(is_norm, "One-Way ANOVA").otherwise("Kruskal-Wallis").alias("test_used"),
                   F.when(is_norm, F.col("f_stat")).otherwise(F.col("h_stat")).alias("statistic"),
                   "f_stat", "h_stat", "eta_sq",
                   F.when(F.col("eta_sq") < 0.01, "Negligible").when(F.col("eta_sq") < 0.06, "Small")
                    .when(F.col("eta_sq") < 0.14, "Medium").otherwise("Large").alias("effect_label"),
                   "group_stats", F.col("ntot").cast("bigint").alias("n_total"), is_norm.alias("_norm"))
    if with_p:
        p = F.when(F.col("_norm"), f_sf_col(F.col("f_stat"), F.col("n_groups") - 1, F.col("n_total") - F.col("n_groups"))) \
            .otherwise(chi2_sf_col(F.col("h_stat"), F.col("n_groups") - 1))
        out = out.withColumn("p_value", p).withColumn("is_significant", F.col("p_value") < 0.05)
    return out.drop("_norm")
