"""Chart facts and sentences of every chart kind, filled by one dispatch (D-11..D-13).

A chart is a spec ``{chart_id, chart_type, title, x, y}``.  ``chart_facts`` sorts specs by kind and hands
each kind's whole list to one filler, so ten bar charts are one grouping, ten histograms one statistics
pass and ten trends one monthly table.  All kinds end in one long table ``rules.FACTS`` with the kind as
scope and the chart as subject; sentences are rules over it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import nullify_nonfinite
from .corr import spearman_pairs
from .rules import FACTS, HIGH, Rule, above, below, facts, fired
from .stats import col_stats, numeric_columns, skew_G1

KIND_OF_TYPE = {"bar": "bar", "bar_ascending": "bar", "pie": "pie", "histogram": "histogram", "line": "trend", "heatmap": "correlation"}
#: A pair below this |r| is no relationship worth a sentence.
MIN_R = 0.15


def _label(name: str) -> str:
    return name.replace("_", " ").strip().title()


def _labels(specs: Sequence[dict], which: str) -> Column:
    """The readable name of a chart's ``x`` or ``y``, by chart."""
    return reduce(lambda out, s: F.when(F.col("chart") == s["chart_id"], _label(s[which])).otherwise(out), specs, F.lit(None).cast("string"))


# ---------------------------------------------------------------- fillers, one a kind
def _group_means(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """``(chart, dim, total, n)`` of every chart's groups; rows without a group keep a null ``dim`` for the mean of all rows."""
    cells = [F.struct(F.lit(s["chart_id"]).alias("chart"), F.col(s["x"]).cast("string").alias("dim"), F.col(s["y"]).cast("double").alias("v")) for s in specs]
    long = df.select(F.explode(F.array(*cells)).alias("r")).select("r.*").where("v is not null")
    return long.groupBy("chart", "dim").agg(F.sum("v").alias("total"), F.count("v").alias("n"))


def bar_table(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Facts of bar charts: a group's value is its mean; ties go to the larger name at the top, to the smaller at the bottom."""
    groups = _group_means(df, specs)
    overall = groups.groupBy("chart").agg((F.sum("total") / F.sum("n")).alias("avg_value"))
    named = groups.where("dim is not null").select("chart", "dim", (F.col("total") / F.col("n")).alias("v")).join(overall, "chart")
    a = named.groupBy("chart", "avg_value").agg(F.max(F.struct("v", "dim")).alias("hi"), F.min(F.struct("v", "dim")).alias("lo"),
                                                F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") > F.col("avg_value")).alias("up"))
    gap = F.abs(F.col("hi.v") - F.col("lo.v")) * 100.0 / F.greatest(F.abs("lo.v"), F.lit(0.001))
    return facts(a, "bar", F.col("chart"), metric=_labels(specs, "y"), dimension=_labels(specs, "x"), top=F.col("hi.dim"), top_value=F.col("hi.v"),
                 worst=F.col("lo.dim"), worst_value=F.col("lo.v"), avg_value=F.col("avg_value"), n_groups=F.col("n"), n_above_avg=F.col("up"), gap_pct=gap)


def pie_table(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Facts of pie charts: shares of the sum of the group means; ties go to the smaller name; balanced below 40 %.
    Shares of means that sum to nothing are null."""
    named = _group_means(df, specs).where("dim is not null").select("chart", F.struct((-F.col("total") / F.col("n")).alias("minus"), "dim").alias("g"))
    first = named.groupBy("chart").agg(F.min("g").alias("g1"), (-F.sum("g.minus")).alias("whole"), F.count(F.lit(1)).alias("n"))
    second = named.join(first.select("chart", "g1"), "chart").where(F.col("g") != F.col("g1")).groupBy("chart").agg(F.min("g").alias("g2"))
    a = first.join(second, "chart", "left")
    share = F.try_divide(F.col("g1.minus") * -100.0, F.col("whole"))
    both = F.try_divide((F.col("g1.minus") + F.coalesce("g2.minus", F.lit(0.0))) * -100.0, F.col("whole"))
    return facts(a, "pie", F.col("chart"), metric=_labels(specs, "y"), dimension=_labels(specs, "x"), top=F.col("g1.dim"), top_share=share, top2_share=both,
                 n_segments=F.col("n"), balanced=(share < 40).cast("int"))


def histogram_table(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Facts of histograms: exact quantiles, moments with the adjusted skewness, and which centre to report."""
    charts = df.sparkSession.createDataFrame([(s["chart_id"], s["x"]) for s in specs], "chart string, column string")
    st = col_stats(df, sorted({s["x"] for s in specs}), min_n=1).withColumn("g", skew_G1(F.col("skew"), F.col("n")))
    st = st.join(F.broadcast(charts), "column")
    skewed, g = F.abs("g") > 0.5, F.col("g")
    return facts(st, "histogram", F.col("chart"), metric=_labels(specs, "x"), mean=F.col("mean"), median=F.col("median"), std=F.col("std"),
                 min=F.col("min"), max=F.col("max"), q1=F.col("q1"), q3=F.col("q3"), skew=g, abs_skew=F.coalesce(F.abs(g), F.lit(0.0)),
                 shape=F.when(g > 0.5, "right-skewed").when(g < -0.5, "left-skewed").otherwise("symmetric"),
                 use_stat=F.when(skewed, "median").otherwise("mean"), use_value=F.when(skewed, F.col("median")).otherwise(F.col("mean")))


def trend_table(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Facts of trends: the series of period means (a month for dates), its halves (the middle period of an odd number
    counts with the second), their change and the coefficient of variation."""
    kinds = dict(df.dtypes)
    period = lambda c: (F.last_day(c) if kinds[c].startswith(("date", "timestamp")) else F.col(c)).cast("string")
    cells = [F.struct(F.lit(s["chart_id"]).alias("chart"), period(s["x"]).alias("p"), F.col(s["y"]).cast("double").alias("v")) for s in specs]
    long = df.select(F.explode(F.array(*cells)).alias("r")).select("r.*").where("v is not null and p is not null")
    series = long.groupBy("chart", "p").agg(F.avg("v").alias("v"))
    place, size = F.row_number().over(Window.partitionBy("chart").orderBy("p")), F.count(F.lit(1)).over(Window.partitionBy("chart"))  # one row a period
    halves = series.select("chart", "v", (place > F.floor(size / 2)).alias("late"))
    a = halves.groupBy("chart").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_samp("v").alias("sd"),
                                    F.avg(F.when(~F.col("late"), F.col("v"))).alias("f"), F.avg(F.when(F.col("late"), F.col("v"))).alias("l"), F.count("v").alias("n"))
    change = (F.col("l") - F.col("f")) * 100.0 / F.greatest(F.abs("f"), F.lit(0.001))
    cv = F.when(F.col("mean") != 0, F.col("sd") * 100.0 / F.abs("mean")).otherwise(0.0)
    return facts(a, "trend", F.col("chart"), metric=_labels(specs, "y"), mean=F.col("mean"), min=F.col("min"), max=F.col("max"), cv=F.coalesce(cv, F.lit(0.0)),
                 first_half=F.col("f"), second_half=F.col("l"), n_periods=F.col("n"), change_pct=change, abs_change=F.abs(change))


def correlation_table(df: DataFrame, specs: Sequence[dict], metrics: Sequence[str]) -> DataFrame:
    """Facts of a correlation matrix: how many pairs reach |r| 0.15 (Spearman), the strongest and the second one."""
    pairs = spearman_pairs(df, list(metrics), with_p=False).where(F.abs("r") >= MIN_R)
    order = F.struct((-F.abs("r")).alias("minus"), "col_a", "col_b", "r")
    # at most (metrics squared) / 2 rows
    a = pairs.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(order)).alias("p"))
    one, two = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    a = a.withColumn("chart", F.explode(F.array(*[F.lit(s["chart_id"]) for s in specs])))
    readable = lambda c: F.initcap(F.trim(F.translate(c, "_", " ")))
    return facts(a, "correlation", F.col("chart"), n_pairs=F.col("n"), a=readable(one["col_a"]), b=readable(one["col_b"]), r=one["r"], r2=one["r"] * one["r"],
                 r2_pct=one["r"] * one["r"] * 100.0, second_a=readable(two["col_a"]), second_b=readable(two["col_b"]), second_r=two["r"])


FILLERS: dict[str, Callable] = {"bar": bar_table, "pie": pie_table, "histogram": histogram_table, "trend": trend_table}


def chart_facts(df: DataFrame, specs: Sequence[dict], metrics: Sequence[str] | None = None) -> DataFrame:
    """D-11: the facts of all charts of ``specs`` as one long table (scope = kind, column = chart).

    ``metrics``: the columns of correlation matrices (default: all numeric ones).  NaN and infinite values
    count as missing.  A chart without a single value has no facts.
    """
    df = nullify_nonfinite(df)
    by_kind: dict[str, list[dict]] = {}
    for s in specs:
        by_kind.setdefault(KIND_OF_TYPE[s["chart_type"]], []).append(s)
    out = df.sparkSession.createDataFrame([], FACTS)
    for kind, some in by_kind.items():
        out = out.unionByName(correlation_table(df, some, metrics or numeric_columns(df)) if kind == "correlation" else FILLERS[kind](df, some))
    return out


# ---------------------------------------------------------------- sentences
#: ``hr``, ``ecommerce``, ``money`` and ``general`` name the report's domain; ``narratives`` adds one of them.
CHART_RULES = [
    Rule("bar_ends", "bar", (("n_groups", 1, HIGH),),
         "{metric.label} over {n_groups:0} {dimension.label} groups: '{top.label}' is highest ({top_value}), '{worst.label}' lowest ({worst_value}), {gap_pct:1}% apart."),
    Rule("bar_average", "bar", (("n_groups", 1, HIGH),), "{n_above_avg:0} of {n_groups:0} groups lie above the mean of all rows ({avg_value})."),
    Rule("bar_action", "bar", (("gap_pct", above(0), HIGH),), "Next: find what holds '{worst.label}' back and what '{top.label}' does differently.", "action"),
    Rule("pie_shares", "pie", (("n_segments", 1, HIGH),),
         "{metric.label} over {n_segments:0} {dimension.label} segments: '{top.label}' holds {top_share:1}%, the two largest {top2_share:1}%."),
    Rule("pie_concentrated", "pie", (("balanced", 0, 0),), "One segment dominates. Next: spread activity to lower that dependence.", "risk", "warning"),
    Rule("pie_balanced", "pie", (("balanced", 1, 1),), "No segment dominates. Next: watch each quarter whether that stays so."),
    Rule("histogram_centre", "histogram", (("abs_skew", 0, HIGH),), "{metric.label} is typically {use_value} (from {min} to {max})."),
    Rule("histogram_skewed", "histogram", (("abs_skew", above(0.5), HIGH),), "Its distribution is {shape.label} (skewness {skew}): report the {use_stat.label}."),
    Rule("histogram_symmetric", "histogram", (("abs_skew", 0, 0.5),), "Its distribution is about symmetric: the mean is a fair centre."),
    Rule("histogram_low_hr", "histogram", (("abs_skew", 0, HIGH), ("hr", 1, 1)), "The lowest quarter of employees (below {q1}) comes first for retention talks.", "action"),
    Rule("histogram_low_ecommerce", "histogram", (("abs_skew", 0, HIGH), ("ecommerce", 1, 1)),
         "The lowest quarter of orders or products (below {q1}) needs a look at price, quality and demand.", "action"),
    Rule("histogram_low_money", "histogram", (("abs_skew", 0, HIGH), ("money", 1, 1)), "The lowest quarter (below {q1}) underperforms: look for causes there first.", "action"),
    Rule("histogram_low_general", "histogram", (("abs_skew", 0, HIGH), ("general", 1, 1)), "The lowest quarter (below {q1}) needs attention first.", "action"),
    Rule("trend_range", "trend", (("n_periods", 1, HIGH),), "{metric.label} averages {mean} (from {min} to {max})."),
    Rule("trend_improved", "trend", (("change_pct", above(2), HIGH),), "It improved by {abs_change:1}% from the first to the second half: worth sustaining."),
    Rule("trend_declined", "trend", (("change_pct", -HIGH, below(-2)),), "It declined by {abs_change:1}% from the first to the second half.", "risk", "warning"),
    Rule("trend_stable", "trend", (("change_pct", -2, 2),), "It is stable between the halves ({change_pct:1}%)."),
    Rule("trend_erratic", "trend", (("cv", above(30), HIGH),), "Periods vary widely ({cv:1}%).", "risk", "warning"),
    Rule("trend_moderate", "trend", (("cv", above(15), 30),), "Periods vary moderately ({cv:1}%)."),
    Rule("trend_steady", "trend", (("cv", 0, 15),), "Periods vary little ({cv:1}%)."),
    Rule("trend_mend", "trend", (("change_pct", -HIGH, below(-2)),), "Next: find the causes before the next review.", "action"),
    Rule("trend_keep", "trend", (("change_pct", -2, HIGH),), "Next: go on, and check monthly.", "action"),
    Rule("correlation_none", "correlation", (("n_pairs", 0, 0),), "No two metrics move together (all |r| below 0.15): plan for each on its own."),
    Rule("correlation_count", "correlation", (("n_pairs", 1, HIGH),), "{n_pairs:0} pair(s) of metrics move together."),
    Rule("correlation_same", "correlation", (("r", above(0), HIGH),), "Strongest: {a.label} and {b.label} (r {r}), high with high."),
    Rule("correlation_opposite", "correlation", (("r", -HIGH, below(0)),), "Strongest: {a.label} and {b.label} (r {r}), high with low."),
    Rule("correlation_caution", "correlation", (("n_pairs", 1, HIGH),), "They share {r2_pct:0}% of their variance, which shows no cause: test before acting.", "action"),
    Rule("correlation_second", "correlation", (("n_pairs", 2, HIGH),), "Second: {second_a.label} and {second_b.label} (r {second_r})."),
]
DOMAIN_FACT = {"hr": "hr", "ecommerce": "ecommerce", "sales": "money", "finance": "money"}


def narratives(df: DataFrame, specs: Sequence[dict], domain: str = "general", metrics: Sequence[str] | None = None) -> DataFrame:
    """D-12: ``(chart_id, kind, narrative)``, the sentences of every chart that has a value, in rule order."""
    said = fired(chart_facts(df, specs, metrics), CHART_RULES, {DOMAIN_FACT.get(domain, "general"): 1.0})
    # a dozen sentences a chart at most
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]))
    return said.groupBy(F.col("column").alias("chart_id"), F.col("scope").alias("kind")).agg(text.alias("narrative"))


# ---------------------------------------------------------------- titles
# ---- fixed values that must equal the reference's: words of a title, first match decides ----
TITLE_KINDS = (("correlation", "correlation"), ("heatmap", "correlation"), ("distribution", "histogram"), ("histogram", "histogram"),
               ("pie", "pie"), ("share", "pie"), ("trend", "trend"), ("line", "trend"), (" by ", "bar"))
# ---------------------------------------------------------------------------
#: Our own time charts are titled so.
OWN_TITLE_KINDS = (("over time", "trend"),)
TYPE_OF_KIND = {"bar": "bar", "pie": "pie", "histogram": "histogram", "trend": "line", "correlation": "heatmap"}


def kind_of_title(title: str) -> str | None:
    """The chart kind a title names; None if it names none."""
    return next((kind for word, kind in (*TITLE_KINDS, *OWN_TITLE_KINDS) if word in title.lower()), None)


def spec_of_title(title: str, numeric: Sequence[str], categorical: Sequence[str], period: str | None = None) -> dict | None:
    """D-13: the spec behind a chart title.  Columns are those whose names stand in the title (signs and case
    aside), else the first of their type; after " by " stands the dimension.  A title of no kind is a bar
    chart, or a histogram without categories.  None if a column that the kind needs is missing."""
    squeeze = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    pick = lambda names, text: next((c for c in names if squeeze(c) in squeeze(text)), names[0] if names else None)
    kind = kind_of_title(title) or ("bar" if categorical else "histogram")
    head, _, tail = title.lower().partition(" by ")
    x, y = {"bar": (pick(categorical, tail), pick(numeric, head)), "pie": (pick(categorical, tail), pick(numeric, head)),
            "histogram": (pick(numeric, title), None), "trend": (period, pick(numeric, title)), "correlation": (None, None)}[kind]
    needs = {"bar": (x, y), "pie": (x, y), "histogram": (x,), "trend": (x, y), "correlation": (numeric[1:] or None,)}[kind]
    return None if None in needs else {"chart_id": title, "chart_type": TYPE_OF_KIND[kind], "title": title, "x": x, "y": y}


def title_narratives(df: DataFrame, titles: Sequence[str], domain: str = "general", period: str | None = None) -> DataFrame:
    """D-13: the narratives of charts known by their titles, dispatched in one go."""
    numeric, categorical = numeric_columns(df), [c for c, t in df.dtypes if t == "string" and c != period]
    specs = [s for t in dict.fromkeys(titles) if (s := spec_of_title(t, numeric, categorical, period))]
    return narratives(df, specs, domain, numeric)
