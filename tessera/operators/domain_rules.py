"""Insight, risk, finding, opportunity and action rules of the four domains as data (N-11, N-20.., N-40.., N-60.., D-17).

``*_facts`` measure what the roles at hand allow, as rows of ``rules.FACTS`` with the domain as scope and
subject; a role that is missing gives no facts, so no rule that needs it fires.  ``DOMAIN_RULES`` and
``CONTEXT_RULES`` hold thresholds and sentences.  Row-level work is one aggregate for all plain columns,
one grouping for all group columns, and a quantile or rank pass where a rule asks for one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import truthy
from .corr import spearman_pairs
from .domains import ecommerce, finance, hr, sales
from .quantiles import exact_quantiles
from .rules import FACTS, HIGH, Rule, above, below, facts, fired
from .stats import col_stats


def _of(df: DataFrame, domain: str, **values: Column) -> DataFrame:
    return facts(df, domain, F.lit(domain), **values)


def _join(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts, df.sparkSession.createDataFrame([], FACTS))


def _constants(df: DataFrame, domain: str, values: dict[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(domain, domain, k, float(v), None) for k, v in values.items()], FACTS)


def group_extremes(df: DataFrame, cells: dict[str, tuple[str, Column]], min_n: int = 1) -> DataFrame:
    """``(cell, groups, hi, lo)``: of each cell (name -> group column, value) the groups with the largest and the
    smallest mean as ``struct(v, g, t, n)`` (mean, name, sum, rows), over groups with ``min_n`` values; ties go to the
    larger name at the top and to the smaller at the bottom.  All cells share one grouping."""
    rows = [F.struct(F.lit(k).alias("cell"), F.col(g).cast("string").alias("g"), v.cast("double").alias("v")) for k, (g, v) in cells.items()]
    long = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("g is not null and v is not null")
    means = long.groupBy("cell", "g").agg(F.avg("v").alias("v"), F.sum("v").alias("t"), F.count("v").alias("n")).where(F.col("n") >= min_n)
    one = F.struct("v", "g", "t", "n")
    return means.groupBy("cell").agg(F.count(F.lit(1)).alias("groups"), F.max(one).alias("hi"), F.min(F.struct("v", "g", "t", "n")).alias("lo"))


# ---------------------------------------------------------------- HR
def hr_facts(df: DataFrame, *, left: str | None = None, dept: str | None = None, salary: str | None = None, satisfaction: str | None = None,
             hours: str | None = None, projects: str | None = None, evaluation: str | None = None, promotion: str | None = None) -> DataFrame:
    """N-11: attrition, its extremes by department and salary band, flight risk, satisfaction as a share of its
    maximum, long hours, project load, the evaluation-satisfaction link and the departments' evaluation gap."""
    aggs: dict[str, Column] = {}
    if left:
        aggs |= {"rate": F.avg(truthy(left)) * 100.0, "n_left": F.sum(truthy(left)), "n_total": F.count(F.lit(1))}
    if satisfaction:
        top, low = F.max(F.col(satisfaction).cast("double")), F.count_if(F.col(satisfaction) < 0.4)
        aggs |= {"satisfaction": F.avg(satisfaction), "satisfaction_pct": F.when(top > 0, F.try_divide(F.avg(satisfaction) * 100.0, top)).when(top.isNotNull(), 0.0),
                 "n_low": low, "low_pct": F.try_divide(low * 100.0, F.count(F.lit(1)))}
    if hours:
        aggs |= {"hours": F.avg(hours), "n_long": F.count_if(F.col(hours) > 260)}
    if projects:
        aggs |= {"projects": F.avg(projects), "projects_min": F.min(projects), "projects_max": F.max(projects)}
    if promotion:
        aggs |= {"promotion_rate": F.avg(truthy(promotion)) * 100.0}
    parts = [_constants(df, "hr", {"any": 1} | {f"has_{k}": 1 for k, v in (("left", left), ("salary", salary), ("promotion", promotion), ("satisfaction", satisfaction)) if v})]
    if aggs:
        parts.append(_of(df.agg(*[v.cast("double").alias(k) for k, v in aggs.items()]), "hr", **{k: F.col(k) for k in aggs}))
    cells = {}
    if left:
        cells |= {k: (c, truthy(left) * 100.0) for k, c in (("dept", dept), ("salary", salary)) if c}
    if dept and evaluation:
        cells["evaluation"] = (dept, F.col(evaluation))
    if cells:
        for_cell = group_extremes(df, cells)
        names = F.col("cell")
        items = F.array(*[F.struct(F.concat(names, F.lit(f"_{k}")).alias("fact"), v.cast("double").alias("value"), lab.alias("label")) for k, v, lab in (
            ("groups", F.col("groups"), F.lit(None).cast("string")), ("highest", F.col("hi.v"), F.col("hi.g")), ("lowest", F.col("lo.v"), F.col("lo.g")),
            ("gap", F.col("hi.v") - F.col("lo.v"), F.lit(None).cast("string")),
            ("gap_pct", F.try_divide((F.col("hi.v") - F.col("lo.v")) * 100.0, F.col("lo.v")), F.lit(None).cast("string")))])
        parts.append(for_cell.select(F.lit("hr").alias("scope"), F.lit("hr").alias("column"), F.explode(items).alias("f")).select("scope", "column", "f.*"))
    if left and satisfaction:
        parts.append(_of(hr.flight_risk(df, left, satisfaction), "hr", n_flight_risk=F.col("n_flight_risk"), flight_risk_pct=F.col("flight_risk_pct")))
    if evaluation and satisfaction:
        r = spearman_pairs(df, [evaluation, satisfaction], with_p=False)
        parts.append(_of(r, "hr", evaluation_r=F.col("r"), evaluation_abs_r=F.abs("r")))
    return _join(df, parts)


HR_RULES = [
    Rule("attrition_crisis", "hr", (("rate", above(18), HIGH),), "{rate:1}% of the workforce left ({n_left:0} of {n_total:0}); {n_flight_risk:0} who stay are at risk.", "insight", "critical"),
    Rule("attrition_risk", "hr", (("rate", above(18), HIGH),), "Attrition of {rate:1}% takes knowledge and money with it.", "risk", "critical"),
    Rule("attrition_normal", "hr", (("rate", 0, 18),), "Attrition of {rate:1}% is within the usual range."),
    Rule("department_crisis", "hr", (("dept_groups", 2, HIGH), ("dept_gap", above(10), HIGH), ("dept_highest", above(25), HIGH)),
         "{dept_highest.label} loses {dept_highest:1}% of its staff, {dept_lowest.label} {dept_lowest:1}%.", "insight", "critical"),
    Rule("department_gap", "hr", (("dept_groups", 2, HIGH), ("dept_gap", above(10), HIGH), ("dept_highest", 0, 25)),
         "{dept_highest.label} loses {dept_highest:1}% of its staff, {dept_lowest.label} {dept_lowest:1}%.", "insight", "warning"),
    Rule("department_risk", "hr", (("dept_groups", 2, HIGH), ("dept_gap", above(10), HIGH)), "{dept_highest.label} lies {dept_gap:1} points above {dept_lowest.label} in attrition.", "risk", "warning"),
    Rule("salary_band", "hr", (("salary_highest", above(20), HIGH),), "Pay band {salary_highest.label} loses {salary_highest:1}% of its staff.", "insight", "critical"),
    Rule("satisfaction_crisis", "hr", (("satisfaction_pct", 0, below(55)),), "Satisfaction is {satisfaction_pct:1}% of its maximum; {n_low:0} people ({low_pct:1}%) are below 0.4.", "insight", "critical"),
    Rule("satisfaction_risk", "hr", (("satisfaction_pct", 0, below(55)),), "{n_low:0} people have given up on their work.", "risk", "critical"),
    Rule("satisfaction_below_target", "hr", (("satisfaction_pct", 55, below(70)),), "Satisfaction is {satisfaction_pct:1}% of its maximum, the target is 70%.", "insight", "warning"),
    Rule("satisfaction_strong", "hr", (("satisfaction_pct", 70, HIGH),), "Satisfaction is {satisfaction_pct:1}% of its maximum, above the target of 70%.", "insight", "positive"),
    Rule("satisfaction_chance", "hr", (("satisfaction_pct", 70, HIGH),), "Satisfaction of {satisfaction_pct:1}% helps to recruit.", "opportunity"),
    Rule("overwork_critical", "hr", (("hours", 240, HIGH),), "{hours:0} hours a month on average; {n_long:0} people work over 260.", "insight", "critical"),
    Rule("overwork", "hr", (("hours", above(220), below(240)),), "{hours:0} hours a month on average; {n_long:0} people work over 260.", "insight", "warning"),
    Rule("overwork_risk", "hr", (("hours", above(220), HIGH),), "Long hours lead to burnout and leaving.", "risk", "warning"),
    Rule("project_load", "hr", (("projects", above(5), HIGH),), "{projects:1} projects a person on average ({projects_min:0} to {projects_max:0}).", "insight", "warning"),
    Rule("evaluation_link", "hr", (("evaluation_abs_r", 0.3, HIGH),), "Evaluation and satisfaction are linked (r {evaluation_r})."),
    Rule("evaluation_gap", "hr", (("evaluation_groups", 2, HIGH), ("evaluation_gap", above(0.1), HIGH)),
         "{evaluation_lowest.label} is evaluated at {evaluation_lowest}, {evaluation_highest.label} at {evaluation_highest} ({evaluation_gap_pct:0}% more)."),
    Rule("act_survey", "hr", (("any", 1, 1),), "Ask about satisfaction every quarter and follow the trend.", "action"),
    Rule("act_flight_risk", "hr", (("has_left", 1, 1),), "Talk first to those with low satisfaction, long tenure and no promotion.", "action"),
    Rule("act_pay", "hr", (("has_salary", 1, 1),), "Compare pay with the market within a month.", "action"),
    Rule("act_careers", "hr", (("has_promotion", 1, 1),), "Show career paths at every level.", "action"),
    Rule("act_managers", "hr", (("has_satisfaction", 1, 1),), "Train managers: much of satisfaction depends on them.", "action"),
]


# ---------------------------------------------------------------- finance
def finance_facts(df: DataFrame, *, rev: str | None = None, cost: str | None = None, profit: str | None = None, budget: str | None = None,
                  actual: str | None = None, opex: str | None = None, period: str | None = None, cat: str | None = None) -> DataFrame:
    """N-20..N-26: margin, loss rows, revenue trend, budget variance, concentration of cost and revenue, expense ratio, cost growth."""
    parts = [_constants(df, "finance", {"any": 1})]
    plain = {k: F.sum(F.col(c).cast("double")) for k, c in (("rev", rev), ("cost", cost), ("profit", profit), ("opex", opex)) if c}
    if profit:
        plain |= {"n_loss": F.count_if(F.col(profit) < 0), "loss_pct": F.try_divide(F.count_if(F.col(profit) < 0) * 100.0, F.count(F.lit(1)))}
    if plain:
        a = df.agg(*[v.cast("double").alias(k) for k, v in plain.items()])
        if rev and cost:
            a = a.withColumn("margin", F.when(F.col("rev") > 0, (F.col("rev") - F.col("cost")) * 100.0 / F.col("rev")))
        if rev and opex:
            a = a.withColumn("expense_ratio", F.when(F.col("rev") > 0, F.col("opex") * 100.0 / F.col("rev")))
        parts.append(_of(a, "finance", **{k: F.col(k) for k in a.columns}))
    if rev and period:
        t = finance.revenue_trend(df, rev, period)
        parts.append(_of(t, "finance", n_periods=F.col("n_periods"), trend=F.col("trend_pct"), abs_trend=F.abs("trend_pct")))
    if budget and actual and budget != actual:
        v = finance.budget_variance(df, budget, actual).where("total_budget > 0")
        parts.append(_of(v, "finance", variance=F.col("variance_pct"), abs_variance=F.abs("variance_pct"), n_over=F.col("over_budget_rows"), n_under=F.col("under_budget_rows")))
    for k, c in (("cost", cost), ("rev", rev)):
        if c and cat:
            parts.append(_top_shares(df, "finance", cat, c, f"{k}_"))
    if cost and period:
        from .timeseries import first_last_growth
        g = first_last_growth(df, period, cost).where("n_periods > 1")
        parts.append(_of(g, "finance", cost_growth=F.col("growth_pct"), abs_cost_growth=F.abs("growth_pct")))
    return _join(df, parts)


def _top_shares(df: DataFrame, domain: str, group: str, value: str, prefix: str, min_n: int = 1) -> DataFrame:
    """Shares of the sum held by the largest group, the two largest and the three smallest; ties by name.  The group
    table is one row a group; its ends come from partial top lists."""
    g = (df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("g"))
         .agg(F.sum(F.col(value).cast("double")).alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n))
    none = F.lit(None)
    whole = g.agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")).select(F.lit("whole").alias("part"), "t", "n", none.cast("double").alias("first"), none.cast("string").alias("name"))
    top = g.orderBy(F.col("t").desc(), "g").limit(2).agg(F.sum("t").alias("t"), F.max("t").alias("first"), F.min_by("g", F.struct(-F.col("t"), "g")).alias("name"))
    last = g.orderBy("t", F.col("g").desc()).limit(3).agg(F.sum("t").alias("t"))
    three = whole.unionByName(top.select(F.lit("top").alias("part"), "t", "first", "name"), allowMissingColumns=True).unionByName(
        last.select(F.lit("last").alias("part"), "t"), allowMissingColumns=True)
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("t")))
    a = three.agg(of("whole").alias("whole"), of("top").alias("two"), of("last").alias("three"), F.max("n").alias("n"), F.max("first").alias("first"),
                  F.max("name").alias("name")).where("n > 1")
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("whole"))
    return _of(a, domain, **{f"{prefix}groups": F.col("n"), f"{prefix}top": F.col("name"), f"{prefix}top_share": share("first"),
                             f"{prefix}top2_share": share("two"), f"{prefix}bottom3_share": share("three")})


FINANCE_RULES = [
    Rule("margin", "finance", (("margin", -HIGH, HIGH),), "Gross margin is {margin:1}% (revenue {rev:0}, cost {cost:0})."),
    Rule("margin_critical", "finance", (("margin", -HIGH, below(10)),), "A gross margin of {margin:1}% leaves little for running costs.", "insight", "critical"),
    Rule("margin_thin_risk", "finance", (("margin", -HIGH, below(10)),), "A small rise in cost takes the whole profit.", "risk", "critical"),
    Rule("margin_low_risk", "finance", (("margin", 10, below(25)),), "Gross margin is below 25% ({margin:1}%): look at prices.", "risk", "warning"),
    Rule("margin_healthy", "finance", (("margin", 25, HIGH),), "A gross margin of {margin:1}% allows growth.", "opportunity"),
    Rule("profit", "finance", (("profit", -HIGH, HIGH),), "Net profit is {profit:0}; {n_loss:0} rows ({loss_pct:1}%) lose money."),
    Rule("loss_risk", "finance", (("n_loss", 1, HIGH),), "{n_loss:0} rows ({loss_pct:1}%) lose money: look for what they share.", "risk", "warning"),
    Rule("trend_up", "finance", (("trend", above(0), HIGH),), "Revenue grew by {abs_trend:1}% between the halves of {n_periods:0} periods."),
    Rule("trend_down", "finance", (("trend", -HIGH, 0),), "Revenue fell by {abs_trend:1}% between the halves of {n_periods:0} periods."),
    Rule("trend_critical", "finance", (("trend", -HIGH, below(-20)),), "Revenue declines by {abs_trend:1}%.", "insight", "critical"),
    Rule("trend_warning", "finance", (("trend", -20, below(-10)),), "Revenue declines by {abs_trend:1}%.", "insight", "warning"),
    Rule("trend_risk", "finance", (("trend", -HIGH, below(-10)),), "A decline of {abs_trend:1}% asks for its cause: market, price or volume.", "risk", "warning"),
    Rule("trend_chance", "finance", (("trend", above(15), HIGH),), "Growth of {trend:1}%: add capacity and guard the margin.", "opportunity"),
    Rule("budget", "finance", (("abs_variance", 0, HIGH),), "Actual against budget: {variance:1}% ({n_over:0} rows over, {n_under:0} under)."),
    Rule("budget_critical", "finance", (("abs_variance", above(20), HIGH),), "Actual is {abs_variance:1}% off its budget.", "insight", "critical"),
    Rule("budget_warning", "finance", (("abs_variance", above(10), 20),), "Actual is {abs_variance:1}% off its budget.", "insight", "warning"),
    Rule("budget_risk", "finance", (("abs_variance", above(10), HIGH),), "A variance of {variance:1}% needs an explanation and a new forecast.", "risk", "warning"),
    Rule("cost_top", "finance", (("cost_groups", 2, HIGH),), "{cost_top.label} is the largest cost, {cost_top_share:1}% of all."),
    Rule("cost_concentrated", "finance", (("cost_top_share", above(60), HIGH),), "{cost_top.label} makes {cost_top_share:1}% of the cost.", "risk", "warning"),
    Rule("cost_chance", "finance", (("cost_groups", 2, HIGH),), "The two largest categories make {cost_top2_share:0}% of the cost: start there.", "opportunity"),
    Rule("expense_ratio", "finance", (("expense_ratio", -HIGH, HIGH),), "Operating expenses are {expense_ratio:1}% of revenue."),
    Rule("expense_risk", "finance", (("expense_ratio", above(80), HIGH),), "Operating expenses of {expense_ratio:1}% leave little of the revenue.", "risk", "warning"),
    Rule("revenue_concentrated", "finance", (("rev_top_share", above(50), HIGH),), "{rev_top.label} brings {rev_top_share:1}% of the revenue.", "insight", "warning"),
    Rule("revenue_risk", "finance", (("rev_top_share", above(50), HIGH),), "Revenue depends on {rev_top.label} ({rev_top_share:1}%).", "risk", "warning"),
    Rule("cost_growth", "finance", (("abs_cost_growth", above(15), HIGH),), "Cost changed by {cost_growth:1}% from the first to the last period."),
    Rule("cost_growth_risk", "finance", (("cost_growth", above(15), HIGH),), "Cost grew by {cost_growth:1}%: check whether revenue kept up.", "risk", "warning"),
]


# ---------------------------------------------------------------- e-commerce
def ecommerce_facts(df: DataFrame, *, rating: str | None = None, category: str | None = None, price: str | None = None, discount: str | None = None) -> DataFrame:
    """N-40..N-43: ratings and their outliers, the category gap (categories of five ratings), price skewness, discounts, price-rating link."""
    parts = [_constants(df, "ecommerce", {"any": 1})]
    columns = [c for c in (rating, price, discount) if c]
    if columns:
        st = col_stats(df, columns, min_n=1)
        for k, c in (("rating", rating), ("price", price), ("discount", discount)):
            if c:
                s = st.where(F.col("column") == c)
                wanted = {"rating": {"rating": "mean", "rating_median": "median", "rating_q1": "q1", "n_outliers": "outliers", "outlier_pct": "outlier_pct"},
                          "price": {"price": "mean", "price_median": "median", "price_q3": "q3", "price_skew": "skew"}, "discount": {"discount": "mean", "discount_max": "max"}}[k]
                parts.append(_of(s, "ecommerce", **{f: F.col(v) for f, v in wanted.items()}))
    if rating:
        parts.append(_of(df.agg(F.count_if(F.col(rating) < 3.0).alias("n")), "ecommerce", n_low=F.col("n")))
    if rating and category:
        e = group_extremes(df, {"rating": (category, F.col(rating))}, min_n=5).where("groups > 1")
        gap = F.col("hi.v") - F.col("lo.v")
        parts.append(_of(e, "ecommerce", category_groups=F.col("groups"), best=F.col("hi.g"), worst=F.col("lo.g"), best_rating=F.col("hi.v"), worst_rating=F.col("lo.v"),
                         category_gap=gap, category_gap_pct=F.try_divide(gap * 100.0, F.col("lo.v"))))
    if rating and price:
        parts.append(_of(ecommerce.price_rating_link(df, price, rating), "ecommerce", price_r=F.col("r")))
    return _join(df, parts)


ECOMMERCE_RULES = [
    Rule("rating_emergency", "ecommerce", (("rating", -HIGH, below(3.5)),), "Ratings average {rating}; {n_low:0} are below 3, a quarter below {rating_q1:1}.", "insight", "critical"),
    Rule("rating_risk", "ecommerce", (("rating", -HIGH, below(3.5)),), "{n_low:0} ratings below 3 cost sales.", "risk", "critical"),
    Rule("rating_below_target", "ecommerce", (("rating", 3.5, below(4)),), "Ratings average {rating}, the target is 4; {n_low:0} are below 3.", "insight", "warning"),
    Rule("rating_strong", "ecommerce", (("rating", 4, HIGH),), "Ratings average {rating}, above the target of 4.", "insight", "positive"),
    Rule("rating_chance", "ecommerce", (("rating", 4, HIGH),), "A rating of {rating} bears a test of higher prices.", "opportunity"),
    Rule("rating_outliers", "ecommerce", (("n_outliers", 1, HIGH),), "{n_outliers:0} ratings ({outlier_pct:1}%) are outliers: check quality and fraud."),
    Rule("category_gap_critical", "ecommerce", (("category_gap", 0.8, HIGH),), "{worst.label} ({worst_rating}) is {category_gap:1} points behind {best.label} ({best_rating}).", "insight", "critical"),
    Rule("category_gap", "ecommerce", (("category_gap", above(0.3), below(0.8)),), "{worst.label} ({worst_rating}) is {category_gap:1} points behind {best.label} ({best_rating}).", "insight", "warning"),
    Rule("category_range", "ecommerce", (("category_gap", above(0.3), HIGH),), "Categories range from {worst.label} ({worst_rating}) to {best.label} ({best_rating})."),
    Rule("price_skewed", "ecommerce", (("price_skew", above(1.5), HIGH),), "Prices are right-skewed ({price_skew:1}): median {price_median:0}, mean {price:0}."),
    Rule("price_chance", "ecommerce", (("price_skew", above(1.5), HIGH),), "Few products stand between {price_median:0} and {price_q3:0}.", "opportunity"),
    Rule("discount_critical", "ecommerce", (("discount", 55, HIGH),), "Discounts average {discount:0}% (at most {discount_max:0}%): margins are at risk.", "insight", "critical"),
    Rule("discount_high", "ecommerce", (("discount", above(40), below(55)),), "Discounts average {discount:0}% (at most {discount_max:0}%): margins are at risk.", "insight", "warning"),
    Rule("discount_risk", "ecommerce", (("discount", above(40), HIGH),), "Discounts of {discount:0}% wear margins down.", "risk", "warning"),
    Rule("price_risk", "ecommerce", (("price_r", -HIGH, -0.3),), "Dearer products are rated lower (r {price_r}).", "risk", "warning"),
    Rule("price_quality", "ecommerce", (("price_r", 0.3, HIGH),), "Dearer products are rated higher (r {price_r}).", "opportunity"),
]


# ---------------------------------------------------------------- sales
def sales_facts(df: DataFrame, *, rev: str | None = None, target: str | None = None, region: str | None = None, product: str | None = None,
                margin: str | None = None) -> DataFrame:
    """N-60..N-64: revenue and its spread, achievement (mean revenue over mean target), the gap between the regions with
    the largest and the smallest revenue, product concentration, loss rows."""
    parts = [_constants(df, "sales", {"any": 1})]
    if rev:
        s = col_stats(df, [rev], min_n=1)
        parts.append(_of(s, "sales", rev=F.col("mean"), rev_median=F.col("median"), rev_min=F.col("min"), rev_max=F.col("max"), rev_q3=F.col("q3"), rev_cv=F.col("cv"), rev_skew=F.col("skew")))
    if rev and target:
        parts.append(_of(sales.target_achievement(df, rev, target), "sales", target=F.col("avg_target"), achievement=F.when(F.col("avg_target") > 0, F.col("achievement_pct")).when(F.col("avg_target").isNotNull(), 0.0)))
    if rev and region:
        g = sales.regional_gap(df, region, rev).where("best_worst_gap_pct is not null")
        of = F.struct("revenue", region)
        e = g.agg(F.max_by(region, of).alias("top"), F.max_by("share_pct", of).alias("share"), F.min_by(region, of).alias("bottom"),
                  F.first("best_worst_gap_pct").alias("gap"), F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(_of(e, "sales", region_groups=F.col("n"), region_top=F.col("top").cast("string"), region_bottom=F.col("bottom").cast("string"), region_share=F.col("share"), region_gap=F.col("gap")))
    if rev and product:
        parts.append(_top_shares(df, "sales", product, rev, "product_", min_n=3))
    if margin:
        m = sales.loss_rows(df, margin)
        parts.append(_of(m, "sales", n_loss=F.col("loss_rows"), loss_pct=F.col("loss_pct")))
    return _join(df, parts)


SALES_RULES = [
    Rule("revenue_steady", "sales", (("rev_cv", 0, below(0.5)),), "Revenue averages {rev:0} (median {rev_median:0}, {rev_min:0} to {rev_max:0}).", "insight", "info"),
    Rule("revenue_variable", "sales", (("rev_cv", 0.5, HIGH),), "Revenue averages {rev:0} (median {rev_median:0}, {rev_min:0} to {rev_max:0}) and varies much.", "insight", "warning"),
    Rule("revenue_skewed", "sales", (("rev_skew", above(1.5), HIGH),), "A few large deals carry revenue: median {rev_median:0}, mean {rev:0}."),
    Rule("revenue_chance", "sales", (("rev_skew", above(1.5), HIGH),), "Find what the largest deals have in common.", "opportunity"),
    Rule("target_critical", "sales", (("achievement", -HIGH, below(70)),), "Targets are met to {achievement:0}%.", "insight", "critical"),
    Rule("target_warning", "sales", (("achievement", 70, below(80)),), "Targets are met to {achievement:0}%.", "insight", "warning"),
    Rule("target_risk", "sales", (("achievement", -HIGH, below(80)),), "Revenue is well below plan ({achievement:0}%).", "risk", "warning"),
    Rule("target_exceeded", "sales", (("achievement", 100, HIGH),), "Targets are exceeded ({achievement:0}%).", "insight", "positive"),
    Rule("target_chance", "sales", (("achievement", 100, HIGH),), "At {achievement:0}% the next targets may be higher.", "opportunity"),
    Rule("region_critical", "sales", (("region_gap", 50, HIGH),), "{region_bottom.label} is {region_gap:0}% behind {region_top.label}.", "insight", "critical"),
    Rule("region_gap", "sales", (("region_gap", -HIGH, below(50)),), "{region_bottom.label} is {region_gap:0}% behind {region_top.label}.", "insight", "warning"),
    Rule("region_concentrated", "sales", (("region_share", above(50), HIGH),), "{region_top.label} brings {region_share:0}% of the revenue."),
    Rule("region_even", "sales", (("region_share", 0, 50),), "Revenue is spread over {region_groups:0} regions."),
    Rule("product_concentrated", "sales", (("product_top_share", above(40), HIGH),), "{product_top.label} brings {product_top_share:0}% of the revenue.", "risk", "warning"),
    Rule("product_tail", "sales", (("product_groups", 2, HIGH),), "The three smallest products bring {product_bottom3_share:0}%: move resources?", "opportunity"),
    Rule("loss_critical", "sales", (("n_loss", 1, HIGH), ("loss_pct", above(10), HIGH)), "{n_loss:0} deals ({loss_pct:0}%) lose money.", "insight", "critical"),
    Rule("loss_warning", "sales", (("n_loss", 1, HIGH), ("loss_pct", 0, 10)), "{n_loss:0} deals ({loss_pct:0}%) lose money.", "insight", "warning"),
    Rule("loss_risk", "sales", (("n_loss", 1, HIGH),), "{n_loss:0} deals at a loss wear profit down.", "risk", "warning"),
    Rule("act_review", "sales", (("any", 1, 1),), "Compare revenue with its target every week, by person and region.", "action"),
    Rule("act_pipeline", "sales", (("any", 1, 1),), "Name the three deals most at risk and act on them.", "action"),
]

DOMAIN_FACTS = {"hr": hr_facts, "finance": finance_facts, "ecommerce": ecommerce_facts, "sales": sales_facts}
DOMAIN_RULES = {"hr": HR_RULES, "finance": FINANCE_RULES, "ecommerce": ECOMMERCE_RULES, "sales": SALES_RULES}


def domain_findings(df: DataFrame, domain: str, **roles: str | None) -> DataFrame:
    """``(rule, kind, severity, text)`` of a domain's rules that fire, in rule order (``place``)."""
    return fired(DOMAIN_FACTS[domain](df, **roles), DOMAIN_RULES[domain]).select("place", "rule", "kind", "severity", "text")


# ---------------------------------------------------------------- D-17
CONTEXT_RULES = {
    "hr": [
        Rule("attrition rate", "hr", (("rate", 0, HIGH),), "{rate:1}%|10 to 20% is common, by sector"),
        Rule("satisfaction", "hr", (("satisfaction", -HIGH, HIGH),), "{satisfaction:3}|median {satisfaction_median:3} of these rows"),
        Rule("promotion rate", "hr", (("promotion_rate", 0, HIGH),), "{promotion_rate:1}%|check against personnel records"),
        Rule("attrition by department", "hr", (("dept_groups", 1, HIGH),), "{dept_lowest:1}% to {dept_highest:1}%|best {dept_lowest.label}, worst {dept_highest.label}"),
    ],
    "ecommerce": [
        Rule("rating", "ecommerce", (("rating", -HIGH, HIGH),), "{rating}|median {rating_median} of these rows"),
        Rule("discount", "ecommerce", (("discount", -HIGH, HIGH),), "{discount:1}%|compare with earlier periods"),
    ],
}
COLUMN_CONTEXT = [Rule("column", "column", (("mean", -HIGH, HIGH),), "{mean}|median {median} of these rows")]


def context_rows(df: DataFrame, domain: str, columns: list[str] | None = None, **roles: str | None) -> DataFrame:
    """D-17: ``(metric, value, reference)``, what the rows give beside a reference for it.  HR and e-commerce have
    rows of their roles; sales and finance one row a numeric column (``columns``)."""
    if domain in CONTEXT_RULES:
        known = DOMAIN_FACTS[domain](df, **roles)
        if domain == "hr" and roles.get("satisfaction"):
            q = exact_quantiles(df.select(F.col(roles["satisfaction"]).cast("double").alias("v")), [], "v", [0.5])
            known = known.unionByName(_of(q, "hr", satisfaction_median=F.col("q0")))
        said = fired(known, CONTEXT_RULES[domain]).withColumn("metric", F.col("rule"))
    elif domain in ("sales", "finance"):
        st = col_stats(df, columns, min_n=1)
        known = _join(df, [facts(st, "column", F.col("column"), mean=F.col("mean"), median=F.col("median"))])
        said = fired(known, COLUMN_CONTEXT).withColumn("metric", F.col("column"))
    else:
        raise ValueError(f"no context for domain {domain!r}")
    value = F.substring_index("text", "|", 1)  # a name in the reference may hold a bar of its own
    return said.select("metric", value.alias("value"), F.expr("substring(text, instr(text, '|') + 1)").alias("reference"))
