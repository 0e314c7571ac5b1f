"""Registered queries over fact tables and rules: chart facts and sentences of every kind (D-11..D-13),
domain rules (N-11, N-20.., N-40.., N-60..) and context rows (D-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chart_facts as cf
from ..operators import domain_rules as dr
from ..operators import insights as ins
from ..operators import select as sel
from ..operators.rules import Rule
from ..sources.tables import read_table
from .catalog import register
from .views import VIEWS, ecommerce_view, hr_view, sales_view, with_views


# ---------------------------------------------------------------- helpers
def _rounded_facts(df: DataFrame) -> DataFrame:
    """Values to 6 decimals, large ones to 2 or none: sums differ in their last bits between engines."""
    v = F.col("value")
    return df.withColumn("value", F.when(F.abs(v) >= 1e6, F.round(v, 0)).when(F.abs(v) >= 1e4, F.round(v, 2)).otherwise(F.round(v, 6)))


FACT_ROWS = """SELECT scope, "column", fact,
       CASE WHEN abs(value) >= 1e6 THEN round(value, 0) WHEN abs(value) >= 1e4 THEN round(value, 2) ELSE round(value, 6) END AS value, label FROM f"""


def long_sql(source: str, scope: str, subject: str, values: dict[str, str], labels: dict[str, str] | None = None) -> str:
    """SELECTs that unpivot one table into facts; ``subject`` is an SQL expression."""
    rows = [(k, v, (labels or {}).get(k)) for k, v in values.items()] + [(k, None, v) for k, v in (labels or {}).items() if k not in values]
    return "\nUNION ALL ".join(f"""SELECT '{scope}' AS scope, {subject} AS "column", '{k}' AS fact, CAST({v or 'NULL'} AS DOUBLE) AS value,
       CAST({lab or 'NULL'} AS VARCHAR) AS label FROM {source}""" for k, v, lab in rows)


def _text_sql(text: str) -> str:
    """A rule's sentence over the maps ``v`` and ``l`` of its facts."""
    parts = []
    for i, piece in enumerate(text.replace("}", "{").split("{")):
        if i % 2 == 0:
            parts.append("'" + piece.replace("'", "''") + "'")
        elif piece.endswith(".label"):
            parts.append(f"coalesce(l['{piece[:-6]}'], '')")
        else:
            name, _, digits = piece.partition(":")
            parts.append(f"coalesce(printf('%.{digits or 2}f', round(v['{name}'], {digits or 2})), '')")
    return " || ".join(parts)


def fired_sql(rules: list[Rule]) -> str:
    """The rules over the facts ``f``, as a CTE body ``(place, rule, scope, column, kind, severity, text)``."""
    arms = [f"""SELECT {i} AS place, '{r.name}' AS rule, scope, "column", '{r.kind}' AS kind, '{r.severity}' AS severity, {_text_sql(r.text)} AS text
FROM k WHERE scope = '{r.scope}' AND """ + " AND ".join(f"v['{f}'] BETWEEN {float(lo)!r} AND {float(hi)!r}" for f, lo, hi in r.conditions)
            for i, r in enumerate(rules)]
    return "\nUNION ALL ".join(arms)


KNOWN = """k AS (SELECT scope, "column", map(list(fact), list(value)) AS v, map(list(fact), list(label)) AS l FROM f GROUP BY 1, 2)"""


# ---------------------------------------------------------------- D-11: a query a kind
def _spec(chart_id: str, chart_type: str, x: str | None = None, y: str | None = None) -> dict:
    return {"chart_id": chart_id, "chart_type": chart_type, "title": chart_id, "x": x, "y": y}


BARS = [_spec("rev by region", "bar", "region", "rev"), _spec("margin by product", "bar_ascending", "product", "margin")]
PIES = [_spec("rev share by product", "pie", "product", "rev"), _spec("target share by rep", "pie", "rep", "target")]
HISTOGRAMS = [_spec("distribution of rev", "histogram", "rev"), _spec("distribution of margin", "histogram", "margin")]
TRENDS = [_spec("rev over time", "line", "period", "rev"), _spec("margin over time", "line", "period", "margin")]
MATRIX = [_spec("correlation matrix", "heatmap")]
METRICS = ["rev", "target", "margin"]
LABEL = {"rev": "Rev", "margin": "Margin", "target": "Target", "region": "Region", "product": "Product", "rep": "Rep"}


def _per_chart(specs: list[dict], body) -> str:
    return "\nUNION ALL ".join(body(s) for s in specs)


def _bar_sql() -> str:
    groups = _per_chart(BARS, lambda s: f"""SELECT '{s["chart_id"]}' AS chart, {s["x"]} AS dim, avg({s["y"]}) AS v, (SELECT avg({s["y"]}) FROM sales) AS av,
       '{LABEL[s["y"]]}' AS my, '{LABEL[s["x"]]}' AS mx FROM sales WHERE {s["x"]} IS NOT NULL AND {s["y"]} IS NOT NULL GROUP BY 2""")
    return f"""bg AS ({groups})
, b AS (SELECT chart, my, mx, av, arg_max(dim, v) AS hi, max(v) AS hv, arg_min(dim, v) AS lo, min(v) AS lv, count(*) AS n, count(*) FILTER (v > av) AS up FROM bg GROUP BY ALL)"""


BAR_ROWS = long_sql("b", "bar", "chart", {"top_value": "hv", "worst_value": "lv", "avg_value": "av", "n_groups": "n", "n_above_avg": "up",
                                          "gap_pct": "abs(hv - lv) * 100.0 / greatest(abs(lv), 0.001)"}, {"metric": "my", "dimension": "mx", "top": "hi", "worst": "lo"})


def _pie_sql() -> str:
    groups = _per_chart(PIES, lambda s: f"""SELECT '{s["chart_id"]}' AS chart, {s["x"]} AS dim, avg({s["y"]}) AS v, '{LABEL[s["y"]]}' AS my, '{LABEL[s["x"]]}' AS mx
FROM sales WHERE {s["x"]} IS NOT NULL GROUP BY 2""")
    return f"""pg AS ({groups})
, po AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY v DESC, dim) AS i FROM pg)
, p AS (SELECT chart, my, mx, max(dim) FILTER (i = 1) AS top, sum(v) FILTER (i = 1) * 100.0 / sum(v) AS s1, sum(v) FILTER (i <= 2) * 100.0 / sum(v) AS s2, count(*) AS n
        FROM po GROUP BY ALL)"""


PIE_ROWS = long_sql("p", "pie", "chart", {"top_share": "s1", "top2_share": "s2", "n_segments": "n", "balanced": "CAST(s1 < 40 AS INT)"},
                    {"metric": "my", "dimension": "mx", "top": "top"})


def _histogram_sql() -> str:
    one = _per_chart(HISTOGRAMS, lambda s: f"""SELECT '{s["chart_id"]}' AS chart, '{LABEL[s["x"]]}' AS my, avg({s["x"]}) AS m, quantile_cont({s["x"]}, 0.5) AS md, stddev_samp({s["x"]}) AS sd,
       min({s["x"]}) AS lo, max({s["x"]}) AS hi, quantile_cont({s["x"]}, 0.25) AS q1, quantile_cont({s["x"]}, 0.75) AS q3, skewness({s["x"]}) AS g FROM sales""")
    return f"h AS ({one})"


HISTOGRAM_ROWS = long_sql("h", "histogram", "chart", {
    "mean": "m", "median": "md", "std": "sd", "min": "lo", "max": "hi", "q1": "q1", "q3": "q3", "skew": "g", "abs_skew": "abs(g)",
    "use_value": "CASE WHEN abs(g) > 0.5 THEN md ELSE m END"}, {
    "metric": "my", "shape": "CASE WHEN g > 0.5 THEN 'right-skewed' WHEN g < -0.5 THEN 'left-skewed' ELSE 'symmetric' END",
    "use_stat": "CASE WHEN abs(g) > 0.5 THEN 'median' ELSE 'mean' END"})


def _trend_sql() -> str:
    series = _per_chart(TRENDS, lambda s: f"""SELECT '{s["chart_id"]}' AS chart, '{LABEL[s["y"]]}' AS my, period AS p, avg({s["y"]}) AS v FROM sales
WHERE period IS NOT NULL AND {s["y"]} IS NOT NULL GROUP BY 3""")
    return f"""ts AS ({series})
, ti AS (SELECT *, row_number() OVER (PARTITION BY chart ORDER BY p) > count(*) OVER (PARTITION BY chart) // 2 AS late FROM ts)
, t AS (SELECT chart, my, avg(v) AS m, min(v) AS lo, max(v) AS hi, stddev_samp(v) * 100.0 / abs(avg(v)) AS cv, avg(v) FILTER (NOT late) AS f, avg(v) FILTER (late) AS l, count(*) AS n
        FROM ti GROUP BY ALL)"""


_CHANGE = "(l - f) * 100.0 / greatest(abs(f), 0.001)"
TREND_ROWS = long_sql("t", "trend", "chart", {"mean": "m", "min": "lo", "max": "hi", "cv": "cv", "first_half": "f", "second_half": "l", "n_periods": "n",
                                              "change_pct": _CHANGE, "abs_change": f"abs({_CHANGE})"}, {"metric": "my"})


def rank_sql(table: str, columns: list[str]) -> str:
    """Average ranks of columns without nulls."""
    return ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in columns) + f" FROM {table}"


def _matrix_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1:]]
    return f"""mr AS (SELECT {rank_sql("sales", METRICS)})
, mp AS ({" UNION ALL ".join(f"SELECT '{LABEL[a]}' AS a, '{LABEL[b]}' AS b, corr(r_{a}, r_{b}) AS r FROM mr" for a, b in pairs)})
, mo AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC, a, b) AS i FROM mp WHERE abs(r) >= 0.15)
, m AS (SELECT count(*) AS n, max(a) FILTER (i = 1) AS a1, max(b) FILTER (i = 1) AS b1, max(r) FILTER (i = 1) AS r1,
               max(a) FILTER (i = 2) AS a2, max(b) FILTER (i = 2) AS b2, max(r) FILTER (i = 2) AS r2 FROM mo)"""


MATRIX_ROWS = long_sql("m", "correlation", "'correlation matrix'", {"n_pairs": "n", "r": "r1", "r2": "r1 * r1", "r2_pct": "r1 * r1 * 100.0", "second_r": "r2"},
                       {"a": "a1", "b": "b1", "second_a": "a2", "second_b": "b2"})

_KINDS = {"bar": (BARS, _bar_sql(), BAR_ROWS), "pie": (PIES, _pie_sql(), PIE_ROWS), "histogram": (HISTOGRAMS, _histogram_sql(), HISTOGRAM_ROWS),
          "trend": (TRENDS, _trend_sql(), TREND_ROWS), "correlation": (MATRIX, _matrix_sql(), MATRIX_ROWS)}

for _kind, (_specs, _ctes, _rows) in _KINDS.items():
    @register(f"D11_chart_facts_{_kind}_sales", with_views(f", {_ctes}\n, f AS ({_rows})\n{FACT_ROWS}", "sales"))
    def _q_kind(spark, sf, specs=tuple(_specs)):
        return _rounded_facts(cf.chart_facts(sales_view(spark, sf), specs, METRICS))


# ---------------------------------------------------------------- D-12 / D-13: one dispatch over all kinds
@register("D12_narratives_all_kinds_sales", with_views(
    "".join(f", {ctes}\n" for _, ctes, _ in _KINDS.values())
    + ", f AS (" + "\nUNION ALL ".join(rows for _, _, rows in _KINDS.values())
    + "\nUNION ALL SELECT 'histogram', chart, 'money', 1.0, NULL FROM h)\n, " + KNOWN + f"\n, said AS ({fired_sql(cf.CHART_RULES)})"
    + """\nSELECT "column" AS chart_id, scope AS kind, string_agg(text, ' ' ORDER BY place) AS narrative FROM said GROUP BY 1, 2""", "sales"))
def q_d12_all(spark, sf):
    specs = [s for some, _, _ in _KINDS.values() for s in some]
    return cf.narratives(sales_view(spark, sf), specs, "sales", METRICS)


@register("D13_title_dispatch_narratives_hr")
def q_d13_titles(spark, sf):
    titles = ["Avg Satisfaction by Dept", "Distribution of Hours", "Income Share by Salary", "Tenure Trend", "Correlation Heatmap", "Workforce"]
    people = hr_view(spark, sf).withColumn("month", F.floor(F.col("tenure") * 12).cast("int"))
    return cf.title_narratives(people.withColumn("month", F.lpad(F.col("month").cast("string"), 4, "0")), titles, "hr", "month")


# ---------------------------------------------------------------- domain rules
ROLES = {
    "hr": {"left": "left", "dept": "dept", "salary": "salary", "satisfaction": "satisfaction", "hours": "hours", "projects": "projects",
           "evaluation": "evaluation", "promotion": "promotion"},
    "finance": {"rev": "rev", "cost": "cost", "profit": "profit", "budget": "budget", "actual": "actual", "opex": "opex", "period": "period", "cat": "cat"},
    "ecommerce": {"rating": "rating", "category": "category", "price": "price", "discount": "discount"},
    "sales": {"rev": "rev", "target": "target", "region": "region", "product": "product", "margin": "margin"},
}


def _extremes(cell: str, group: str, value: str, source: str, scope: str) -> tuple[str, str]:
    body = f"""x_{cell} AS (SELECT arg_max(g, v) AS hg, max(v) AS hv, arg_min(g, v) AS lg, min(v) AS lv, count(*) AS n
  FROM (SELECT {group} AS g, avg({value}) AS v FROM {source} WHERE {group} IS NOT NULL GROUP BY 1))"""
    rows = long_sql(f"x_{cell}", scope, f"'{scope}'", {f"{cell}_groups": "n", f"{cell}_highest": "hv", f"{cell}_lowest": "lv", f"{cell}_gap": "hv - lv",
                                                        f"{cell}_gap_pct": "(hv - lv) * 100.0 / lv"}, {f"{cell}_highest": "hg", f"{cell}_lowest": "lg"})
    return body, rows


def _hr_facts_sql() -> str:
    cells = [_extremes("dept", "dept", "gone * 100.0", "people", "hr"), _extremes("salary", "salary", "gone * 100.0", "people", "hr"),
             _extremes("evaluation", "dept", "evaluation", "people", "hr")]
    plain = {"rate": "avg(gone) * 100.0", "n_left": "sum(gone)", "n_total": "count(*)", "satisfaction": "avg(satisfaction)",
             "satisfaction_pct": "avg(satisfaction) * 100.0 / max(satisfaction)", "n_low": "count(*) FILTER (satisfaction < 0.4)",
             "low_pct": "count(*) FILTER (satisfaction < 0.4) * 100.0 / count(*)", "hours": "avg(hours)", "n_long": "count(*) FILTER (hours > 260)",
             "projects": "avg(projects)", "projects_min": "min(projects)", "projects_max": "max(projects)", "promotion_rate": "avg(promotion) * 100.0"}
    parts = [long_sql("(SELECT 1)", "hr", "'hr'", {k: "1" for k in ("any", "has_left", "has_salary", "has_promotion", "has_satisfaction")}),
             long_sql("people", "hr", "'hr'", plain), *[rows for _, rows in cells],
             long_sql("risk", "hr", "'hr'", {"n_flight_risk": "n", "flight_risk_pct": "n * 100.0 / stay"}),
             long_sql("link", "hr", "'hr'", {"evaluation_r": "r", "evaluation_abs_r": "abs(r)"})]
    return f""", people AS (SELECT *, CASE WHEN lower(trim("left")) = 'yes' THEN 1 ELSE 0 END AS gone FROM hr)
, {", ".join(body for body, _ in cells)}
, thr AS (SELECT quantile_cont(satisfaction, 0.25) AS t FROM people WHERE gone = 0)
, risk AS (SELECT count(*) FILTER (satisfaction < (SELECT t FROM thr)) AS n, count(*) AS stay FROM people WHERE gone = 0)
, ranks AS (SELECT {rank_sql("people", ["evaluation", "satisfaction"])})
, link AS (SELECT corr(r_evaluation, r_satisfaction) AS r FROM ranks)
, f AS ({chr(10).join(["", "UNION ALL "]).join(parts)})"""


def _shares(prefix: str, group: str, value: str, source: str, scope: str, least: int = 1) -> tuple[str, str]:
    body = f"""s_{prefix} AS (SELECT g, t, row_number() OVER (ORDER BY t DESC, g) AS i, row_number() OVER (ORDER BY t, g DESC) AS j
  FROM (SELECT {group} AS g, sum({value}) AS t FROM {source} WHERE {group} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1 HAVING count(*) >= {least}))"""
    rows = long_sql(f"s_{prefix}", scope, f"'{scope}'", {f"{prefix}_groups": "count(*)", f"{prefix}_top_share": "sum(t) FILTER (i = 1) * 100.0 / sum(t)",
                                                          f"{prefix}_top2_share": "sum(t) FILTER (i <= 2) * 100.0 / sum(t)",
                                                          f"{prefix}_bottom3_share": "sum(t) FILTER (j <= 3) * 100.0 / sum(t)"},
                    {f"{prefix}_top": "max(g) FILTER (i = 1)"})
    return body, rows


def _finance_facts_sql() -> str:
    cells = [_shares("cost", "cat", "cost", "finance", "finance"), _shares("rev", "cat", "rev", "finance", "finance")]
    plain = {"rev": "sum(rev)", "cost": "sum(cost)", "profit": "sum(profit)", "opex": "sum(opex)", "n_loss": "count(*) FILTER (profit < 0)",
             "loss_pct": "count(*) FILTER (profit < 0) * 100.0 / count(*)", "margin": "(sum(rev) - sum(cost)) * 100.0 / sum(rev)", "expense_ratio": "sum(opex) * 100.0 / sum(rev)"}
    variance = "(sum(actual) - sum(budget)) * 100.0 / sum(budget)"
    parts = [long_sql("(SELECT 1)", "finance", "'finance'", {"any": "1"}), long_sql("finance", "finance", "'finance'", plain), *[rows for _, rows in cells],
             long_sql("halves", "finance", "'finance'", {"n_periods": "n", "trend": "(l - e) * 100.0 / e", "abs_trend": "abs((l - e) * 100.0 / e)"}),
             long_sql("finance", "finance", "'finance'", {"variance": variance, "abs_variance": f"abs({variance})", "n_over": "count(*) FILTER (actual > budget)",
                                                          "n_under": "count(*) FILTER (actual < budget)"}),
             long_sql("growth", "finance", "'finance'", {"cost_growth": "(l - e) * 100.0 / e", "abs_cost_growth": "abs((l - e) * 100.0 / e)"})]
    return f""", {", ".join(body for body, _ in cells)}
, per AS (SELECT period, sum(rev) AS r, sum(cost) AS c, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS n FROM finance WHERE period IS NOT NULL GROUP BY 1)
, halves AS (SELECT avg(r) FILTER (i <= n // 2) AS e, avg(r) FILTER (i > n // 2) AS l, max(n) AS n FROM per)
, growth AS (SELECT max(c) FILTER (i = 1) AS e, max(c) FILTER (i = n) AS l FROM per)
, f AS ({chr(10).join(["", "UNION ALL "]).join(parts)})"""


def _ecommerce_facts_sql() -> str:
    quart = "quantile_cont({0}, 0.25) - 1.5 * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)) AS lo, quantile_cont({0}, 0.75) + 1.5 * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)) AS hi"
    biased = "(avg(power(price - m, 3)) / power(avg(power(price - m, 2)), 1.5))"
    parts = [long_sql("(SELECT 1)", "ecommerce", "'ecommerce'", {"any": "1"}),
             long_sql("ecommerce", "ecommerce", "'ecommerce'", {
                 "rating": "avg(rating)", "rating_median": "quantile_cont(rating, 0.5)", "rating_q1": "quantile_cont(rating, 0.25)", "price": "avg(price)",
                 "price_median": "quantile_cont(price, 0.5)", "price_q3": "quantile_cont(price, 0.75)", "discount": "avg(discount)", "discount_max": "max(discount)",
                 "n_low": "count(*) FILTER (rating < 3.0)"}),
             long_sql("ecommerce, fence", "ecommerce", "'ecommerce'", {"n_outliers": "count(*) FILTER (rating < lo OR rating > hi)",
                                                                       "outlier_pct": "count(*) FILTER (rating < lo OR rating > hi) * 100.0 / count(*)"}),
             long_sql("(SELECT price, (SELECT avg(price) FROM ecommerce) AS m FROM ecommerce)", "ecommerce", "'ecommerce'", {"price_skew": biased}),
             long_sql("gap", "ecommerce", "'ecommerce'", {"category_groups": "n", "best_rating": "hv", "worst_rating": "lv", "category_gap": "hv - lv",
                                                          "category_gap_pct": "(hv - lv) * 100.0 / lv"}, {"best": "hg", "worst": "lg"}),
             long_sql("link", "ecommerce", "'ecommerce'", {"price_r": "r"})]
    return f""", fence AS (SELECT {quart.format("rating")} FROM ecommerce)
, gap AS (SELECT arg_max(g, v) AS hg, max(v) AS hv, arg_min(g, v) AS lg, min(v) AS lv, count(*) AS n
  FROM (SELECT category AS g, avg(rating) AS v FROM ecommerce WHERE category IS NOT NULL GROUP BY 1 HAVING count(rating) >= 5))
, ranks AS (SELECT {rank_sql("ecommerce", ["price", "rating"])})
, link AS (SELECT corr(r_price, r_rating) AS r FROM ranks)
, f AS ({chr(10).join(["", "UNION ALL "]).join(parts)})"""


def _sales_facts_sql() -> str:
    body, rows = _shares("product", "product", "rev", "sales", "sales", 3)
    biased = "(avg(power(rev - m, 3)) / power(avg(power(rev - m, 2)), 1.5))"
    parts = [long_sql("(SELECT 1)", "sales", "'sales'", {"any": "1"}),
             long_sql("sales", "sales", "'sales'", {
                 "rev": "avg(rev)", "rev_median": "quantile_cont(rev, 0.5)", "rev_min": "min(rev)", "rev_max": "max(rev)", "rev_q3": "quantile_cont(rev, 0.75)",
                 "rev_cv": "stddev_samp(rev) / abs(avg(rev))", "target": "avg(target)", "achievement": "avg(rev) * 100.0 / avg(target)",
                 "n_loss": "count(*) FILTER (margin < 0)", "loss_pct": "count(*) FILTER (margin < 0) * 100.0 / count(*)"}),
             long_sql("(SELECT rev, (SELECT avg(rev) FROM sales) AS m FROM sales)", "sales", "'sales'", {"rev_skew": biased}),
             long_sql("regions", "sales", "'sales'", {"region_groups": "count(*)", "region_share": "max(t) * 100.0 / sum(t)",
                                                      "region_gap": "(arg_max(v, t) - arg_min(v, t)) * 100.0 / greatest(arg_min(v, t), 1.0)"},
                      {"region_top": "arg_max(g, t)", "region_bottom": "arg_min(g, t)"}), rows]
    return f""", {body}
, regions AS (SELECT region AS g, sum(rev) AS t, avg(rev) AS v FROM sales WHERE region IS NOT NULL GROUP BY 1 HAVING count(rev) >= 3)
, f AS ({chr(10).join(["", "UNION ALL "]).join(parts)})"""


FACTS_SQL = {"hr": _hr_facts_sql(), "finance": _finance_facts_sql(), "ecommerce": _ecommerce_facts_sql(), "sales": _sales_facts_sql()}
_ID = {"hr": "N11", "finance": "N20", "ecommerce": "N40", "sales": "N60"}

for _domain in FACTS_SQL:
    @register(f"{_ID[_domain]}_{_domain}_facts", with_views(f"{FACTS_SQL[_domain]}\n{FACT_ROWS}", _domain))
    def _q_facts(spark, sf, domain=_domain):
        return _rounded_facts(dr.DOMAIN_FACTS[domain](VIEWS[domain](spark, sf), **ROLES[domain]))

    @register(f"{_ID[_domain]}_{_domain}_rules", with_views(
        f"{FACTS_SQL[_domain]}\n, {KNOWN}\n, said AS ({fired_sql(dr.DOMAIN_RULES[_domain])})\nSELECT CAST(place AS INTEGER) AS place, rule, kind, severity, text FROM said", _domain))
    def _q_rules(spark, sf, domain=_domain):
        return dr.domain_findings(VIEWS[domain](spark, sf), domain, **ROLES[domain])


# ---------------------------------------------------------------- D-17
def _context_sql(domain: str, more: str = "") -> str:
    return with_views(f"""{FACTS_SQL[domain].removesuffix(")")}{more})\n, {KNOWN}\n, said AS ({fired_sql(dr.CONTEXT_RULES[domain])})
SELECT rule AS metric, split_part(text, '|', 1) AS value, split_part(text, '|', 2) AS reference FROM said""", domain)


@register("D17_context_rows_hr", _context_sql(
    "hr", "\nUNION ALL SELECT 'hr', 'hr', 'satisfaction_median', quantile_cont(satisfaction, 0.5), NULL FROM people"))
def q_d17_hr(spark, sf):
    return dr.context_rows(hr_view(spark, sf), "hr", **ROLES["hr"])


@register("D17_context_rows_ecommerce", _context_sql("ecommerce"))
def q_d17_ecommerce(spark, sf):
    return dr.context_rows(ecommerce_view(spark, sf), "ecommerce", **ROLES["ecommerce"])


@register("D17_context_rows_sales", with_views("\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS metric, printf('%.2f', round(avg({c}), 2)) AS value, printf('median %.2f of these rows', round(quantile_cont({c}, 0.5), 2)) AS reference FROM sales" for c in METRICS), "sales"))
def q_d17_sales(spark, sf):
    return dr.context_rows(sales_view(spark, sf), "sales", METRICS)


# ---------------------------------------------------------------- forms that return rows on the given tables
@register("P1_filter_price_gt_lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 90000.0")
def q_p1_rows(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sel.filter_rows(rows, "l_extendedprice", ">", 90000)


#: A steep power of the price: right-skewed, with outliers, far from its median.
STEEP = ["steep", "l_quantity"]


@register("N80_general_insights_steep_price", """
WITH s AS (SELECT power(l_extendedprice / 10000.0, 6) AS v, CAST(l_quantity AS DOUBLE) AS q FROM lineitem)
, long AS (SELECT 'steep' AS "column", v FROM s UNION ALL SELECT 'l_quantity', q FROM s)
, a AS (SELECT "column", avg(v) AS m, stddev_samp(v) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) AS q3,
               quantile_cont(v, 0.9) AS p90, skewness(v) AS g, count(*) AS n FROM long GROUP BY 1)
, o AS (SELECT "column", count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) * 100.0 / max(n) AS op FROM long JOIN a USING ("column") GROUP BY 1)
SELECT 'insight' AS kind, "column", 'warning' AS severity FROM o WHERE op > 10
UNION ALL SELECT 'finding', "column", 'info' FROM a WHERE abs(g) > 1.5
UNION ALL SELECT 'opportunity', "column", 'opportunity' FROM a WHERE md > 0 AND p90 / md >= 2 AND sd / abs(m) * 100.0 > 40""")
def q_n80_rows(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.pow(F.col("l_extendedprice") / 10000.0, 6).alias("steep"), "l_quantity")
    return ins.general_insights(li, STEEP).select("kind", "column", "severity")
