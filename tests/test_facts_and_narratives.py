"""Chart facts of every kind, domain rules and context rows: each rule fires on the facts it names, and only there."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import chart_facts as cf
from tessera.operators import domain_rules as dr
from tessera.operators.rules import FACTS, HIGH, fired

SETS = {"charts": cf.CHART_RULES, **dr.DOMAIN_RULES, **{f"context {k}": v for k, v in dr.CONTEXT_RULES.items()}}


@pytest.mark.parametrize("name", SETS)
def test_every_rule_fires_and_does_not(spark, name):
    rules = SETS[name]
    assert len({r.name for r in rules}) == len(rules)
    rows, wanted, unwanted = [], set(), set()

    def subject(rule, label, values):
        rows.extend((rule.scope, f"{rule.name}|{label}", f, float(v), None) for f, v in values.items())

    for r in rules:
        met = {f: lo if lo != -HIGH else hi if hi != HIGH else 0.0 for f, lo, hi in r.conditions}
        subject(r, "lower end", met)
        subject(r, "upper end", {f: hi if hi != HIGH else lo if lo != -HIGH else 0.0 for f, lo, hi in r.conditions})
        wanted |= {(r.name, f"{r.name}|lower end"), (r.name, f"{r.name}|upper end")}
        for f, lo, hi in r.conditions:
            others = {k: v for k, v in met.items() if k != f}
            subject(r, f"without {f}", {**others, "unrelated": 1})
            unwanted.add((r.name, f"{r.name}|without {f}"))
            for label, end, to in (("under", lo, -math.inf), ("over", hi, math.inf)):
                if abs(end) != HIGH:
                    subject(r, f"{label} {f}", {**others, f: math.nextafter(end, to)})
                    unwanted.add((r.name, f"{r.name}|{label} {f}"))
        rows.extend(("elsewhere", f"{r.name}|other scope", f, float(v), None) for f, v in met.items())
    got = fired(spark.createDataFrame(rows, FACTS), rules).collect()
    pairs = {(r["rule"], r["column"]) for r in got}
    assert wanted <= pairs and not unwanted & pairs and all(r["text"] for r in got)
    assert not any(r["column"].endswith("other scope") for r in got)


def _facts(df, specs, metrics=None):
    return {(r["column"], r["fact"]): r["label"] if r["label"] is not None else r["value"] for r in cf.chart_facts(df, specs, metrics).collect()}


def _spec(chart_id, chart_type, x=None, y=None):
    return {"chart_id": chart_id, "chart_type": chart_type, "title": chart_id, "x": x, "y": y}


def test_facts_of_each_kind_by_hand(spark):
    rows = [("a", "2020-01", 10.0), ("a", "2020-02", 30.0), ("b", "2020-03", 5.0), ("b", None, 5.0), (None, "2020-03", 100.0), ("c", "2020-04", None), ("d", "2020-05", 20.0)]
    df = spark.createDataFrame(rows, "g string, p string, v double").withColumn("w", F.col("v") * 2).withColumn("u", -F.col("v"))
    f = _facts(df, [_spec("bar", "bar", "g", "v"), _spec("pie", "pie", "g", "v"), _spec("hist", "histogram", "v"), _spec("line", "line", "p", "v"),
                    _spec("m1", "heatmap"), _spec("m2", "heatmap")], ["v", "w", "u"])
    # ties: a and d both average 20
    assert (f["bar", "top"], f["bar", "top_value"], f["bar", "worst"], f["bar", "n_groups"]) == ("d", 20.0, "b", 3.0)
    assert f["bar", "avg_value"] == pytest.approx(170 / 6) and f["bar", "n_above_avg"] == 0 and f["bar", "gap_pct"] == pytest.approx(300)
    assert (f["pie", "top"], f["pie", "n_segments"], f["pie", "balanced"]) == ("a", 3.0, 0.0) and f["pie", "top_share"] == pytest.approx(20 / 45 * 100)
    assert f["pie", "top2_share"] == pytest.approx(40 / 45 * 100)
    assert (f["hist", "median"], f["hist", "shape"], f["hist", "use_stat"], f["hist", "use_value"]) == (15.0, "right-skewed", "median", 15.0)
    # periods: 10, 30, 52.5, 20; halves 20 and 36.25
    assert f["line", "n_periods"] == 4 and f["line", "change_pct"] == pytest.approx(81.25) and f["line", "max"] == 52.5
    assert ("m1", "n_pairs") not in f or f["m1", "n_pairs"] == f["m2", "n_pairs"] == 0  # six values are too few for a pair


def test_empty_null_and_nonfinite_values(spark):
    specs = [_spec("bar", "bar", "g", "v"), _spec("pie", "pie", "g", "v"), _spec("hist", "histogram", "v"), _spec("line", "line", "p", "v")]
    schema = "g string, p date, v double, scope string, fact string, chart string"
    for rows in ([], [("a", None, None, "x", "y", "z")], [("a", None, float("nan"), "x", "y", "z"), ("b", None, float("inf"), "x", "y", "z")]):
        df = spark.createDataFrame(rows, schema)
        assert cf.chart_facts(df, specs).count() == 0 and cf.narratives(df, specs).count() == 0
    one = spark.createDataFrame([("a", None, 1.0, "x", "y", "z")], schema)
    f = _facts(one, specs)
    assert f["bar", "gap_pct"] == 0 and f["pie", "top_share"] == f["pie", "top2_share"] == 100 and f["hist", "shape"] == "symmetric" and ("line", "mean") not in f
    said = {r["chart_id"]: r["narrative"] for r in cf.narratives(one, specs, "hr").collect()}
    assert set(said) == {"bar", "pie", "hist"} and "employees" in said["hist"] and "employees" not in said["bar"]
    assert cf.chart_facts(one, []).count() == 0


def test_titles_choose_kind_and_columns():
    numeric, categorical = ["monthly_hours", "satisfaction"], ["dept", "salary_band"]
    got = lambda t, **k: (s := cf.spec_of_title(t, numeric, categorical, **k)) and (s["chart_type"], s["x"], s["y"])
    assert got("Avg Satisfaction by Salary Band") == ("bar", "salary_band", "satisfaction")
    assert got("Distribution of Monthly Hours") == ("histogram", "monthly_hours", None)
    assert got("Satisfaction Share by Dept") == ("pie", "dept", "satisfaction")
    assert got("Satisfaction Over Time", period="month") == ("line", "month", "satisfaction") and got("Satisfaction Trend") is None
    assert got("Correlation distribution heatmap") == ("heatmap", None, None)  # the first word that is known decides
    assert got("Anything") == ("bar", "dept", "monthly_hours") and cf.spec_of_title("Anything", numeric, [])["chart_type"] == "histogram"
    assert cf.spec_of_title("Anything", [], categorical) is None and cf.spec_of_title("Heatmap", ["x"], []) is None


def test_one_chart_of_a_hot_group_is_one_row_before_the_join(spark):
    """Half a million rows of one group are combined before the shuffle: the plan aggregates partially on (chart, dim)."""
    df = spark.range(500_000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("v"))
    plan = cf.chart_facts(df, [_spec("bar", "bar", "g", "v")])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_domain_facts_without_roles_and_on_empty_tables(spark):
    schema = {"hr": "left string, dept string, salary string, satisfaction double, hours double, projects double, evaluation double, promotion int",
              "finance": "rev double, cost double, profit double, budget double, actual double, opex double, period string, cat string",
              "ecommerce": "rating double, category string, price double, discount double", "sales": "rev double, target double, region string, product string, margin double"}
    for domain, s in schema.items():
        df = spark.createDataFrame([], s)
        roles = {c.split()[0]: c.split()[0] for c in s.split(", ")}
        assert {r["kind"] for r in dr.domain_findings(df, domain).collect()} <= {"action"}
        assert {r["kind"] for r in dr.domain_findings(df, domain, **roles).collect()} <= {"action"}


def test_hr_findings_follow_the_table(spark):
    df = spark.range(1000).select(
        F.when((F.col("id") % 10 < 4) & (F.col("id") % 2 == 0), "Yes").otherwise("no").alias("left"), F.when(F.col("id") % 2 == 0, "even|odd").otherwise("b").alias("dept"),
        F.lit(0.9).alias("satisfaction"), F.lit(250.0).alias("hours"))
    got = {r["rule"]: r["text"] for r in dr.domain_findings(df, "hr", left="left", dept="dept", satisfaction="satisfaction", hours="hours").collect()}
    assert {"attrition_crisis", "department_crisis", "department_risk", "satisfaction_strong", "overwork_critical", "act_flight_risk"} <= set(got)
    assert not {"overwork", "department_gap", "satisfaction_crisis", "act_pay", "salary_band", "project_load"} & set(got)
    rows = {r["metric"]: (r["value"], r["reference"]) for r in dr.context_rows(df, "hr", left="left", dept="dept", satisfaction="satisfaction").collect()}
    assert rows["attrition rate"][0] == "20.0%" and rows["attrition by department"] == ("0.0% to 40.0%", "best b, worst even|odd")
    with pytest.raises(ValueError):
        dr.context_rows(df, "weather")


def test_story_confidence_follows_the_domain_score(spark):
    from tessera.operators import insights as ins
    from tessera.operators.roles import detect_domain
    nothing = spark.createDataFrame([], ins.INSIGHT_SCHEMA)
    many = spark.range(300)
    known = many.select(*[F.col("id").cast("double").alias(c) for c in ("satisfaction", "salary", "department", "left", "promotion", "attrition", "employee")])
    assert detect_domain(known.columns)[1] > 0.15
    story = lambda df: ins.story(df, [df.columns[0]], "hr", nothing).first()["confidence"]
    assert story(known) == "high" and story(known.limit(100)) == "medium" and story(many.withColumnRenamed("id", "zz")) == "low"


def test_domain_kpis_fall_back_for_missing_roles_only(spark, monkeypatch):
    from tessera.operators.domains import dispatch
    df = spark.createDataFrame([("Yes", 0.5, 2.0, 0.7), ("no", 0.9, 4.0, 0.6)], "left string, satisfaction double, tenure double, evaluation double")
    assert dispatch.domain_kpis(df, "hr")[0] == "hr" and dispatch.domain_kpis(df, "hr")[1].count() > 0
    assert dispatch.domain_kpis(df.drop("tenure"), "hr")[0] == "general" and dispatch.domain_kpis(df, "sales")[0] == "general"
    words = df.withColumn("satisfaction", F.lit("high"))
    name, kpis = dispatch.domain_kpis(words, "hr")
    assert name == "general" and kpis.count() == 4

    def broken(*_):
        raise RuntimeError("not to be hidden")

    monkeypatch.setitem(dispatch.ROLES, "hr", (broken, dispatch.ROLES["hr"][1]))
    with pytest.raises(RuntimeError):
        dispatch.domain_kpis(df, "hr")
