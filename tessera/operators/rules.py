"""Rules as data: long facts met with a table of conditions in one pass.

A fact is ``(scope, column, fact, value, label)``: what was measured, on what.  A rule is a set of
conditions ``fact in [low, high]``; it fires for a (scope, column) that meets them all.  Facts
come from Spark aggregates, the rule table is a few fixed rows and is broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTS = "scope string, column string, fact string, value double, label string"
HIGH = 1.7976931348623157e308


@dataclass(frozen=True)
class Rule:
    """``conditions``: (fact, low, high), ends included; ``text`` names facts as {fact} or {fact.label};
    ``kind`` (insight, risk, finding, opportunity, action) and ``severity`` are handed on."""
    name: str
    scope: str
    conditions: tuple[tuple[str, float, float], ...]
    text: str
    kind: str = "finding"
    severity: str = "info"


def above(x: float) -> float:
    """The smallest number greater than ``x``: a condition's ends are included."""
    return math.nextafter(x, math.inf)


def below(x: float) -> float:
    return math.nextafter(x, -math.inf)


def facts(df: DataFrame, scope: str, column: Column, **values: Column) -> DataFrame:
    """Unpivot the columns of ``df`` into facts of ``scope``; a string column becomes a label."""
    kinds = df.select(*[c.alias(k) for k, c in values.items()]).schema
    items = []
    for k, c in values.items():
        text = kinds[k].dataType.typeName() == "string"
        items.append(F.struct(F.lit(k).alias("fact"), (F.lit(None) if text else c).cast("double").alias("value"),
                              (c if text else F.lit(None)).cast("string").alias("label")))
    return df.select(F.lit(scope).alias("scope"), column.cast("string").alias("column"), F.explode(F.array(*items)).alias("f")).select("scope", "column", "f.*")


def fired(all_facts: DataFrame, rules: list[Rule], shared: dict[str, float] | None = None) -> DataFrame:
    """``(place, rule, scope, column, kind, severity, text)``: every rule with every subject that meets all its
    conditions.  ``shared`` facts hold for every subject.  The facts are read once: a subject's few facts become
    a map, which meets the rules of its scope."""
    spark = all_facts.sparkSession
    table = spark.createDataFrame([(i, r.name, r.scope, r.kind, r.severity, [(f, float(lo), float(hi)) for f, lo, hi in r.conditions]) for i, r in enumerate(rules)],
                                  "place int, rule string, scope string, kind string, severity string, conditions array<struct<fact:string,low:double,high:double>>")
    entry = F.struct("fact", F.struct("value", "label").alias("f"))
    extra = [F.struct(F.lit(f).alias("fact"), F.struct(F.lit(float(v)).alias("value"), F.lit(None).cast("string").alias("label")).alias("f"))
             for f, v in (shared or {}).items()]
    entries = F.concat(F.collect_list(entry), F.array(*extra)) if extra else F.collect_list(entry)
    known = all_facts.groupBy("scope", "column").agg(F.map_from_entries(entries).alias("k"))
    held = F.forall("conditions", lambda c: F.element_at("k", c["fact"])["value"].between(c["low"], c["high"]))
    sentence = reduce(lambda out, r: F.when(F.col("rule") == r.name, _sentence(r.text)).otherwise(out), rules, F.lit(None).cast("string"))
    return known.join(F.broadcast(table), "scope").where(held).select("place", "rule", "scope", "column", "kind", "severity", sentence.alias("text"))


def _sentence(text: str) -> Column:
    """``{fact}`` with 2 decimals, ``{fact:4}`` with 4, ``{fact.label}`` as it is, ``{column}`` the subject."""
    parts: list[Column] = []
    for i, piece in enumerate(text.replace("}", "{").split("{")):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece == "column":
            parts.append(F.col("column"))
        elif piece.endswith(".label"):
            parts.append(F.coalesce(F.col("k")[piece[:-6]]["label"], F.lit("")))
        else:
            name, _, digits = piece.partition(":")
            value = F.col("k")[name]["value"]
            parts.append(F.when(value.isNull(), "").otherwise(F.format_string(f"%.{digits or 2}f", value)))
    return F.concat(*parts)


#: Dataset insights and recommended analyses of the statistics screen.
STATISTICS_RULES = [
    Rule("skewed", "numeric", (("abs_skew", 1.0000000001, HIGH),),
         "{column} is {skew_label.label} (skew {skew}): prefer the median {median} to the mean {mean}"),
    Rule("non_normal", "numeric", (("non_normal", 1, 1),), "{column} is not normal ({test.label}): use non-parametric tests"),
    Rule("linked", "pair", (("significant", 1, 1), ("rank", 1, 3)), "{column}: {strength.label} {direction.label} relationship (r {r}), worth modelling"),
    Rule("high_cardinality", "dataset", (("n_high_cardinality", 1, HIGH),), "{n_high_cardinality:0} column(s) are nearly unique: leave them out of groupings"),
    Rule("missing", "dataset", (("n_missing_columns", 1, HIGH),), "{n_missing_columns:0} column(s) have missing values: impute by their shape"),
]
RECOMMENDED = [
    Rule("regression", "dataset", (("n_numeric", 2, HIGH), ("n_strong", 1, HIGH)), "strong correlations"),
    Rule("rank tests", "dataset", (("n_non_normal", 1, HIGH),), "non-normal columns"),
    Rule("group comparison", "dataset", (("n_categorical", 1, HIGH), ("n_numeric", 1, HIGH)), "categorical and numeric columns"),
    Rule("time series", "dataset", (("n_dates", 1, HIGH),), "date columns"),
    Rule("principal components", "dataset", (("n_numeric", 3, HIGH),), "three or more numeric columns"),
    Rule("exploration", "dataset", (("n_other", 0, 0),), "nothing else applies"),
]
