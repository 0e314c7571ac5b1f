"""Text quality gate (P-12), re-aimed from generated narratives to a text
column: every document is checked in full, JVM-side (``lower`` +
``contains``), for minimum length, blocked filler phrases, invented-metric
phrases and per-domain contamination phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's -------------------------
MIN_TEXT_LENGTH = 40
INVALID_OUTPUTS = ("nan%", " nan ", "nan\n", "0% gap requiring attention", "0.0% gap requiring attention",
                   "chart generated from dataset", "evenly distributed — no single group dominates",
                   "powered by groq", "groq llama", "this is an important metric", "data shows patterns",
                   "analysis complete")
FAKE_PHRASES = ("customer satisfaction and sales revenue", "sales revenue tends to increase",
                "marketing spend and website traffic", "top-line growth", "sales targeted",
                "customer-centric initiatives", "as customer satisfaction increases", "net promoter score",
                "website traffic", "marketing spend")
DOMAIN_BLOCKS = {
    "ecommerce": ("employee attrition", "satisfaction score", "workforce left", "employees left", "salary band",
                  "hr department"),
    "sales": ("employee attrition", "satisfaction_level", "work accident"),
    "finance": ("employee attrition", "satisfaction_level", "order quantity"),
}
# ---------------------------------------------------------------------------


def _first_hit(low: Column, phrases) -> Column:
    e = F.lit(None).cast("string")
    for p in reversed(phrases):
        e = F.when(low.contains(p), F.lit(p)).otherwise(e)
    return e


def text_quality_gate(df: DataFrame, text_col: str, domain: str | None = None,
                      id_col: str | None = None) -> DataFrame:
    """P-12: ``passed`` plus the first failing ``reason`` for every row."""
    t = F.col(text_col)
    stripped = F.regexp_replace(t, r"^\s+|\s+$", "")
    low = F.lower(t)
    bad = _first_hit(low, INVALID_OUTPUTS)
    fake = _first_hit(low, FAKE_PHRASES)
    dom = _first_hit(low, DOMAIN_BLOCKS.get(domain or "", ()))
    reason = (F.when(t.isNull() | (F.length(stripped) < MIN_TEXT_LENGTH), F.lit("too short"))
               .when(bad.isNotNull(), F.concat(F.lit("blocked phrase: "), bad))
               .when(fake.isNotNull(), F.concat(F.lit("invented metric: "), fake))
               .when(dom.isNotNull(), F.concat(F.lit("domain contamination: "), dom)))
    keep = [F.col(id_col)] if id_col else []
    return df.select(*keep, F.length(t).alias("n_chars"), reason.isNull().alias("passed"), reason.alias("reason"))


def gate_summary(gated: DataFrame) -> DataFrame:
    """Counts per outcome (reason kind)."""
    kind = F.coalesce(F.regexp_extract(F.col("reason"), r"^([a-z ]+)", 1), F.lit("passed"))
    return gated.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
