"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash and ranked; row r (from 0) of a
source with n rows gets the fractional rank (r + u) / n, where u is a seeded offset of the
source in [0, 1).  All rows are sorted by fractional rank and cut into shards of
equal counts (law ``rows``: at most one apart), so each stretch of the order holds every
source in its share of the whole.

No source is ranked in one task: hashes are uniform, so their leading bits divide a
source evenly, and the rank is the place within such a part plus the sizes of the parts
before.  The global order is numbered in the same way over parts of the fractional rank,
which is even by construction.  Results do not depend on the number of parts.

Rows are dealt one by one; rows with equal texts are not kept together, for a group
may be larger than a shard of equal count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, pick

UNIT = 1 << 40


def _digest(*parts: Column) -> Column:
    """Hexadecimal MD5, so that any engine can shuffle the rows alike."""
    return F.md5(F.concat(*parts).cast("binary"))


def _leading_bits(digest) -> Column:
    """The first 40 bits of a hexadecimal digest as a number below ``UNIT``."""
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("long")


def _ranked(df: DataFrame, keys: list[str], part: str, order: list) -> DataFrame:
    """0-based ``rank`` per ``keys`` by (``part``, ``order``), with no task holding a whole key."""
    sizes = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    on = [*keys, part]
    local = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    return df.withColumn("_r", local).join(offsets, on).withColumn("rank", F.col("_off") + F.col("_r") - 1).drop("_r", "_off")


def interleave(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               shards: int = 16, seed: int = 42) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per input row.

    A null source is a source of its own; a null text has size 1 and no crc32.  Equal rows
    (id, source and text alike) are interchangeable, so the result is the same on every run.
    """
    d = pick(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        _digest(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"),
                F.coalesce("text", F.lit(""))).alias("h"))
    d = materialize(d, "dealt")
    parts = 4 * partitions(d.sparkSession)
    cut = F.floor(_leading_bits("h") * parts / F.lit(float(UNIT))).cast("int")
    first = _ranked(d.withColumn("part", cut), ["source", "no_source"], "part", ["h", "doc_id", "size", "text_crc32"])
    n = d.groupBy("source", "no_source").agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("no_source"), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    offset = _leading_bits(_digest(F.lit(f"{seed}|"), named)) / F.lit(float(UNIT))
    spread = (first.drop("part").withColumnRenamed("rank", "r").join(n, ["source", "no_source"])
              .withColumn("at", (F.col("r") + offset) / F.col("n"))
              .withColumn("part", F.least(F.floor(F.col("at") * parts), F.lit(parts - 1)).cast("int")))
    placed = _ranked(spread.withColumn("all", F.lit(0)), ["all"], "part", ["at", "source", "no_source", "r"])
    total = d.count()
    # integer arithmetic: the first rank of shard s is the ceiling of s * total / shards
    shard = F.expr(f"cast((rank * {shards}L) div {max(total, 1)}L as int)")
    start = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return (placed.withColumn("shard", shard)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    F.when(~F.col("no_source"), F.col("source")).alias("source")))
