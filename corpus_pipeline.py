"""Training-data pipeline over ``documents``: five stages, each one of the library's operators.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.
All but the last return the columns of ``documents``:

1. language ID: documents without a letter (``und``) or below ``MIN_SCORE`` go;
2. SimHash near-dedup: the smallest id of each group of near copies stays, once (a null id only if
   the group has no other; of rows that share it, the one with the smallest key);
3. benchmark decontamination: documents that contain a benchmark item go;
4. secret scans: secrets are masked in the text (no document goes), ``n_chars`` follows;
5. byte-level BPE: token counts and digests of ids and decoded bytes.

Decisions go by row, not by id: null ids and ids that several rows share name no row, so each row
carries a key of all its columns. Only rows that are equal in every column share a decision.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op2_langid, op4_simhash, op8_secrets, op9_bpe, op10_decontaminate
from tessera.llm.common import materialize, ship, table

#: Mean probability of the best language below which a document is rejected; chance is 1 over the languages.
MIN_SCORE = 0.3
RANKS = "byte_bpe_50k.tiktoken"


def _keyed(docs: DataFrame) -> DataFrame:
    """``documents`` with ``__row``, a digest of all columns."""
    return docs.withColumn("__row", F.md5(F.to_json(F.struct("*")).cast("binary")))


def _with(keyed: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """Join rows to the keys of ``decisions`` (``left_semi`` or ``left_anti``)."""
    return keyed.join(decisions.select("__row").distinct(), "__row", how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = _keyed(docs)
    found = op2_langid.identify_language(rows, key_col="__row")
    rejected = found.where((F.col("lang_pred") == op2_langid.UNKNOWN) | (F.col("score") < MIN_SCORE))
    return _with(rows, rejected.withColumnRenamed("doc_id", "__row"), "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = _keyed(docs)
    # null ids come last
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("name"), "text")
    groups = op4_simhash.simhash_near_dups(named, id_col="name")
    first = groups.where(F.col("doc_id.__row") == F.col("component_id.__row")).select("doc_id.__row")
    return _with(rows, first, "left_semi").dropDuplicates(["__row"]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = _keyed(docs)
    leaks = op10_decontaminate.benchmark_leaks(rows, table(spark, sf_dir, "benchmark"), id_col="__row")
    return _with(rows, leaks.withColumnRenamed("doc_id", "__row"), "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    kind = docs.schema["n_chars"].dataType
    return op8_secrets.mask_secrets(docs).withColumn("n_chars", F.length("text").cast(kind))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return op9_bpe.bpe_round_trip(docs, public_tokenizers.path(RANKS))


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate),
          ("secret scans", secrets), ("byte-level BPE", encode)]

#: Recurrent networks, SimHash and BPE are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else materialize(out, f"stage{i}")
    return docs
