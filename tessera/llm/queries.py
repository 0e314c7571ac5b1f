"""The training-data operators as queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (op1_substring, op2_langid, op3_html, op4_simhash, op5_licenses, op6_sharding, op7_embeddings, op8_secrets, op9_bpe,
               op10_decontaminate, op11_fim, op12_neighbours, op13_whitening, oracles)
from .common import ship, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op1_substring.remove_repeats(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op2_langid.identify_language(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op3_html.extract_articles(table(spark, sf_dir, "pages"))


def op4_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op4_simhash.simhash_near_dups(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op5_licenses.license_report(table(spark, sf_dir, "documents"))


def op6_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op6_sharding.interleave(table(spark, sf_dir, "documents"))


def op7_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op7_embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op8_secrets.secret_report(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op9_bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op10_decontaminate.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op11_fim.fim_report(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op12_neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op13_whitening_polarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return op13_whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_html_extraction, op4_simhash_near_dups, op5_license_scan,
                                   op6_interleaved_shards, op7_embedding_near_dups, op8_secret_scan, op9_byte_bpe, op10_decontamination,
                                   op11_fill_in_middle, op12_nearest_neighbours, op13_whitening_polarised)}
ORACLE: dict[str, str] = oracles.SQL
