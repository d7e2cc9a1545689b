"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, language, licences, packing, pages, quality, ranked, sharding, tokencounts, toxicity, vectors, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.op3(_table(spark, sf_dir, "pages"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op4(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op5(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op6(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op7(_table(spark, sf_dir, "documents"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.op8(_table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.op9(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op10(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11(_table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.op12(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op13(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_quality, op3_main_text, op4_licences, op5_packing, op6_language, op7_ngram_jaccard, op8_vector_dedup, op9_token_counts, op10_toxicity,
        op11_whitening, op12_ranked_search, op13_sharding,
    )
}
ORACLE_SQL: dict[str, str] = {"op12_ranked_search": ranked.SQL}
