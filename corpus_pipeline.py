"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraza.llm import decontaminate, jaccard, language, packing, toxicity
from terraza.llm.shared import written

TOXIC = 0.5  #: score from which a document is rejected: where the fit, in which both classes weigh the same, holds it for toxic
SURE = 0.4  #: probability of its language below which a document is rejected


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; a null text has the score of an empty one.

    Rows are judged one by one, so repeated ids, extra columns and texts of any length need no rule; a score of TOXIC itself rejects.
    Without labels, or with one class only, all or none go; an empty table stays empty.
    """
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(machine) < TOXIC)


def unknown_languages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null ones among them, and those that resemble no learned language go.

    Rows are judged one by one. Where no row names a language nothing is learned and all go; an empty table stays empty.
    """
    found = language.predict(language.fit(docs))
    return docs.withColumn("_found", found).where((F.col("_found.lang_pred") != "und") & (F.col("_found.score") >= SURE)).drop("_found")


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays, once; documents without an id stay.

    Of rows with one id in one component the text with the least hash stays, and one row of those with equal texts. A text without
    words is alone. An empty table stays empty; extra columns are kept.
    """
    return jaccard.without_near_copies(docs)


def test_items_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, question and answer, go.

    Rows are judged one by one; a null text holds nothing. Without items all stay; an empty table stays empty.
    """
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, dealt to windows; a null text is its end id alone. An empty table gives no pieces."""
    return packing.op5(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("language", unknown_languages_go),
    ("near duplicates", near_duplicates_go),
    ("decontamination", test_items_go),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what each stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
