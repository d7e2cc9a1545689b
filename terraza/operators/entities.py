"""Entities: matching by keys that are unique on both sides, registries, tiers and pilots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.functions import semantics as S


def alias_join(df: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """The agency of each source name; null is unresolved."""
    return df.select("*", S.words(name).alias("alias")).join(aliases, "alias", "left")


def tier(deep: Column, enriched: Column) -> Column:
    return F.when(deep, "deep").when(enriched, "enriched").otherwise("base")


def pilot(candidates: DataFrame, mandatory: Column, size: int, *order: Column) -> DataFrame:
    """Mandatory candidates first, filled up by order to a size, and ranked by order alone."""
    chosen = candidates.withColumn("mandatory", F.coalesce(mandatory, F.lit(False))).orderBy(F.desc("mandatory"), *order).limit(size)
    return chosen.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # of at most size rows


def signatures(facts: DataFrame) -> DataFrame:
    """A digest of each listing's facts that is the same for equal sets of facts in any order."""
    text = F.concat_ws("|", "semantic_type", "unit", F.format_string("%.2f", F.col("value")))
    return facts.groupBy("listing_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(text)), ";"), 256).alias("signature"))


def modal(df: DataFrame, by: str, value: str) -> DataFrame:
    """The commonest value of each group; ties go to the first by name."""
    own = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return own.groupBy(by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def worst_quality(facts: DataFrame) -> DataFrame:
    """The worst quality of each listing's facts."""
    rank = F.when(F.col("quality") == "reviewable", 0).otherwise(1)
    return facts.groupBy("listing_id").agg(F.when(F.min(rank) == 0, "reviewable").otherwise("certified").alias("quality"))
