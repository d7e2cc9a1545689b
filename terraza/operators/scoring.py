"""Weighted comparability with a target product: six components, each available only where its value is known."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.functions import semantics as S

# The weight of each component, and the score from which a label holds.
WEIGHTS = {"geography": 30, "area": 20, "bedrooms": 15, "typology": 10, "delivery": 10, "ppm": 15}
HIGH, MEDIUM, COVERAGE = 80, 60, 60


@dataclass(frozen=True)
class Target:
    lat: float
    lon: float
    radius: float
    area: float
    bedrooms: int
    typology: str
    delivery_year: int
    ppm: float


def score(df: DataFrame, t: Target) -> DataFrame:
    """Components rounded to a tenth before they are summed; the score is what was earned of what was available, in per cent."""
    clamp = lambda x: F.greatest(F.lit(0.0), x)
    distance = S.haversine(F.lit(t.lat), F.lit(t.lon), F.col("lat"), F.col("lon"))
    parts = {
        "geography": F.when(distance.isNotNull(), clamp(1 - distance / t.radius)),
        "area": F.when(F.col("area") > 0, clamp(1 - F.abs(F.col("area") - t.area) / t.area)),
        "bedrooms": F.when(F.col("bedrooms_min").isNotNull(), F.when(F.lit(t.bedrooms).between(F.col("bedrooms_min"), F.col("bedrooms_max")), 1.0).otherwise(0.0)),
        "typology": F.when(F.col("typology").isNotNull(), F.when(F.col("typology") == t.typology, 1.0).otherwise(0.0)),
        "delivery": F.when(F.col("delivery_year").isNotNull(), clamp(1 - F.abs(F.col("delivery_year") - t.delivery_year) / 2)),
        "ppm": F.when(F.col("ppm") > 0, clamp(1 - F.abs(F.col("ppm") - t.ppm) / t.ppm)),
    }
    points = {k: S.round_away(v * WEIGHTS[k], 1) for k, v in parts.items()}
    out = df.select("listing_id", *(v.alias(k) for k, v in points.items()))
    earned = sum((F.coalesce(k, F.lit(0.0)) for k in points), F.lit(0.0))
    weight = sum((F.when(F.col(k).isNotNull(), WEIGHTS[k]).otherwise(0) for k in points), F.lit(0))
    out = out.withColumn("weight", weight).withColumn("score", F.when(F.col("weight") > 0, S.round_away(earned / F.col("weight") * 100, 1)))
    label = F.when(F.col("weight") < COVERAGE, "Insuficiente").when(F.col("score") >= HIGH, "Alta").when(F.col("score") >= MEDIUM, "Media").otherwise("Baja")
    return out.withColumn("label", label)


def ranked(scores: DataFrame, n: int) -> DataFrame:
    """The n best, by score, weight and id."""
    order = (F.desc_nulls_last("score"), F.desc("weight"), "listing_id")
    return scores.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def coverage(scores: DataFrame) -> DataFrame:
    mean = F.avg("weight")
    return scores.agg(S.round_away(mean, 1).alias("mean_weight"), F.when(mean >= 80, "ready").when(mean >= 60, "orientative").otherwise("insufficient").alias("status"))
