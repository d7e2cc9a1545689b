"""Geography: radius scope, quadrants, polygons and the highest-load districts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.functions.quantiles import exact
from terraza.sources.scratch import written


def within_radius(df: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Listings within the radius, its border included; a bounding box that the scan can test comes first."""
    dlat = math.degrees(metres / S.EARTH_M) * 1.001
    dlon = dlat / max(0.01, math.cos(math.radians(lat)))
    near = df.where(S.valid_coordinate(F.col("lat"), F.col("lon")) & F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon))
    distance = S.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return near.withColumn("metres", S.half_up(distance, 1)).where(distance <= metres)


def quadrants(df: DataFrame) -> DataFrame:
    """Each district's medians of valid points part it into four; a point on a median lies north or east."""
    own = written(df.where(S.valid_coordinate(F.col("lat"), F.col("lon"))), "points")
    lat, lon = (exact(own, ["district"], c, 0.5).select("district", F.col("q")[0].alias(f"mid_{c}")) for c in ("lat", "lon"))
    middle = lat.join(lon, "district")
    side = F.concat(F.when(F.col("lat") >= F.col("mid_lat"), "N").otherwise("S"), F.when(F.col("lon") < F.col("mid_lon"), "W").otherwise("E"))
    return own.join(F.broadcast(middle) if middle.count() <= 10_000 else middle, "district").withColumn("quadrant", side).drop("mid_lat", "mid_lon")


def quadrant_reading(df: DataFrame) -> DataFrame:
    own = written(quadrants(df).select("district", "quadrant", "agency", "ppm"), "quadrants")
    middle = exact(own, ["district", "quadrant"], "ppm", 0.5).select("district", "quadrant", S.half_up(F.col("q")[0], 2).alias("median_ppm"))
    counts = own.groupBy("district", "quadrant").agg(F.count("*").alias("observed"), F.countDistinct("agency").alias("agencies"), F.count("ppm").alias("references"))
    return counts.join(middle, ["district", "quadrant"], "left")


def high_load(df: DataFrame, n: int = 7) -> DataFrame:
    """The n districts with most listings at valid coordinates; ties by id."""
    own = df.where(S.valid_coordinate(F.col("lat"), F.col("lon"))).groupBy("district_id").agg(F.count("*").alias("projects")).orderBy(F.desc("projects"), "district_id").limit(n)
    return own.withColumn("rank", F.row_number().over(W.orderBy(F.desc("projects"), "district_id")))


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]], eps: float = 1e-12) -> Column:
    """Even-odd test against a ring of (x, y); its border is inside."""
    crossings, border = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ax, ay) == (bx, by):
            continue
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        border = border | (F.pow(x - (ax + t * (bx - ax)), 2) + F.pow(y - (ay + t * (by - ay)), 2) <= eps * eps)
        if ay != by:
            crossings = crossings + (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).cast("int")
    return border | (crossings % 2 == 1)


def in_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Inside the first ring and not strictly inside, nor on the border of, a hole."""
    out = in_ring(x, y, rings[0])
    for hole in rings[1:]:
        out = out & ~in_ring(x, y, hole)
    return out


def metric_projection(df: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Local equirectangular metres from an origin."""
    x = F.radians(F.col("lon") - lon0) * math.cos(math.radians(lat0)) * S.EARTH_M
    y = F.radians(F.col("lat") - lat0) * S.EARTH_M
    return df.select("listing_id", S.half_up(x, 2).alias("x"), S.half_up(y, 2).alias("y"))
