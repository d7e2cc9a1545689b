"""Queries on places."""

import math

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import geo as G
from terraza.registry import query
from terraza.sources import adapter as A

WITH = f"WITH {A.LISTINGS_SQL}"
VALID = S.valid_coordinate_sql("lat", "lon")
LAT, LON = -12.15, -77.05
_distance = S.haversine_sql(f"{LAT}e0", f"{LON}e0", "lat", "lon")


@query("range_join_radius", f"{WITH} SELECT listing_id, {S.half_up_sql(_distance, 1)} AS metres FROM listings WHERE {VALID} AND {_distance} <= 1500")
def radius(spark, d):
    return G.within_radius(A.listings(spark, d, "listing_id", "lat", "lon"), LAT, LON, 1500).select("listing_id", "metres")


@query("haversine", f"{WITH} SELECT district, {S.half_up_sql(f'avg({_distance})', 1)} AS mean_metres, {S.half_up_sql(f'max({_distance})', 1)} AS farthest FROM listings GROUP BY 1")
def haversine(spark, d):
    x = S.haversine(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))
    return A.listings(spark, d, "district", "lat", "lon").groupBy("district").agg(S.half_up(F.avg(x), 1).alias("mean_metres"), S.half_up(F.max(x), 1).alias("farthest"))


_quadrant = f"""{WITH}, ok AS (SELECT * FROM listings WHERE {VALID}), mid AS (SELECT district, quantile_cont(lat, 0.5) AS mid_lat, quantile_cont(lon, 0.5) AS mid_lon FROM ok GROUP BY 1),
quad AS (SELECT o.listing_id, o.district, concat(CASE WHEN lat >= mid_lat THEN 'N' ELSE 'S' END, CASE WHEN lon < mid_lon THEN 'W' ELSE 'E' END) AS quadrant, price, ppm, agency FROM ok o JOIN mid m ON m.district = o.district)"""


@query("median_split_quadrant", f"{_quadrant} SELECT listing_id, district, quadrant FROM quad")
def quadrant(spark, d):
    return G.quadrants(A.listings(spark, d, "listing_id", "district", "lat", "lon")).select("listing_id", "district", "quadrant")


@query("agg_quadrant_reading", f"{_quadrant} SELECT district, quadrant, count(*) AS observed, count(DISTINCT agency) AS agencies, count(ppm) AS \"references\", {S.half_up_sql('quantile_cont(ppm, 0.5)', 2)} AS median_ppm FROM quad GROUP BY 1, 2")
def quadrant_reading(spark, d):
    return G.quadrant_reading(A.listings(spark, d, "listing_id", "district", "lat", "lon", "agency", "ppm"))


@query("rank_high_load", f"{WITH} SELECT district_id, count(*) AS projects, CAST(row_number() OVER (ORDER BY count(*) DESC, district_id) AS INTEGER) AS rank FROM listings WHERE {VALID} GROUP BY 1 ORDER BY rank LIMIT 7")
def high_load(spark, d):
    return G.high_load(A.listings(spark, d, "listing_id", "district_id", "lat", "lon"))


#: A square with a square hole, as (x, y) rings.
RINGS = [[(-77.09005, -12.19005), (-77.03005, -12.19005), (-77.03005, -12.12005), (-77.09005, -12.12005)], [(-77.07005, -12.17005), (-77.05005, -12.17005), (-77.05005, -12.15005), (-77.07005, -12.15005)]]


@query("point_in_square", f"{WITH} SELECT listing_id FROM listings WHERE lon BETWEEN -77.09005e0 AND -77.03005e0 AND lat BETWEEN -12.19005e0 AND -12.12005e0 AND NOT (lon BETWEEN -77.07005e0 AND -77.05005e0 AND lat BETWEEN -12.17005e0 AND -12.15005e0)")
def polygon(spark, d):
    return A.listings(spark, d, "listing_id", "lat", "lon").where(G.in_polygon(F.col("lon"), F.col("lat"), RINGS)).select("listing_id")


_cos = math.cos(math.radians(LAT))


@query("metric_projection", f"{WITH} SELECT listing_id, {S.half_up_sql(f'radians(lon - {LON}e0) * {_cos!r} * {S.EARTH_M}e0', 2)} AS x, {S.half_up_sql(f'radians(lat - {LAT}e0) * {S.EARTH_M}e0', 2)} AS y FROM listings")
def projection(spark, d):
    return G.metric_projection(A.listings(spark, d, "listing_id", "lat", "lon"), LAT, LON)


@query("valid_coordinate", f"{WITH} SELECT district, count(*) FILTER ({VALID}) AS valid, count(*) AS n FROM listings GROUP BY 1")
def valid(spark, d):
    return A.listings(spark, d, "district", "lat", "lon").groupBy("district").agg(F.count_if(S.valid_coordinate(F.col("lat"), F.col("lon"))).alias("valid"), F.count("*").alias("n"))
