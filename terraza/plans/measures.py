"""Queries on measures."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import measures as M
from terraza.registry import query
from terraza.sources import adapter as A
from terraza.streaming import windows

WITH = f"WITH {A.LISTINGS_SQL}"
h, r = S.half_up_sql, S.ratio_sql
MEDIANS = f"{WITH}, mid AS (SELECT district, quantile_cont(ppm, 0.5) AS median_ppm, quantile_cont(area, 0.5) AS median_area FROM listings GROUP BY 1), beside AS (SELECT l.*, m.median_ppm, m.median_area FROM listings l JOIN mid m ON m.district = l.district)"


@query("price_per_m2", f"""{WITH}, s AS (SELECT *, CASE WHEN currency <> 'PEN' THEN 'currency_unknown' WHEN price IS NULL THEN 'price_missing' WHEN area IS NULL THEN 'area_missing' WHEN area <= 0 THEN 'area_not_positive' WHEN price <= 0 THEN 'price_not_positive' ELSE 'available' END AS status FROM listings)
SELECT listing_id, status, CASE WHEN status = 'available' THEN {h(r('price', 'area'), 2)} END AS price_m2 FROM s""")
def price_per_m2(spark, d):
    status, value = M.price_per_m2(F.col("price"), F.col("area"), F.col("currency"))
    return A.listings(spark, d, "listing_id", "price", "area", "currency").select("listing_id", status.alias("status"), value.alias("price_m2"))


@query("free_area", f"{WITH} SELECT listing_id, CASE WHEN area >= units * 20e0 THEN {h('area - units * 20e0', 2)} END AS free FROM listings")
def free_area(spark, d):
    return A.listings(spark, d, "listing_id", "area", "units").select("listing_id", M.free_area(F.col("area"), F.col("units") * 20.0).alias("free"))


@query("derive_price_delta", f"""{WITH}, b AS (SELECT listing_id, price, lag(price) OVER (PARTITION BY agency ORDER BY captured_at, listing_id) AS before FROM listings), g AS (SELECT *, {h('price - before', 2)} AS delta FROM b)
SELECT listing_id, delta, {h(r('delta * 100', 'before'), 2)} AS percent, CASE WHEN before = 0 THEN 'PERCENT_BASE_ZERO' WHEN before IS NULL OR delta IS NULL THEN 'UNAVAILABLE' END AS reason FROM g""")
def derive_price_delta(spark, d):
    return M.price_delta(A.listings(spark, d, "listing_id", "agency", "price", "captured_at"))


_share = r("(ppm - median_ppm)", "median_ppm")


@query("price_position_legacy", f"{MEDIANS} SELECT listing_id, CASE WHEN {_share} IS NULL THEN 'Sin dato' WHEN {_share} < -0.08e0 THEN 'Entrada' WHEN {_share} > 0.08e0 THEN 'Premium' ELSE 'Alineado' END AS position FROM beside")
def price_position(spark, d):
    return M.against_district(A.listings(spark, d, "listing_id", "district", "ppm", "area")).select("listing_id", M.position(F.col("ppm"), F.col("median_ppm")).alias("position"))


@query("competitive_reading", f"{MEDIANS} SELECT listing_id, CASE WHEN ppm IS NULL OR area IS NULL THEN 'unknown' ELSE concat(CASE WHEN ppm < median_ppm * 0.95e0 THEN 'cheaper' WHEN ppm > median_ppm * 1.08e0 THEN 'dearer' ELSE 'in line' END, CASE WHEN abs(area - median_area) / median_area > 0.12e0 THEN ', other area' ELSE '' END) END AS reading FROM beside")
def competitive_reading(spark, d):
    return M.against_district(A.listings(spark, d, "listing_id", "district", "ppm", "area")).select("listing_id", M.competitive_reading(F.col("ppm"), F.col("median_ppm"), F.col("area"), F.col("median_area")).alias("reading"))


_fit = "coalesce(area > 0 AND ppm > 0, false)"


@query("scatter_split", f"""{WITH}, own AS (SELECT * FROM listings WHERE area > 0 AND ppm > 0), mid AS (SELECT district, quantile_cont(ppm, 0.5) AS m FROM own GROUP BY 1)
SELECT o.district, count(*) AS n, count(*) FILTER (ppm < m) AS below, count(*) FILTER (ppm >= m) AS above FROM own o JOIN mid ON mid.district = o.district GROUP BY 1 HAVING count(*) >= 3""")
def scatter_split(spark, d):
    return M.scatter(A.listings(spark, d, "district", "ppm", "area"))


def _ends(c: str) -> str:
    low, high = (f"{f}(CASE WHEN {_fit} THEN {c} END)" for f in ("min", "max"))
    return f"{h(f'{low} + -1 * (({high} - {low}) * 0.08e0)', 2)} AS min_{c}, {h(f'{high} + 1 * (({high} - {low}) * 0.08e0)', 2)} AS max_{c}"


@query("positioning_model", f"{WITH} SELECT district, count(*) FILTER ({_fit}) AS plotted, count(*) FILTER (NOT {_fit}) AS omitted, {_ends('area')}, {_ends('ppm')} FROM listings GROUP BY 1")
def positioning_model(spark, d):
    return M.plot_domain(A.listings(spark, d, "district", "area", "ppm"))


def _place(x: str) -> str:
    return h(f"greatest(0e0, least(100e0, {r(f'(({x}) - greatest(1e0, low * 0.82e0)) * 100', '(high * 1.18e0 - greatest(1e0, low * 0.82e0))')}))", 1)


@query("range_gauge", f"{WITH}, g AS (SELECT district, min(ppm) AS low, max(ppm) AS high, quantile_cont(ppm, 0.5) AS median FROM listings WHERE ppm > 0 GROUP BY 1) SELECT district, {_place('low')} AS low_at, {_place('high')} AS high_at, {_place('median')} AS median_at, {_place('1500e0')} AS target_at FROM g")
def range_gauge(spark, d):
    return M.gauge(A.listings(spark, d, "district", "ppm"), 1500)


_step = "CASE WHEN raw <= unit THEN unit WHEN raw <= unit * 2 THEN unit * 2 WHEN raw <= unit * 5 THEN unit * 5 ELSE unit * 10 END"


@query("axis_ticks", f"{WITH}, g AS (SELECT district, max(area) - min(area) AS span FROM listings WHERE area > 0 GROUP BY 1 HAVING max(area) > min(area)), u AS (SELECT district, span / 5 AS raw, pow(10e0, floor(log10(span / 5))) AS unit FROM g) SELECT district, {h(_step, 6)} AS step FROM u")
def axis_ticks(spark, d):
    own = A.listings(spark, d, "district", "area").where("area > 0").groupBy("district").agg((F.max("area") - F.min("area")).alias("span")).where("span > 0")
    return own.select("district", S.half_up(M.nice_step(F.col("span")), 6).alias("step"))


@query("describe_series", f"{WITH} SELECT agency, count(ppm) AS n, CASE WHEN count(ppm) = 0 THEN 'insufficient' WHEN count(ppm) < 3 THEN 'orientative' ELSE 'ready' END AS status, {h('quantile_cont(ppm, 0.25)', 6)} AS p25, {h('quantile_cont(ppm, 0.5)', 6)} AS median, {h('quantile_cont(ppm, 0.75)', 6)} AS p75 FROM listings GROUP BY 1")
def describe_series(spark, d):
    return M.series(A.listings(spark, d, "agency", "ppm"), "agency", "ppm")


@query("sum_null_zero", f"{WITH} SELECT typology, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, {h('coalesce(sum(area), 0e0)', 2)} AS area FROM listings GROUP BY 1")
def sum_null_zero(spark, d):
    return A.listings(spark, d, "typology", "units", "area").groupBy("typology").agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"), S.half_up(F.coalesce(F.sum("area"), F.lit(0.0)), 2).alias("area"))


@query("filter_currency", f"{WITH} SELECT listing_id, price FROM listings WHERE currency = 'PEN'")
def filter_currency(spark, d):
    return A.listings(spark, d, "listing_id", "price", "currency").where("currency = 'PEN'").select("listing_id", "price")


@query("clamp", f"{WITH} SELECT listing_id, least(300e0, greatest(50e0, area)) AS area FROM listings WHERE area IS NOT NULL")
def clamp(spark, d):
    return A.listings(spark, d, "listing_id", "area").where("area is not null").select("listing_id", F.least(F.lit(300.0), F.greatest(F.lit(50.0), "area")).alias("area"))


@query("approx_equal", f"{WITH} SELECT listing_id, abs({h(r('price', 'area'), 1)} - {h(r('price', 'area'), 2)}) <= 0.02e0 AS close FROM listings WHERE area > 0")
def approx_equal(spark, d):
    x = S.ratio(F.col("price"), F.col("area"))
    return A.listings(spark, d, "listing_id", "price", "area").where("area > 0").select("listing_id", (F.abs(S.half_up(x, 1) - S.half_up(x, 2)) <= 0.02).alias("close"))


_t = "greatest(0e0, least(1e0, ((lon - -77.08e0) * 0.05e0 + (lat - -12.18e0) * 0.04e0) / 0.0041e0))"


@query("point_segment_distance", f"{WITH} SELECT listing_id, {h(f'sqrt(pow(lon - (-77.08e0 + {_t} * 0.05e0), 2) + pow(lat - (-12.18e0 + {_t} * 0.04e0), 2))', 6)} AS degrees FROM listings")
def point_segment_distance(spark, d):
    return A.listings(spark, d, "listing_id", "lat", "lon").select("listing_id", S.half_up(M.segment_distance(F.col("lon"), F.col("lat"), -77.08, -12.18, -77.03, -12.14), 6).alias("degrees"))


@query("target_price_m2", f"{WITH} SELECT listing_id, {h(f'coalesce(CASE WHEN units > 4 THEN 1500e0 END, {r("price", "area")})', 2)} AS target FROM listings")
def target_price(spark, d):
    return A.listings(spark, d, "listing_id", "units", "price", "area").select("listing_id", S.half_up(F.coalesce(F.when(F.col("units") > 4, F.lit(1500.0)), S.ratio(F.col("price"), F.col("area"))), 2).alias("target"))


@query("stream_event_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS value FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    return windows.run_available(spark, d).withColumn("value", F.floor(F.col("value") * 100 + 0.5).cast("double") / 100)
