"""Queries that order whole collections: every row with its rank, for each key that a reader may sort by."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import ordered as O
from terraza.operators import scoring as C
from terraza.plans import listings as PL
from terraza.plans import polygons as PP
from terraza.registry import query
from terraza.sources import adapter as A

_present = lambda x: f"CASE WHEN {x} > 0 THEN {x} END"
_metres = S.haversine_sql("-12.15e0", "-77.05e0", "lat", "lon")
T = PL.TARGET
#: Each key's two values, the smaller first. Rising keys put what is missing last; falling ones put it, and 0, first.
PROJECTS = {
    "direct": ("-coalesce(score, 0e0)", "0e0"),
    "price_m2": (_present("ppm"), "0e0"),
    "price_total": (_present("price"), "0e0"),
    "area": (f"coalesce(-({_present('area')}), -1e300)", "0e0"),
    "bedrooms": (f"coalesce(-({_present('bedrooms_max')}), -1e300)", "0e0"),
    "units": (f"coalesce(-({_present('units')}), -1e300)", "0e0"),
    "delivery": (_present("delivery_year"), "0e0"),
    "closest_price": (f"abs(coalesce({_present('ppm')}, 0e0) - {T.ppm}e0)", "0e0"),
    "competition": ("-coalesce(score, 0e0)", f"CASE WHEN area > 0 THEN abs(area - {T.area}e0) ELSE 0e0 END"),
}
#: The catalogue's keys; what is missing is last in both directions, and ties are by the rank in the scenario, which is the id's.
CATALOG = {"direct": "listing_id", "score": "-score", "distance": _metres, "price_m2": _present("ppm"), "price_total": _present("price"), "area": f"-({_present('area')})", "bedrooms": "-bedrooms_max", "delivery": "delivery_year"}
COLUMNS = ("listing_id", "ppm", "price", "area", "bedrooms_min", "bedrooms_max", "units", "typology", "delivery_year", "lat", "lon")


def _scored(spark, d):
    own = A.listings(spark, d, *COLUMNS)
    return own.join(C.score(own, PL.TARGET).select("listing_id", "score"), "listing_id")


def _ranked(own, keys):
    """(sort_key, listing_id, rank) of every listing under every key, in one pass: the keys are groups of one range partition."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("sort_key"), F.expr(f"CAST({v} AS DOUBLE)").alias("v"), F.expr(f"CAST({w} AS DOUBLE)").alias("w")) for k, (v, w) in keys.items())))
    long = own.select("listing_id", each.alias("e")).select("e.*", "listing_id")
    return O.ranked(long, {"v": "asc", "w": "asc", "listing_id": "asc"}, by=("sort_key",)).select("sort_key", "listing_id", "rank")


_all = f"{PL._score_sql()}, own AS (SELECT l.*, s.score FROM listings l JOIN scores s ON s.listing_id = l.listing_id)"
_rank = lambda key, v, w: f"SELECT '{key}' AS sort_key, listing_id, row_number() OVER (ORDER BY CAST({v} AS DOUBLE) NULLS LAST, CAST({w} AS DOUBLE), listing_id) AS rank FROM own"


@query("sort_projects", f"{_all} {' UNION ALL '.join(_rank(k, *v) for k, v in PROJECTS.items())}")
def sort_projects(spark, d):
    return _ranked(_scored(spark, d), PROJECTS)


@query("sort_catalog", f"{_all} {' UNION ALL '.join(_rank(k, v, '0e0') for k, v in CATALOG.items())}")
def sort_catalog(spark, d):
    return _ranked(_scored(spark, d), {k: (v, "0e0") for k, v in CATALOG.items()})


@query("sort_events", "SELECT event_id, ts, row_number() OVER (ORDER BY ts, CAST(event_id AS VARCHAR)) AS rank FROM events")
def sort_events(spark, d):
    return O.ranked(A.table(spark, d, "events").select("event_id", "ts"), {"ts": "asc", "CAST(event_id AS STRING)": "asc"})


_stages = "CASE reason WHEN 'not_high_load' THEN 0 WHEN 'not_reconciled' THEN 2 ELSE 1 END"


@query("sort_exclusions", f"WITH {PP.ASSIGNED} SELECT listing_id, {PP._stage} AS stage, reason, row_number() OVER (ORDER BY {_stages}, CAST(listing_id AS VARCHAR), reason) AS rank FROM assigned WHERE reason IS NOT NULL")
def sort_exclusions(spark, d):
    """Excluded listings by the stage at which they leave, their id as text, and the reason."""
    own = PP.assigned(spark, d).where("reason is not null").select("listing_id", "stage", "reason")
    return O.ranked(own, {_stages: "asc", "CAST(listing_id AS STRING)": "asc", "reason": "asc"})
