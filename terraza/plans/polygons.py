"""Queries on polygons: which district's polygon each listing lies in, and what follows from it.

The districts' polygons are drawn on the ten-thousandths of a degree that listings lie on, so some points lie on borders; they reach
into their neighbours, leave gaps, have a hole, and every third has an island.
"""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import cells as C
from terraza.operators import districts as D
from terraza.operators import sets as E
from terraza.registry import query
from terraza.sources import adapter as A
from terraza.sources.scratch import apart, written

WIDTH = 0.0005
# (part, ring, corners): in ten-thousandths of a degree from the district's corner.
SHAPE = ((0, 0, ((0, 0), (150, 0), (220, 100), (150, 190), (0, 150))), (0, 1, ((40, 40), (100, 40), (100, 100), (40, 100))), (1, 0, ((160, 160), (195, 165), (170, 195))))
_x = lambda u: f"-77.1e0 + (n_nationkey % 5 * 200 + {u}) / 1e4"
_y = lambda v, div: f"-12.2e0 + ({div} * 200 + {v}) / 1e4"
#: Some listings have no coordinates, those of the origin, or ones that don't exist.
COORDINATES = {"lat": "CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN 0e0 WHEN o_orderkey % 61 = 0 THEN 95e0 ELSE -12.2e0 + (o_orderkey * 37 % 1000) / 1e4 END", "lon": "CASE WHEN o_orderkey % 59 = 0 THEN 0e0 ELSE -77.1e0 + (o_orderkey * 91 % 1000) / 1e4 END"}


def polygons(spark, d):
    ring = lambda corners: "array(" + ", ".join(f"struct({_x(u)} AS x, {_y(v, 'n_nationkey div 5')} AS y)" for u, v in corners) + ")"
    parts = {}
    for part, _, corners in SHAPE:
        parts.setdefault(part, []).append(ring(corners))
    first, island = (f"array({', '.join(r)})" for r in parts.values())
    return A.table(spark, d, "nation").selectExpr("CAST(n_nationkey AS INT) AS polygon", f"CASE WHEN n_nationkey % 3 = 0 THEN array({first}, {island}) ELSE array({first}) END AS parts")


def listings(spark, d):
    """Listings with their declared districts; those with line items are reconciled."""
    districts = A.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("district_id"))
    known = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id")).distinct().withColumn("reconciled", F.lit(True))
    own = A.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("listing_id"), *(F.expr(e).alias(c) for c, e in COORDINATES.items()))
    return own.join(apart(districts), "o_custkey", "left").join(apart(known), "listing_id", "left").select("listing_id", "district_id", "lat", "lon", F.coalesce("reconciled", F.lit(False)).alias("reconciled"))


_corners = ", ".join(f"({p}, {r}, {i}, {u}, {v}, {len(ring)})" for p, r, ring in SHAPE for i, (u, v) in enumerate(ring))
_seg = "greatest(0e0, least(1e0, ((q.x - ax) * (bx - ax) + (q.y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2))))"
HITS = f"""corners(part, ring, i, u, v, n) AS (VALUES {_corners}), spots AS (SELECT n_nationkey AS polygon, part, ring, i, n, {_x('u')} AS x, {_y('v', '(n_nationkey // 5)')} AS y FROM nation, corners WHERE part = 0 OR n_nationkey % 3 = 0),
edges AS (SELECT a.polygon, a.part, a.ring, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM spots a JOIN spots b ON b.polygon = a.polygon AND b.part = a.part AND b.ring = a.ring AND b.i = (a.i + 1) % a.n),
own AS (SELECT o_orderkey AS listing_id, c_nationkey AS district_id, {', '.join(f'{e} AS {c}' for c, e in COORDINATES.items())}, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS reconciled FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
places AS (SELECT DISTINCT lon AS x, lat AS y FROM own WHERE {S.valid_coordinate_sql('lat', 'lon')}),
rings AS (SELECT q.x, q.y, polygon, part, ring, bool_or(pow(q.x - (ax + {_seg} * (bx - ax)), 2) + pow(q.y - (ay + {_seg} * (by_ - ay)), 2) <= 1e-20) OR count(*) FILTER ((ay > q.y) <> (by_ > q.y) AND q.x < (bx - ax) * (q.y - ay) / (by_ - ay) + ax) % 2 = 1 AS holds FROM places q, edges GROUP BY ALL),
hits AS (SELECT DISTINCT x, y, polygon FROM (SELECT x, y, polygon, part FROM rings GROUP BY ALL HAVING bool_or(ring = 0 AND holds) AND NOT bool_or(ring > 0 AND holds)))"""


@query("theta_join_point_in_polygon", f"WITH {HITS} SELECT listing_id, polygon FROM own JOIN hits ON lon = x AND lat = y")
def point_in_polygon(spark, d):
    """The polygons that each listing's point lies in, whatever district it names."""
    points = listings(spark, d).where(S.valid_coordinate(F.col("lat"), F.col("lon"))).select(F.col("listing_id").alias("point"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return C.within(points, polygons(spark, d), "polygon", WIDTH).select(F.col("point").alias("listing_id"), "polygon")


_valid = S.valid_coordinate_sql("lat", "lon")
ASSIGNED = f"""{HITS}, top AS (SELECT district_id FROM own WHERE {_valid} AND district_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 7), n AS (SELECT x, y, count(*) AS found, list(polygon) AS polygons FROM hits GROUP BY ALL),
placed AS (SELECT o.*, {_valid} AS coordinate_valid, coalesce(district_id IN (FROM top), false) AS high_load, coalesce(found, 0) AS found, coalesce(list_contains(polygons, district_id), false) AS polygon_valid FROM own o LEFT JOIN n ON lon = x AND lat = y),
mid AS (SELECT district_id AS id, quantile_cont(lat, 0.5) AS mid_lat, quantile_cont(lon, 0.5) AS mid_lon FROM placed WHERE high_load AND polygon_valid GROUP BY 1),
assigned AS (SELECT *, CASE WHEN high_load AND polygon_valid THEN concat(CASE WHEN lat >= mid_lat THEN 'N' ELSE 'S' END, CASE WHEN lon < mid_lon THEN 'W' ELSE 'E' END) END AS quadrant,
CASE WHEN NOT high_load THEN 'not_high_load' WHEN NOT coordinate_valid THEN 'invalid_coordinates' WHEN NOT polygon_valid THEN 'outside_district_polygon' WHEN NOT reconciled THEN 'not_reconciled' END AS reason FROM placed LEFT JOIN mid ON id = district_id)"""
_stage = "CASE reason WHEN 'not_high_load' THEN 'scope' WHEN 'not_reconciled' THEN 'reconciliation' ELSE CASE WHEN reason IS NOT NULL THEN 'geography' END END"


def assigned(spark, d):
    return D.assignments(listings(spark, d), polygons(spark, d), WIDTH)


_count = lambda c, name: f"count(*) FILTER ({c}) AS {name}"


@query("geography_model", f"""WITH {ASSIGNED} SELECT district_id, count(*) AS observed, {', '.join(_count(c, c) for c in ('coordinate_valid', 'polygon_valid', 'reconciled'))}, {_count('polygon_valid AND found > 1', 'shared')}, {_count('reason IS NULL', 'counted')},
{S.half_up_sql('max(mid_lat)', 6)} AS mid_lat, {S.half_up_sql('max(mid_lon)', 6)} AS mid_lon, {', '.join(_count(f"reason = '{r}'", r) for r in ('invalid_coordinates', 'outside_district_polygon', 'not_reconciled'))},
{', '.join(_count(f"quadrant = '{q}'", q.lower()) for q in D.QUADRANTS)}, {', '.join(_count(f"quadrant = '{q}' AND reconciled", f'{q.lower()}_reconciled') for q in D.QUADRANTS)} FROM assigned WHERE high_load GROUP BY 1""")
def geography_model(spark, d):
    return D.model(assigned(spark, d))


@query("geography_assignments", f"WITH {ASSIGNED} SELECT listing_id, district_id, coordinate_valid, found, polygon_valid, quadrant, reconciled, {_stage} AS stage, reason FROM assigned")
def geography_assignments(spark, d):
    return assigned(spark, d).select("listing_id", "district_id", "coordinate_valid", "found", "polygon_valid", "quadrant", "reconciled", "stage", "reason")


@query("geography_exclusions", f"WITH {ASSIGNED} SELECT coalesce({_stage}, 'counted') AS stage, coalesce(reason, 'counted') AS reason, count(*) AS listings FROM assigned GROUP BY ALL")
def geography_exclusions(spark, d):
    return D.exclusions(assigned(spark, d))


# Those who read a scenario's projects.
CONSUMERS = ("map", "market_reading", "comparator", "assistant")
METRES = 3000


def _scenarios(spark, d):
    """(district_id, mode, listing_id) of each consumer: its own route to the listings that a scenario compares, in the district, its north-east and a radius."""
    own = written(assigned(spark, d), "assignments")
    known = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id")).distinct()
    ids = own.select("listing_id", "district_id", "quadrant", "lat", "lon", "mid_lat", "mid_lon")
    near = S.haversine(F.col("mid_lat"), F.col("mid_lon"), F.col("lat"), F.col("lon")) <= METRES
    modes = lambda df: df.withColumn("mode", F.explode(F.array_compact(F.array(F.lit("district"), F.when(F.col("quadrant") == "NE", "quadrant"), F.when(near, "radius"))))).select("district_id", "mode", "listing_id")
    # The map takes what the ledger leaves; the reading starts from the points in polygons; the comparator takes the ledger's rows away; the assistant meets three lists.
    ways = {"map": modes(own.where("high_load and reason is null"))}
    points = own.where(S.valid_coordinate(F.col("lat"), F.col("lon"))).select(F.col("listing_id").alias("point"), "district_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    inside = C.within(points, polygons(spark, d), "polygon", WIDTH).where("polygon = district_id").select(F.col("point").alias("listing_id"))
    ways["market_reading"] = modes(ids.where("quadrant is not null").join(apart(inside), "listing_id", "left_semi").join(apart(known), "listing_id", "left_semi"))
    ways["comparator"] = modes(ids.join(apart(own.where("reason is not null").select("listing_id")), "listing_id", "left_anti"))
    met = ids
    for c in ("high_load", "coordinate_valid and polygon_valid", "reconciled"):
        met = met.join(apart(own.where(c).select("listing_id")), "listing_id", "left_semi")
    ways["assistant"] = modes(met)
    return ways


def _prints(spark, d, planted=False):
    out = None
    for name, sets in _scenarios(spark, d).items():
        if planted and name == "comparator":  # one listing of each of some districts is taken for another
            sets = sets.withColumn("listing_id", F.when((F.col("listing_id") % 97 == 3), -F.col("listing_id")).otherwise(F.col("listing_id")))
        own = E.fingerprints(sets, ["district_id", "mode"], "listing_id").withColumn("consumer", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


_near = f"{S.haversine_sql('mid_lat', 'mid_lon', 'lat', 'lon')} <= {METRES}"
_modes = f"scoped AS (SELECT district_id, unnest(['district', CASE WHEN quadrant = 'NE' THEN 'quadrant' END, CASE WHEN {_near} THEN 'radius' END]) AS mode, listing_id FROM assigned WHERE high_load AND reason IS NULL)"
_each = f"(SELECT unnest([{', '.join(f"'{c}'" for c in CONSUMERS)}]) AS consumer)"


@query("scenario_scope_build", f"WITH {ASSIGNED}, {_modes} SELECT consumer, f.* FROM ({E.fingerprints_sql('(SELECT * FROM scoped WHERE mode IS NOT NULL)', 'district_id, mode', 'listing_id')}) f, {_each}")
def scenario_scope_build(spark, d):
    """What each consumer compares in each scenario, as fingerprints of lists that came by different routes."""
    return _prints(spark, d)


_member = "CASE WHEN consumer = 'comparator' AND listing_id % 97 = 3 THEN -listing_id ELSE listing_id END"


@query("check_scope_consumers", f"""WITH {ASSIGNED}, {_modes}, each AS (SELECT consumer, district_id, mode, {_member} AS id FROM scoped, {_each} WHERE mode IS NOT NULL), f AS ({E.fingerprints_sql('each', 'consumer, district_id, mode', 'id')})
SELECT district_id, mode, count(DISTINCT (members, hash_sum, hash_xor)) AS distinct_sets, 4 - count(DISTINCT consumer) AS missing, count(DISTINCT (members, hash_sum, hash_xor)) = 1 AND count(DISTINCT consumer) = 4 AS agree FROM f GROUP BY 1, 2""")
def check_scope_consumers(spark, d):
    """Scenarios whose consumers' lists differ, where one consumer takes some listings for others."""
    return E.agreement(_prints(spark, d, planted=True), ["district_id", "mode"], "consumer", CONSUMERS)
