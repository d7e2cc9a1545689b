"""Queries on the benchmark's facts: a source row of each listing, its facts, the index, four ledgers and what the catalogue doesn't know."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import marketfacts as K
from terraza.registry import query
from terraza.sources import adapter as A

CUTOFF = "1998-01-31 00:00:00"
#: A source row of each listing; some values are missing, not above 0, or in another currency.
ROW = {
    "project_id": "listing_id", "captured_at": "captured_at", "currency": "CASE WHEN listing_id % 17 = 3 THEN 'USD' WHEN listing_id % 19 = 0 THEN 'EUR' ELSE currency END", "price": "CASE listing_id % 13 WHEN 0 THEN -price WHEN 1 THEN NULL ELSE price END",
    "area": "area", "units": "CASE WHEN listing_id % 11 > 0 THEN units END", "parking": "CASE WHEN listing_id % 7 > 0 THEN listing_id % 5 - CASE WHEN listing_id % 101 = 1 THEN 9 ELSE 0 END END", "attributes": "concat(coalesce(amenities, ''), CASE WHEN listing_id % 3 = 0 THEN ' Red  old' ELSE '' END)",
}
#: The catalogue: of the words in parts' names, those of a colour are one attribute, some are ignored, some unknown.
_attribute = "CASE WHEN term IN ('red', 'blue') THEN 'attribute:colour-finish' WHEN term IN ('small', 'large', 'gear', 'ring', 'plate', 'rod', 'bolt') THEN concat('attribute:', term) END"
_terms = "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS term FROM part"
_listed = "term NOT IN ('hot', 'gizmo', 'widget')"


def made(spark, d):
    rows = A.listings(spark, d, "listing_id", "price", "area", "units", "currency", "amenities", "captured_at").selectExpr(*(f"{e} AS {c}" for c, e in ROW.items()))
    catalog = A.table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).distinct().where(_listed).selectExpr("term", f"{_attribute} AS attribute_id")
    blocked = A.table(spark, d, "orders").where("o_orderkey % 23 = 4").select(F.col("o_orderkey").alias("project_id"))
    return K.materialized(rows, blocked, catalog, CUTOFF)


BASE = f"""WITH {A.LISTINGS_SQL}, rows_ AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ROW.items())} FROM listings), catalog AS (SELECT term, {_attribute} AS attribute_id FROM ({_terms}) WHERE {_listed}),
own AS (SELECT project_id, coalesce(captured_at > TIMESTAMP '{CUTOFF}', true) AS late, project_id % 23 = 4 AS blocked, CASE WHEN currency IN ('PEN', 'USD') THEN currency ELSE 'unknown' END AS currency, CASE WHEN price > 0 THEN CAST(price AS DOUBLE) END AS price, CASE WHEN area > 0 THEN CAST(area AS DOUBLE) END AS area,
CASE WHEN units >= 0 THEN CAST(units AS DOUBLE) END AS units, CASE WHEN parking >= 0 THEN CAST(parking AS DOUBLE) END AS parking, attributes FROM rows_),
each AS (SELECT project_id, unnest(string_split(attributes, ' ')) AS token, unnest(range(len(string_split(attributes, ' ')))) AS nth FROM own), found AS (SELECT e.project_id, token, nth, attribute_id, term IS NOT NULL AS known FROM each e LEFT JOIN catalog ON term = lower(token) WHERE token <> ''),
named AS (SELECT project_id, attribute_id, arg_min(token, nth) AS token FROM found WHERE attribute_id IS NOT NULL GROUP BY 1, 2),
facts AS (SELECT project_id, 'published_price_from' AS field_name, 'price' AS semantic_type, currency AS unit, price AS value, NULL AS text, 'observed' AS value_kind, CASE WHEN blocked THEN 'blocking_issue' WHEN late THEN 'cutoff' WHEN currency <> 'PEN' THEN 'currency' END AS exclusion_reason FROM own WHERE price IS NOT NULL
UNION ALL SELECT project_id, 'total_area_min', 'area', 'm2', area, NULL, 'observed', CASE WHEN blocked THEN 'blocking_issue' WHEN late THEN 'cutoff' END FROM own WHERE area IS NOT NULL
UNION ALL SELECT project_id, 'price_per_total_m2_orientative', 'price_per_m2', 'PEN/m2', {S.half_up_sql(S.ratio_sql('price', 'area'), 2)}, NULL, 'derived', 'price_area_link_unresolved' FROM own WHERE price IS NOT NULL AND area IS NOT NULL AND currency = 'PEN' AND NOT late AND NOT blocked
UNION ALL SELECT project_id, 'reported_unit_count', 'count', 'count', units, NULL, 'observed', CASE WHEN late THEN 'cutoff' END FROM own WHERE units IS NOT NULL
UNION ALL SELECT project_id, 'parking_count', 'count', 'count', parking, NULL, 'observed', CASE WHEN late THEN 'cutoff' END FROM own WHERE parking IS NOT NULL
UNION ALL SELECT n.project_id, concat('attribute_', replace(split_part(attribute_id, ':', 2), '-', '_')), 'attribute', 'text', NULL, token, 'observed', CASE WHEN late THEN 'cutoff' END FROM named n JOIN own o ON o.project_id = n.project_id),
states AS (SELECT project_id, CASE WHEN blocked THEN 'blocking_issue' WHEN late THEN 'cutoff' WHEN price IS NOT NULL AND currency = 'USD' THEN 'currency' WHEN price IS NULL OR area IS NULL OR currency = 'unknown' THEN 'missing' ELSE 'price_area_link_unresolved' END AS ppm, late, units, parking, project_id IN (SELECT project_id FROM named) AS has FROM own),
ledgers AS (SELECT 'price_per_m2_total' AS indicator, project_id, CASE WHEN ppm = 'missing' THEN ppm ELSE 'excluded' END AS state, nullif(ppm, 'missing') AS reason FROM states {''.join(f"UNION ALL SELECT '{k}', project_id, CASE WHEN late THEN 'excluded' WHEN {c} THEN 'used' ELSE 'missing' END, CASE WHEN late THEN 'cutoff' END FROM states " for k, c in (('units_reported', 'units IS NOT NULL'), ('parking_reported', 'parking IS NOT NULL'), ('attributes_announced', 'has')))})"""


@query("benchmark_materialize", f"{BASE} SELECT concat('fact:', project_id, ':', field_name) AS fact_id, *, exclusion_reason IS NULL AS eligible FROM facts")
def benchmark_materialize(spark, d):
    return made(spark, d)[2]


_id = lambda name: f"max(CASE WHEN field_name = '{name}' THEN concat('fact:', project_id, ':', field_name) END)"


@query("benchmark_index", f"""{BASE}, ids AS (SELECT project_id, {_id('published_price_from')} AS price_fact, {_id('total_area_min')} AS area_fact, {_id('price_per_total_m2_orientative')} AS ppm_fact, {_id('reported_unit_count')} AS unit_fact, {_id('parking_count')} AS parking_fact, count(*) FILTER (semantic_type = 'attribute') AS attributes FROM facts GROUP BY 1)
SELECT o.project_id, price_fact, CASE WHEN NOT blocked THEN area_fact END AS area_fact, CASE WHEN NOT blocked THEN ppm_fact END AS ppm_fact, unit_fact, parking_fact, coalesce(i.attributes, 0) AS attributes, CASE WHEN blocked THEN 'conflicting' WHEN price_fact IS NOT NULL AND area_fact IS NOT NULL AND currency <> 'unknown' THEN 'project_minima_pair_unresolved' ELSE 'missing' END AS pairing_status
FROM own o LEFT JOIN ids i ON i.project_id = o.project_id""")
def benchmark_index(spark, d):
    own, _, facts = made(spark, d)
    return K.index(own, facts)


@query("benchmark_ledgers", f"{BASE} SELECT * FROM ledgers")
def benchmark_ledgers(spark, d):
    """Every project in each of the four ledgers."""
    own, _, facts = made(spark, d)
    return K.ledgers(own, facts)


_state = lambda s: f"count(*) FILTER (state = '{s}') AS {s}"


@query("benchmark_coverage", f"{BASE} SELECT indicator, (SELECT count(*) FROM own) AS projects, {', '.join(map(_state, ('used', 'missing', 'excluded')))}, count(*) = (SELECT count(*) FROM own) AND count(DISTINCT project_id) = count(*) AS parted FROM ledgers GROUP BY 1")
def benchmark_coverage(spark, d):
    own, _, facts = made(spark, d)
    return K.coverage(K.ledgers(own, facts), own)


@query("benchmark_unknown_tokens", f"{BASE} SELECT token, count(*) AS uses FROM found WHERE NOT known GROUP BY 1")
def benchmark_unknown_tokens(spark, d):
    return made(spark, d)[1].where("not known").groupBy("token").agg(F.count("*").alias("uses"))
