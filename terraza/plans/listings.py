"""Queries on listings."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.functions.quantiles import exact
from terraza.operators import listings as L
from terraza.operators import scoring as C
from terraza.registry import query
from terraza.sources import adapter as A
from terraza.sources import model as M
from terraza.sources.scratch import written

WITH = f"WITH {A.LISTINGS_SQL}"
FACTS = f"WITH {A.FACTS_SQL}"
h = S.half_up_sql
POS_PRICE, POS_AREA = "CASE WHEN price > 0 THEN price END", "CASE WHEN area > 0 THEN area END"


_valid = S.valid_coordinate_sql("lat", "lon")
_more = f"""{', '.join(f'{S.clean_sql(c)} AS {c}' for c in ('district', 'typology', 'segment', 'amenities'))}, phase, CASE WHEN currency IN ('PEN', 'USD') THEN currency ELSE 'unknown' END AS currency, captured_at, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('bedrooms_min', 'bedrooms_max', 'delivery_year'))},
CASE WHEN {_valid} THEN lat END AS lat, CASE WHEN {_valid} THEN lon END AS lon, {h('units * price', 2)} AS income, {h('units * area', 2)} AS total_m2, concat('project:feed-', listing_id) AS project_id, concat('agency:', {S.slug_sql('agency')}) AS agency_id"""


@query("project_listing", f"{WITH} SELECT listing_id, {S.clean_sql('agency')} AS agency, {S.words_sql('district')} AS district_key, {S.slug_sql('typology')} AS typology_key, {POS_PRICE} AS price, {POS_AREA} AS area, {h(S.ratio_sql(f'({POS_PRICE})', f'({POS_AREA})'), 2)} AS price_m2, coalesce(units, 0) AS units, {_more} FROM listings")
def project_listing(spark, d):
    return L.project_listing(A.listings(spark, d))


@query("derive_income_total_m2", f"{WITH} SELECT listing_id, {h('units * price', 2)} AS income, {h('units * area', 2)} AS total_m2 FROM listings")
def derive_income(spark, d):
    return L.derive_income(A.listings(spark, d, "listing_id", "units", "price", "area"))


@query("filter_certified_facts", f"{FACTS} SELECT listing_id, line, source_id, semantic_type, value FROM facts WHERE eligible AND quality = 'certified' AND value IS NOT NULL AND NOT isnan(value)")
def filter_certified(spark, d):
    return L.certified(A.facts(spark, d)).select("listing_id", "line", "source_id", "semantic_type", "value")


@query("filter_catalog", f"{WITH} SELECT listing_id, agency, district, phase FROM listings WHERE phase = 'O' AND contains(lower({S.unaccent_sql("concat_ws(' ', agency, district, typology, phase, segment)")}), 'building')")
def filter_catalog(spark, d):
    return L.filter_catalog(A.listings(spark, d, "listing_id", "agency", "district", "phase", "typology", "segment"), phase="O", query=" Building ").select("listing_id", "agency", "district", "phase")


CUTOFF = "1997-06-30 00:00:00"
_price = S.reasons_sql(
    currency_unknown="currency <> 'PEN'", price_missing="NOT coalesce(price > 0, false)", area_missing="NOT coalesce(area > 0, false)", ppm_missing="ppm IS NULL", captured_at_missing="captured_at IS NULL",
    after_cutoff=f"captured_at > TIMESTAMP '{CUTOFF}'", ppm_mismatch=f"abs(ppm - {S.ratio_sql('price', 'area')}) / {S.ratio_sql('price', 'area')} > 0.005e0",
)


@query("price_eligibility", f"{WITH} SELECT listing_id, array_to_string({_price}, ',') AS reasons, len({_price}) = 0 AS eligible FROM listings")
def price_eligibility(spark, d):
    return L.price_reasons(A.listings(spark, d, "listing_id", "currency", "price", "area", "ppm", "captured_at"), CUTOFF)


_product = S.reasons_sql(typology_mismatch="typology <> 'ECONOMY'", bedrooms_mismatch="NOT (2 BETWEEN bedrooms_min AND bedrooms_max)", delivery_mismatch="delivery_year <> 1996")


@query("product_eligibility", f"{WITH} SELECT listing_id, array_to_string({_product}, ',') AS reasons, len({_product}) = 0 AS eligible FROM listings")
def product_eligibility(spark, d):
    return L.product_reasons(A.listings(spark, d, "listing_id", "typology", "bedrooms_min", "bedrooms_max", "delivery_year"), "ECONOMY", 2, 1996)


@query("agg_certified", f"{FACTS} SELECT semantic_type, unit, quality, count(*) AS n, {h('avg(value)', 2)} AS mean, min(value) AS least, max(value) AS largest FROM facts WHERE eligible AND quality = 'certified' GROUP BY 1, 2, 3")
def agg_certified(spark, d):
    return L.aggregate_certified(A.facts(spark, d))


@query("agg_certified_mean", f"""{FACTS}, g AS (SELECT listing_id, count(*) FILTER (value IS NULL) AS missing, count(DISTINCT (semantic_type, unit, quality)) AS signatures, avg(value) AS mean FROM facts GROUP BY 1)
SELECT listing_id, CASE WHEN missing > 0 THEN 'insufficient' WHEN signatures > 1 THEN 'incompatible' ELSE 'available' END AS status, CASE WHEN missing = 0 AND signatures <= 1 THEN {h('mean', 2)} END AS mean FROM g""")
def agg_certified_mean(spark, d):
    return L.certified_mean(A.facts(spark, d), "listing_id")


@query("agg_executive", f"""{WITH} SELECT count(DISTINCT (agency, listing_id, district)) AS projects, CAST(sum(units) AS BIGINT) AS units, {h("sum(CASE WHEN currency = 'PEN' THEN units * price END)", 0)} AS income,
{h("avg(CASE WHEN currency = 'PEN' THEN price END)", 2)} AS mean_price, {h("avg(CASE WHEN currency = 'PEN' THEN ppm END)", 2)} AS mean_ppm, count(DISTINCT district) AS districts, count(DISTINCT agency) AS agencies FROM listings""")
def agg_executive(spark, d):
    return L.executive(A.listings(spark, d, "agency", "listing_id", "district", "units", "currency", "price", "ppm"))


def _rank(dimension: str, n: int) -> str:
    return f"""{WITH} SELECT coalesce({dimension}, 'Sin dato') AS name, count(DISTINCT listing_id) AS projects, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, {h('sum(units * price)', 0)} AS income, {h('avg(price)', 2)} AS mean_price
FROM listings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}"""


for _name, _dimension, _n in (("agg_rankings_district", "district", 18), ("agg_rankings_agency", "agency", 18), ("agg_rankings_typology", "typology", 12), ("agg_rankings_phase", "phase", 12)):
    query(_name, _rank(_dimension, _n))(lambda spark, d, x=_dimension, n=_n: L.rankings(A.listings(spark, d, x, "listing_id", "units", "price"), x, n))

_ppm = "CASE WHEN ppm > 0 THEN ppm END"


@query("agg_benchmark_district", f"""{WITH} SELECT district, count(*) AS projects, CAST(sum(units) AS BIGINT) AS units, {h(f'avg({_ppm})', 2)} AS mean_ppm, {h(f'quantile_cont({_ppm}, 0.25)', 2)} AS p25_ppm,
{h(f'quantile_cont({_ppm}, 0.5)', 2)} AS median_ppm, {h(f'quantile_cont({_ppm}, 0.75)', 2)} AS p75_ppm, {h(f'quantile_cont({POS_PRICE}, 0.5)', 2)} AS median_price, count(DISTINCT agency) AS agencies FROM listings GROUP BY 1""")
def agg_benchmark_district(spark, d):
    return L.district_benchmark(A.listings(spark, d, "district", "units", "ppm", "price", "agency"))


@query("quantile_r7", f"{WITH} SELECT typology, count(ppm) AS n, {h('quantile_cont(ppm, 0.1)', 6)} AS p10, {h('quantile_cont(ppm, 0.5)', 6)} AS p50, {h('quantile_cont(ppm, 0.9)', 6)} AS p90 FROM listings GROUP BY 1")
def quantile_r7(spark, d):
    own = written(A.listings(spark, d, "typology", "ppm"), "listings")
    q = exact(own, ["typology"], "ppm", 0.1, 0.5, 0.9).withColumnRenamed("typology", "of")
    counts = own.groupBy("typology").agg(F.count("ppm").alias("n"))
    return counts.join(q, F.col("typology").eqNullSafe(F.col("of")), "left").select("typology", "n", *(S.half_up(F.col("q")[i], 6).alias(k) for i, k in enumerate(("p10", "p50", "p90"))))


@query("price_diagnosis", f"""{WITH}, g AS (SELECT district, count(*) AS n, quantile_cont(ppm, 0.5) AS median FROM listings WHERE ppm > 0 GROUP BY 1), f AS (SELECT *, 1500e0 - median AS off, {S.ratio_sql('(1500e0 - median)', 'median')} AS share FROM g)
SELECT district, n, CASE WHEN n < 3 THEN 'insufficient' WHEN share < -0.08e0 THEN 'Entrada' WHEN share > 0.08e0 THEN 'Premium' ELSE 'Alineado' END AS position, {S.round_away_sql('off', 2)} AS difference, {S.round_away_sql('share * 100', 1)} AS percent FROM f""")
def price_diagnosis(spark, d):
    return L.price_diagnosis(A.listings(spark, d, "district", "ppm"), 1500)


@query("count_by", f"{WITH} SELECT coalesce(typology, 'Sin dato') AS name, count(*) AS n FROM listings GROUP BY 1")
def count_by(spark, d):
    return L.count_by(A.listings(spark, d, "typology"), "typology")


_dims = ("district", "typology", "phase", "segment", "currency", "delivery_year")
#: The columns of each collection whose values are counted.
COUNTED = {
    "facts": ("field_name", "semantic_type", "currency", "unit", "price_type", "area_type", "denominator_area_type", "value_kind", "quality_status", "benchmark_eligible", "exclusion_reason", "digits"),
    "observations": ("evidence_status", "absence_reason", "currency"), "issues": ("benchmark_blocking", "quality_status", "issue_code"), "records": ("publish_permission", "availability", "has_fragment"),
    "docs": ("source", "publish_permission", "availability", "has_asset"), "changes": ("field", "currency", "evidence_state", "semantic", "resolved"),
}
_counted = [("listings", c) for c in _dims] + [(t, c) for t, columns in COUNTED.items() for c in columns]


@query("agg_coverage_report", f"{M.sql(*(t for t in COUNTED if t != 'changes'))}, {A.CHANGES_SQL}, {A.LISTINGS_SQL} " + " UNION ALL ".join(f"SELECT '{t}' AS collection, '{c}' AS dimension, coalesce(CAST({c} AS VARCHAR), 'Sin dato') AS name, count(*) AS n FROM {t} GROUP BY 3" for t, c in _counted) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{t}', '*', 'records', count(*) FROM {t}" for t in ("listings", *COUNTED)))
def agg_coverage_report(spark, d):
    """36 distributions and the number of records of every collection, each collection in one pass."""
    out = None
    for t, columns in (("listings", _dims), *COUNTED.items()):
        own = A.listings(spark, d, *columns) if t == "listings" else A.changes(spark, d) if t == "changes" else M.read(spark, d, t)
        own = L.distribution(own.withColumn("*", F.lit("records")), *columns, "*").select(F.lit(t).alias("collection"), "dimension", "name", "n")
        out = own if out is None else out.unionByName(own)
    return out


_fields = ("agency", "district", "typology", "area", "ppm", "delivery_year")


@query("completeness_pct", WITH + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, {h(f'avg(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) * 100', 1)} AS percent FROM listings" for c in _fields))
def completeness(spark, d):
    return L.completeness(A.listings(spark, d, *_fields), *_fields)


@query("audit_funnel", f"{WITH} SELECT count(*) AS source, count(*) FILTER (price > 0) AS priced, count(*) FILTER (price > 0 AND area > 0) AS measured, count(*) FILTER (price > 0 AND area > 0 AND currency = 'PEN') AS local, count(*) FILTER (price > 0 AND area > 0 AND currency = 'PEN' AND price < 200000) AS plausible FROM listings")
def audit_funnel(spark, d):
    return L.funnel(A.listings(spark, d, "price", "area", "currency"), 200_000)


@query("stock_by_typology_district", f"{WITH} SELECT typology, district, CAST(sum(units) AS BIGINT) AS units, count(*) AS projects, {h('avg(ppm)', 2)} AS mean_ppm FROM listings WHERE typology IS NOT NULL GROUP BY 1, 2")
def stock(spark, d):
    return L.stock(A.listings(spark, d, "typology", "district", "units", "ppm"))


@query("share_of_top_agency", f"""{WITH}, a AS (SELECT district, agency, count(*) AS n FROM listings GROUP BY 1, 2), g AS (SELECT district, max(n) AS top, CAST(sum(n) AS BIGINT) AS total FROM a GROUP BY 1)
SELECT district, top, total, {h(S.ratio_sql('top', 'total'), 4)} AS share, {S.ratio_sql('top', 'total')} >= 0.22e0 AS concentrated FROM g""")
def share_of_top_agency(spark, d):
    return L.share_of_top_agency(A.listings(spark, d, "district", "agency"))


@query("catalog_model", f"{WITH} SELECT district, listing_id, ppm_r, rank FROM (SELECT district, listing_id, {h('ppm', 2)} AS ppm_r, CAST(row_number() OVER (PARTITION BY district ORDER BY ppm NULLS LAST, listing_id) AS INTEGER) AS rank FROM listings WHERE phase = 'F') WHERE rank <= 18")
def catalog_model(spark, d):
    own = L.rank_within(A.listings(spark, d, "district", "listing_id", "ppm", "phase").where("phase = 'F'"), "district", 18, F.asc_nulls_last("ppm"), F.col("listing_id"))
    return own.select("district", "listing_id", S.half_up("ppm", 2).alias("ppm_r"), "rank")


@query("first_seen_last_seen", f"{WITH} SELECT agency, min(captured_at) AS first_seen, max(captured_at) AS last_seen, count(*) AS n FROM listings GROUP BY 1")
def first_last(spark, d):
    return L.first_last_seen(A.listings(spark, d, "agency", "captured_at"))


@query("new_projects_since", f"{WITH}, g AS (SELECT agency, min(captured_at) AS first_seen FROM listings GROUP BY 1) SELECT agency, first_seen FROM g WHERE first_seen >= TIMESTAMP '1993-01-01 00:00:00'")
def new_projects(spark, d):
    own = A.listings(spark, d, "agency", "captured_at").groupBy("agency").agg(F.min("captured_at").alias("first_seen"))
    return own.where(F.col("first_seen") >= F.expr("timestamp_ntz '1993-01-01 00:00:00'"))


@query("competition_level", f"{WITH}, g AS (SELECT district, count(*) AS projects, count(DISTINCT agency) AS agencies FROM listings GROUP BY 1) SELECT *, CASE WHEN projects >= 60 OR agencies >= 28 THEN 'Alta' WHEN projects >= 20 OR agencies >= 10 THEN 'Media' ELSE 'Baja' END AS level FROM g")
def competition(spark, d):
    return L.competition_level(A.listings(spark, d, "district", "agency"))


@query("duplicate_candidates", f"{WITH} SELECT {S.slug_sql('agency')} AS agency_key, {S.slug_sql('typology')} AS typology_key, count(*) AS n FROM listings GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, d):
    return L.duplicate_groups(A.listings(spark, d, "agency", "typology").select(S.slug("agency").alias("agency_key"), S.slug("typology").alias("typology_key")), "agency_key", "typology_key")


@query("avg_price_m2_filtered", f"{WITH} SELECT district, count(*) AS n, {h('avg(ppm)', 2)} AS mean_ppm FROM listings WHERE typology = 'ECONOMY' AND 2 BETWEEN bedrooms_min AND bedrooms_max GROUP BY 1")
def avg_ppm(spark, d):
    own = A.listings(spark, d, "district", "typology", "bedrooms_min", "bedrooms_max", "ppm").where((F.col("typology") == "ECONOMY") & F.lit(2).between(F.col("bedrooms_min"), F.col("bedrooms_max")))
    return own.groupBy("district").agg(F.count("*").alias("n"), S.half_up(F.avg("ppm"), 2).alias("mean_ppm"))


@query("agencies_in_district", f"{WITH} SELECT district, agency, count(*) AS projects, CAST(coalesce(sum(units), 0) AS BIGINT) AS units FROM listings GROUP BY 1, 2")
def agencies_in_district(spark, d):
    return A.listings(spark, d, "district", "agency", "units").groupBy("district", "agency").agg(F.count("*").alias("projects"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"))


@query("price_area_outliers", f"{WITH} SELECT listing_id, price, area FROM listings WHERE price < 5000 OR price > 300000 OR area > 300")
def outliers(spark, d):
    return A.listings(spark, d, "listing_id", "price", "area").where("price < 5000 or price > 300000 or area > 300").select("listing_id", "price", "area")


@query("bedroom_options", f"{WITH}, m AS (SELECT district, least(max(bedrooms_max), 6) AS most FROM listings WHERE bedrooms_max IS NOT NULL GROUP BY 1) SELECT district, CAST(unnest(range(1, most + 1)) AS INTEGER) AS bedrooms FROM m")
def bedroom_options(spark, d):
    most = A.listings(spark, d, "district", "bedrooms_max").where("bedrooms_max is not null").groupBy("district").agg(F.least(F.max("bedrooms_max"), F.lit(6)).alias("most"))
    return most.select("district", F.explode(F.sequence(F.lit(1), "most")).alias("bedrooms"))


@query("best_metric", f"{WITH}, g AS (SELECT district, {h('avg(ppm)', 2)} AS mean_ppm FROM listings GROUP BY 1) SELECT *, mean_ppm = (SELECT min(mean_ppm) FROM g) AS cheapest, mean_ppm = (SELECT max(mean_ppm) FROM g) AS priciest FROM g")
def best_metric(spark, d):
    own = A.listings(spark, d, "district", "ppm").groupBy("district").agg(S.half_up(F.avg("ppm"), 2).alias("mean_ppm"))
    every = W.partitionBy(F.lit(1))  # one row of each district
    return own.select("district", "mean_ppm", (F.col("mean_ppm") == F.min("mean_ppm").over(every)).alias("cheapest"), (F.col("mean_ppm") == F.max("mean_ppm").over(every)).alias("priciest"))


@query("lowest_highest", f"{WITH} SELECT district, arg_min(listing_id, (price, listing_id)) AS cheapest, arg_max(listing_id, (price, listing_id)) AS priciest FROM listings GROUP BY 1")
def lowest_highest(spark, d):
    key = F.struct("price", "listing_id")
    return A.listings(spark, d, "district", "listing_id", "price").groupBy("district").agg(F.min_by("listing_id", key).alias("cheapest"), F.max_by("listing_id", key).alias("priciest"))


@query("distinct_values", f"{WITH} SELECT DISTINCT phase, typology FROM listings WHERE typology IS NOT NULL")
def distinct_values(spark, d):
    return A.listings(spark, d, "phase", "typology").where("typology is not null").select("phase", "typology").distinct()


@query("join_attribute_catalog", f"{WITH}, t AS (SELECT listing_id, unnest(string_split(lower(amenities), ' ')) AS token FROM listings) SELECT token, count(*) AS uses, count(DISTINCT listing_id) AS projects FROM t WHERE token <> '' GROUP BY 1")
def attributes(spark, d):
    tokens = A.listings(spark, d, "listing_id", "amenities").select("listing_id", F.explode(F.split(F.lower("amenities"), " ")).alias("token")).where("token <> ''")
    return tokens.groupBy("token").agg(F.count("*").alias("uses"), F.countDistinct("listing_id").alias("projects"))


#: Columns that the score is made of.
SCORED = ("listing_id", "lat", "lon", "area", "bedrooms_min", "bedrooms_max", "typology", "delivery_year", "ppm")
TARGET = C.Target(-12.15, -77.05, 8000.0, 100.0, 2, "ECONOMY", 1996, 1500.0)


def _score_sql() -> str:
    dist = S.haversine_sql("-12.15e0", "-77.05e0", "lat", "lon")
    parts = {
        "geography": f"CASE WHEN {dist} IS NOT NULL THEN greatest(0e0, 1 - {dist} / 8000e0) END", "area": "CASE WHEN area > 0 THEN greatest(0e0, 1 - abs(area - 100e0) / 100e0) END",
        "bedrooms": "CASE WHEN bedrooms_min IS NOT NULL THEN CASE WHEN 2 BETWEEN bedrooms_min AND bedrooms_max THEN 1e0 ELSE 0e0 END END", "typology": "CASE WHEN typology IS NOT NULL THEN CASE WHEN typology = 'ECONOMY' THEN 1e0 ELSE 0e0 END END",
        "delivery": "CASE WHEN delivery_year IS NOT NULL THEN greatest(0e0, 1 - abs(delivery_year - 1996) / 2e0) END", "ppm": "CASE WHEN ppm > 0 THEN greatest(0e0, 1 - abs(ppm - 1500e0) / 1500e0) END",
    }
    points = ", ".join(f"{S.round_away_sql(f'({v}) * {C.WEIGHTS[k]}', 1)} AS {k}" for k, v in parts.items())
    earned = " + ".join(f"coalesce({k}, 0e0)" for k in parts)
    weight = " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {C.WEIGHTS[k]} ELSE 0 END" for k in parts)
    return f"""{WITH}, p AS (SELECT listing_id, {points} FROM listings), w AS (SELECT *, CAST({weight} AS INTEGER) AS weight FROM p), scores AS (SELECT *, CASE WHEN weight > 0 THEN {S.round_away_sql(f'(0e0 + {earned}) / weight * 100', 1)} END AS score FROM w),
labelled AS (SELECT *, CASE WHEN weight < 60 THEN 'Insuficiente' WHEN score >= 80 THEN 'Alta' WHEN score >= 60 THEN 'Media' ELSE 'Baja' END AS label FROM scores)"""


@query("comparability_score", f"{_score_sql()} SELECT * FROM labelled")
def comparability_score(spark, d):
    return C.score(A.listings(spark, d, *SCORED), TARGET)


@query("rank_comparables", f"{_score_sql()} SELECT listing_id, score, weight, label, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, weight DESC, listing_id) AS INTEGER) AS rank FROM labelled ORDER BY rank LIMIT 25")
def rank_comparables(spark, d):
    return C.ranked(C.score(A.listings(spark, d, *SCORED), TARGET), 25).select("listing_id", "score", "weight", "label", "rank")


@query("agg_evidence_coverage", f"{_score_sql()} SELECT {S.round_away_sql('avg(weight)', 1)} AS mean_weight, CASE WHEN avg(weight) >= 80 THEN 'ready' WHEN avg(weight) >= 60 THEN 'orientative' ELSE 'insufficient' END AS status FROM labelled")
def evidence_coverage(spark, d):
    return C.coverage(C.score(A.listings(spark, d, *SCORED), TARGET))
