"""Queries on scenarios, and on files that are written and read again."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import checks as K
from terraza.operators import history as H
from terraza.operators import listings as L
from terraza.operators import scenario as C
from terraza.operators import timeline as TL
from terraza.plans import history as PH
from terraza.plans import listings as PL
from terraza.plans import timeline as PT
from terraza.registry import query
from terraza.sources import adapter as A
from terraza.sources import files, scratch
from terraza.sources import model as M

LISTINGS = f"WITH {A.LISTINGS_SQL}"
h, r = S.half_up_sql, S.ratio_sql
SCENARIO = C.Scenario("BRAZIL", PL.TARGET, "radius")
VALID = S.valid_coordinate_sql("lat", "lon")
_metres = S.haversine_sql("-12.15e0", "-77.05e0", "lat", "lon")
_state = f"CASE WHEN NOT {VALID} THEN 'coordinate_invalid' WHEN coalesce({_metres} <= 8000, false) THEN 'inside' ELSE 'outside' END"


@query("territorial_context", f"{LISTINGS} SELECT listing_id, {_state} AS scope, CASE WHEN {VALID} THEN {h(_metres, 1)} END AS metres FROM listings")
def territorial_context(spark, d):
    return C.territorial(A.listings(spark, d, "listing_id", "lat", "lon"), SCENARIO)


_ref = "label IN ('Alta', 'Media') AND coalesce(ppm > 0 AND currency = 'PEN', false)"
_share = r("(1500e0 - median)", "median")


@query("comparability_context", f"""{PL._score_sql()}, own AS (SELECT l.ppm AS price_m2, l.currency, s.score, s.label FROM listings l JOIN labelled s ON s.listing_id = l.listing_id WHERE {_state} = 'inside'),
g AS (SELECT count(*) AS in_scope, count(*) FILTER (label IN ('Alta', 'Media')) AS comparable, count(*) FILTER ({_ref.replace('ppm', 'price_m2')}) AS n, quantile_cont(CASE WHEN {_ref.replace('ppm', 'price_m2')} THEN price_m2 END, 0.5) AS median, {h('avg(score)', 1)} AS mean_score FROM own)
SELECT in_scope, comparable, n AS "references", {h('median', 2)} AS median, mean_score, CASE WHEN n < 3 THEN 'insufficient' WHEN {_share} < -0.08e0 THEN 'Entrada' WHEN {_share} > 0.08e0 THEN 'Premium' ELSE 'Alineado' END AS position FROM g""")
def comparability_context(spark, d):
    return C.comparability(A.listings(spark, d, *PL.SCORED, "currency", "district_id", "district"), SCENARIO)


_used = "coalesce(ppm > 0 AND currency = 'PEN', false)"
_q = lambda p: h(f"quantile_cont(CASE WHEN {_used} THEN ppm END, {p})", 2)


@query("agg_quantitative", f"{LISTINGS} SELECT district, count(*) AS input, count(*) FILTER ({_used}) AS used, count(*) FILTER (ppm IS NULL) AS missing, count(*) FILTER (NOT {_used} AND ppm IS NOT NULL) AS excluded, {_q(0.25)} AS p25, {_q(0.5)} AS median, {_q(0.75)} AS p75 FROM listings GROUP BY 1")
def quantitative(spark, d):
    return C.quantitative(A.listings(spark, d, "district", "ppm", "currency"))


_three_rows = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY price, listing_id) AS nth FROM listings) WHERE nth <= 3"
_rows = " UNION ALL ".join(f"SELECT listing_id, district_id, '{c}' AS field, coalesce(CAST({f'CAST({h(c, 2)} AS DECIMAL(18,2))' if c in ('price', 'area', 'ppm') else c} AS VARCHAR), 'unknown') AS value FROM three" for c in C.COMPARED)


@query("comparison_model", f"{LISTINGS}, three AS ({_three_rows}), own AS ({_rows}) SELECT *, min(value) OVER (PARTITION BY district_id, field) <> max(value) OVER (PARTITION BY district_id, field) AS differs FROM own")
def comparison_model(spark, d):
    """The three cheapest listings of each district, side by side."""
    three = L.rank_within(A.listings(spark, d), "district", 3, F.col("price"), F.col("listing_id"))
    return C.comparison(three, "district_id")


_finding = " UNION ALL ".join(
    [f"SELECT district_id, 0 AS place, 'currencies_differ' AS code, -1 AS listing_id FROM three GROUP BY 1 HAVING count(DISTINCT currency) > 1"]
    + [f"SELECT district_id, {i}, '{code}', arg_min(listing_id, ({'' if least else '-'}{c}, listing_id)) FILTER ({c} IS NOT NULL) FROM three GROUP BY 1 HAVING count(DISTINCT {c}) > 1" for i, (code, c, least) in enumerate(C.FINDINGS, 1)]
)


@query("comparison_findings", f"{LISTINGS}, three AS ({_three_rows}), f AS ({_finding}), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY district_id ORDER BY place) AS INTEGER) AS nth FROM f) SELECT district_id, nth, code, listing_id FROM n WHERE nth <= 3")
def comparison_findings(spark, d):
    """What stands out among the three cheapest listings of each district."""
    three = L.rank_within(A.listings(spark, d, "listing_id", "district", "district_id", "price", "currency", "ppm", "area", "delivery_year"), "district", 3, F.col("price"), F.col("listing_id"))
    return C.findings(three, "district_id")


@query("quadrant_summary", f"""{LISTINGS}, ok AS (SELECT * FROM listings WHERE {VALID}), top AS (SELECT district_id, CAST(row_number() OVER (ORDER BY count(*) DESC, district_id) AS INTEGER) AS rank FROM ok GROUP BY 1 ORDER BY rank LIMIT 7),
mid AS (SELECT district, quantile_cont(lat, 0.5) AS mid_lat, quantile_cont(lon, 0.5) AS mid_lon FROM ok GROUP BY 1)
SELECT o.district, concat(CASE WHEN lat >= mid_lat THEN 'N' ELSE 'S' END, CASE WHEN lon < mid_lon THEN 'W' ELSE 'E' END) AS quadrant, count(*) AS observed, count(DISTINCT agency) AS agencies, count(ppm) AS \"references\", {h('quantile_cont(ppm, 0.5)', 2)} AS median_ppm, rank
FROM ok o JOIN mid m ON m.district = o.district JOIN top t ON t.district_id = o.district_id GROUP BY 1, 2, rank""")
def quadrant_summary(spark, d):
    return C.market_summary(A.listings(spark, d, "listing_id", "district_id", "district", "agency", "lat", "lon", "ppm"))


_position = f"CASE WHEN n < 3 THEN 'insufficient' WHEN {_share} < -0.08e0 THEN 'Entrada' WHEN {_share} > 0.08e0 THEN 'Premium' ELSE 'Alineado' END"


@query("scenario_context", f"""{PL._score_sql()}, joined AS (SELECT district_id, {VALID} AS valid, l.ppm AS price_m2, score, label IN ('Alta', 'Media') AS comparable, {_ref.replace('ppm', 'l.ppm')} AS reference FROM listings l JOIN labelled s ON s.listing_id = l.listing_id),
g AS (SELECT district_id, count(*) AS in_scope, count(*) FILTER (valid) AS placed, count(*) FILTER (comparable) AS comparable, count(*) FILTER (reference) AS n, quantile_cont(CASE WHEN reference THEN price_m2 END, 0.5) AS median, {h('avg(score)', 1)} AS mean_score FROM joined GROUP BY 1),
past AS (SELECT * FROM ({PT.COUNTERS} SELECT district_id, candidates, events, shown_events, agenda, action FROM counters))
SELECT coalesce(g.district_id, -1) AS district_id, in_scope, placed, comparable, n AS "references", coalesce({h('median', 2)}, 0) AS median, mean_score, {_position} AS position, coalesce(candidates, 0) AS candidates, coalesce(events, 0) AS events, coalesce(shown_events, 0) AS shown_events, coalesce(agenda, '') AS agenda, coalesce(action, '') AS action,
CASE WHEN n < 3 THEN 'insufficient' WHEN coalesce(shown_events, 0) = 0 THEN 'without_history' WHEN placed < in_scope THEN 'partial' ELSE 'ready' END AS state FROM g LEFT JOIN past ON past.district_id IS NOT DISTINCT FROM g.district_id""")
def scenario_context(spark, d):
    return C.composed(A.listings(spark, d, *PL.SCORED, "currency", "district_id"), PL.TARGET, TL.counters(PT.timeline(spark, d)))


_policy = f"""own AS (SELECT a.field, a.event_id, a.status, a.percent, a.delta, p.ts, CASE a.status WHEN 'certified' THEN 0 WHEN 'reviewable' THEN 1 ELSE 2 END AS s, CASE WHEN p.ts > TIMESTAMP '{PH.CUTOFF}' THEN 3 WHEN {PH._age.replace('ts', 'p.ts')} < 31 THEN 0 WHEN {PH._age.replace('ts', 'p.ts')} < 91 THEN 1 ELSE 2 END AS v,
CASE p.evidence_state WHEN 'authorized' THEN 0 WHEN 'restricted' THEN 2 ELSE 3 END AS e FROM assessed a JOIN pairs p ON p.event_id = a.event_id)"""


@query("rank_history", f"{PH._assessed}, {_policy} SELECT field, event_id, status, rank FROM (SELECT field, event_id, status, CAST(row_number() OVER (PARTITION BY field ORDER BY s, v, e, abs(coalesce(percent, delta, 0)) DESC, ts DESC, event_id) AS INTEGER) AS rank FROM own) WHERE rank <= 10")
def rank_history(spark, d):
    """Changes by status, validity, evidence, size, recency and id."""
    pairs = H.lag_change(A.changes(spark, d))
    own = H.assess(pairs, PH.CUTOFF).join(pairs.select("event_id", "ts", "evidence_state"), "event_id")
    age = H.age_days(F.col("ts"), PH.CUTOFF)
    rank = lambda c, *values: F.coalesce(*(F.when(F.col(c) == v, F.lit(k)) for k, v in values), F.lit(values[-1][0] + 1))
    validity = F.when(age < 0, 3).when(age < 31, 0).when(age < 91, 1).otherwise(2)
    size = F.abs(F.coalesce("percent", "delta", F.lit(0.0)))
    order = (rank("status", (0, "certified"), (1, "reviewable")), validity, rank("evidence_state", (0, "authorized"), (2, "restricted")), F.desc(size), F.desc("ts"), F.col("event_id"))
    return L.rank_within(own, "field", 10, *order).select("field", "event_id", "status", "rank")


_preliminary = "value <> previous AND previous > 0 AND value > 0 AND currency = 'PEN' AND previous_ts < ts AND abs(percent) <= 30"


@query("history_preliminary", f"{PH._pairs} SELECT event_id, percent FROM pairs WHERE {_preliminary}")
def history_preliminary(spark, d):
    return H.lag_change(A.changes(spark, d)).where(_preliminary).select("event_id", "percent")


@query("change_event", f"{PH._assessed}, e AS (SELECT event_id, unnest(string_split(reasons, ',')) AS code FROM assessed WHERE reasons <> '') SELECT event_id, code, concat('issue:', event_id, ':', replace(code, '_', '-')) AS issue_id FROM e")
def change_event(spark, d):
    own = PH.assessed(spark, d).where("reasons <> ''").select("event_id", F.explode(F.split("reasons", ",")).alias("code"))
    return own.withColumn("issue_id", F.concat(F.lit("issue:"), F.col("event_id").cast("string"), F.lit(":"), F.replace("code", F.lit("_"), F.lit("-"))))


# What an event says of itself, with the slips that a check has to find: a wrong delta or percent, or a quality that is too high.
_stored = {"stored_delta": "CASE WHEN event_id % 53 = 0 THEN delta + 1 ELSE delta END", "stored_percent": "CASE WHEN event_id % 59 = 0 THEN percent + 1 ELSE percent END", "stored_quality": "CASE WHEN event_id % 3 = 0 THEN 'certified' ELSE 'reviewable' END", "stored_issue": "CASE WHEN event_id % 2 = 0 THEN 'EXTREME_CHANGE_REVIEW' END"}
#: What an event's two observations have to agree on; some of them don't.
SAME = {
    "currency": A.STATE["currency"], "semantic": A.STATE["semantic"], "unit": "CASE WHEN event_id % 41 = 3 THEN 'm2' ELSE 'PEN' END", "price_type": "CASE event_id % 47 WHEN 0 THEN NULL WHEN 1 THEN 'list' ELSE 'from' END", "area_type": "CASE WHEN event_id % 61 = 5 THEN 'built' ELSE 'total' END",
    "typology": "CASE WHEN event_id % 67 = 8 THEN NULL ELSE 'home' END", "transform": "CASE WHEN event_id % 71 = 9 THEN 'index' ELSE 'none' END", "origin": "CASE WHEN event_id % 73 = 10 THEN 'feed' ELSE 'snapshot' END",
}
#: The evidence that an event gives for its cause, for some events.
_cause = "CASE WHEN event_id % 4 = 0 THEN event_id / 4 END"
EVENT_RULES = {f"EVENT_{c.upper()}_MISMATCH": f"{c} IS DISTINCT FROM previous_{c}" for c in SAME} | {
    "EVENT_DELTA_MISMATCH": "stored_delta <> delta", "EVENT_PERCENTAGE_MISMATCH": "stored_percent <> percent OR stored_percent IS NULL AND percent IS NOT NULL", "EVENT_ZERO_BASE_ISSUE_MISSING": "previous = 0 AND stored_issue IS NULL",
    "EVENT_EXTREME_ISSUE_MISSING": "abs(percent) > 50 AND stored_issue IS NULL", "EVENT_OBSERVATION_ORDER": "previous_ts >= ts", "EVENT_QUALITY_TOO_HIGH": "stored_quality = 'certified' AND (evidence_state <> 'authorized' OR previous = 0 OR abs(percent) > 50)",
    "CAUSE_EVIDENCE_MISSING": "cause_id IS NOT NULL AND cause_permission IS NULL", "CAUSE_EVIDENCE_RESTRICTED": "cause_permission <> 'authorized'",
}
_more = (*SAME, "evidence_state")


@query("check_events", f"""{M.sql('records')}, own AS (SELECT user_id AS entity_id, event_type AS field, event_id, ts, value, {', '.join(f'{e} AS {c}' for c, e in (SAME | {'evidence_state': A.STATE['evidence_state']}).items())} FROM events),
lagged AS (SELECT *, lag(value) OVER w AS previous, lag(ts) OVER w AS previous_ts, {', '.join(f'lag({c}) OVER w AS previous_{c}' for c in _more)} FROM own WINDOW w AS (PARTITION BY entity_id, field ORDER BY ts, event_id)),
deltas AS (SELECT *, {h('value - previous', 2)} AS delta FROM lagged WHERE previous IS NOT NULL), pairs AS (SELECT *, {PH._pct} AS percent FROM deltas), causes AS (SELECT evidence_id, min(publish_permission) AS cause_permission FROM records GROUP BY 1),
stated AS (SELECT *, CAST({_cause} AS BIGINT) AS cause_id, {', '.join(f'{e} AS {c}' for c, e in _stored.items())} FROM pairs), judged AS (SELECT s.*, cause_permission FROM stated s LEFT JOIN causes ON evidence_id = cause_id) {K.broken_sql('event_id', 'judged', **EVENT_RULES)}""")
def check_events(spark, d):
    """Events against the two observations that they name, what they state of the change, and the evidence for its cause."""
    events = A.table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("field"), "event_id", "ts", "value", *(F.expr(e).alias(c) for c, e in SAME.items()), F.expr(A.STATE["evidence_state"]).alias("evidence_state"))
    own = H.lag_change(events, _more).select("*", F.expr(_cause).cast("long").alias("cause_id"), *(F.expr(e).alias(c) for c, e in _stored.items()))
    causes = M.read(spark, d, "records").groupBy(F.col("evidence_id").alias("cause_id")).agg(F.min("publish_permission").alias("cause_permission"))
    return K.broken(own.join(causes, "cause_id", "left"), "event_id", **EVENT_RULES)


@query("norm_confidence", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'unknown' END AS confidence FROM orders")
def norm_confidence(spark, d):
    p = F.col("o_orderpriority")
    return A.table(spark, d, "orders").select("o_orderkey", F.when(p.isin("1-URGENT", "2-HIGH"), "high").when(p == "3-MEDIUM", "medium").when(p == "5-LOW", "low").otherwise("unknown").alias("confidence"))


_version = "CASE p_size % 7 WHEN 0 THEN concat('2.', p_size // 10, '.', p_size % 10) WHEN 1 THEN concat('2.', p_size // 10) WHEN 2 THEN concat('v2.', p_size // 10, '.0') WHEN 3 THEN concat('3.', p_size // 10, '.0') WHEN 4 THEN '' ELSE concat('2.', p_size // 10, '.', p_size % 10, '-rc') END"
_three = "regexp_extract(v, '^([0-9]+)[.]([0-9]+)[.]([0-9]+)$', {})"


@query("version_gate", f"WITH a AS (SELECT p_partkey, {_version} AS v FROM part), n AS (SELECT p_partkey, {', '.join(f'TRY_CAST({_three.format(i)} AS INTEGER) AS n{i}' for i in (1, 2, 3))} FROM a) SELECT p_partkey, coalesce(n1 > 2 OR n1 = 2 AND (n2 > 2 OR n2 = 2 AND n3 >= 4), false) AS available FROM n")
def version_gate(spark, d):
    """Whether a version is 2.2.4 or later; one that isn't three numbers isn't."""
    own = A.table(spark, d, "part").select("p_partkey", F.expr(_version.replace("//", "div")).alias("v")).select("p_partkey", *(F.expr(f"TRY_CAST({_three.format(i)} AS INTEGER)").alias(f"n{i}") for i in (1, 2, 3)))
    return own.select("p_partkey", F.coalesce(F.expr("n1 > 2 OR n1 = 2 AND (n2 > 2 OR n2 = 2 AND n3 >= 4)"), F.lit(False)).alias("available"))


@query("scan_csv", f"{LISTINGS} SELECT CAST(listing_id AS VARCHAR) AS listing_id, agency, district, typology FROM listings")
def scan_csv(spark, d):
    path, names = scratch.path(spark, "files"), ["listing_id", "agency", "district", "typology"]
    A.listings(spark, d, *names).select(F.col("listing_id").cast("string").alias("listing_id"), *names[1:]).write.csv(path, header=True, escape='"')
    return files.scan_csv(spark, path, names)


@query("sink_payload_json", "SELECT p_partkey, p_name, p_size FROM part")
def sink_payload(spark, d):
    path = scratch.path(spark, "files")
    files.sink_json(A.table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path, "p_partkey")
    return spark.read.schema("p_partkey long, p_name string, p_size int").json(path)
