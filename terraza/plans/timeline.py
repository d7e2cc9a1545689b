"""Queries on the price history of projects: a source row of each listing, what is materialized of it, and each district's timeline."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import timeline as L
from terraza.registry import query
from terraza.sources import adapter as A

CUTOFF = "1998-03-31 00:00:00"
#: A source row of each listing; some projects have two, some prices didn't change, and some rows lack what a rule needs.
ROW = {
    "project_id": "CASE WHEN o_orderkey % 83 = 7 THEN NULL WHEN o_orderkey % 41 = 1 THEN o_orderkey - 1 ELSE o_orderkey END", "row_id": "o_orderkey", "district_id": "CASE WHEN o_custkey % 25 < 24 THEN o_custkey % 25 END",
    "previous_value": "CASE o_orderkey % 10 WHEN 0 THEN o_totalprice WHEN 1 THEN NULL WHEN 2 THEN 0e0 WHEN 3 THEN o_totalprice * 1.6e0 ELSE o_totalprice * (1 + (o_orderkey % 13 - 6) / 100e0) END",
    "value": "CASE WHEN o_orderkey % 37 <> 5 THEN o_totalprice END", "currency": "CASE WHEN o_orderkey % 17 = 3 THEN 'USD' WHEN o_orderkey % 19 > 0 THEN 'PEN' END",
    "evidence_state": "CASE o_orderkey % 29 WHEN 0 THEN 'restricted' WHEN 1 THEN 'missing' WHEN 2 THEN NULL ELSE 'authorized' END",
}
_days = "o_orderkey % 120 - 5"


def source(spark, d):
    known = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("canonical", F.lit(True))
    at = {"ts": "CAST(o_orderdate AS TIMESTAMP_NTZ)", "previous_ts": f"CAST(o_orderdate AS TIMESTAMP_NTZ) - make_dt_interval(CAST({_days} AS INT))"}
    return A.table(spark, d, "orders").join(known, "o_orderkey", "left").selectExpr(*(f"{e} AS {c}" for c, e in (ROW | at).items()), "coalesce(canonical, false) AS canonical")


def candidates(spark, d):
    return L.candidates(source(spark, d), CUTOFF)


_source = f"source AS (SELECT {', '.join(f'{e} AS {c}' for c, e in ROW.items())}, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_orderdate AS TIMESTAMP) - to_days(CAST({_days} AS INTEGER)) AS previous_ts, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS canonical FROM orders)"
_blocking = "list_filter(codes, lambda r: r NOT IN ('base_zero', 'extreme_change'))"
_codes = S.reasons_sql(
    base_zero="previous_value = 0", extreme_change="abs(percent) > 30", unknown_currency="currency IS DISTINCT FROM 'PEN'", invalid_date_order="NOT coalesce(previous_ts < ts, false)", entity_mismatch="NOT canonical OR district_id IS NULL",
    evidence_missing="coalesce(evidence_state NOT IN ('authorized', 'restricted'), true)", restricted="evidence_state = 'restricted'", outside_cutoff=f"ts > TIMESTAMP '{CUTOFF}'", duplicate="duplicate",
)
CANDIDATES = f"""WITH {_source}, named AS (SELECT * REPLACE (coalesce(CAST(project_id AS VARCHAR), 'unknown') AS project_id) FROM source), numbered AS (SELECT *, count(*) OVER (PARTITION BY project_id) AS copies, row_number() OVER (PARTITION BY project_id ORDER BY row_id) AS nth FROM named),
one AS (SELECT *, copies > 1 AS duplicate, coalesce(previous_value <> value, false) AS changed, {S.half_up_sql('value - previous_value', 2)} AS delta FROM numbered WHERE nth = 1), two AS (SELECT *, {S.half_up_sql(S.ratio_sql('delta * 100', 'previous_value'), 2)} AS percent, changed AND coalesce(previous_value > 0 AND value > 0, false) AS positive FROM one),
three AS (SELECT *, positive AND coalesce(currency = 'PEN', false) AS in_currency, {_codes} AS codes FROM two), four AS (SELECT *, in_currency AND coalesce(previous_ts < ts, false) AS chronological, {_blocking} AS blocking FROM three),
own AS (SELECT *, chronological AND NOT duplicate AND coalesce(abs(percent) <= 30, false) AS preliminary, CASE WHEN changed THEN array_to_string(codes, ',') END AS reasons, CASE WHEN changed THEN blocking[1] END AS primary_reason,
CASE WHEN changed THEN CASE WHEN len(blocking) > 0 THEN 'insufficient' WHEN len(codes) > 0 THEN 'reviewable' ELSE 'certified' END END AS status, CASE WHEN changed THEN CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'unchanged' END END AS direction,
CASE WHEN changed AND len(blocking) = 0 THEN concat('history:', project_id) END AS event_id FROM four)"""


@query("history_materialize", f"{CANDIDATES} SELECT project_id, coalesce(district_id, -1) AS district_id, duplicate, delta, percent, direction, status, reasons, primary_reason, event_id FROM own WHERE changed")
def history_materialize(spark, d):
    """Every changed project with its assessment: the events are those with an id, the others the exclusions; district -1 is none that is known."""
    return candidates(spark, d).where("changed").select("project_id", F.coalesce("district_id", F.lit(-1)).alias("district_id"), "duplicate", "delta", "percent", "direction", "status", "reasons", "primary_reason", "event_id")


_tests = {"changed": "changed", "positive_values": "positive", "pen_currency": "in_currency", "valid_chronology": "chronological", "within_certified_threshold": "preliminary", "canonical_within_certified_threshold": "preliminary AND canonical", "materialized_by_policy": "event_id IS NOT NULL"}


@query("history_funnel", f"{CANDIDATES} SELECT 'source_rows' AS stage, CAST(sum(copies) AS BIGINT) AS n FROM own UNION ALL " + " UNION ALL ".join(f"SELECT '{k}', count(*) FILTER ({c}) FROM own" for k, c in _tests.items()))
def history_funnel(spark, d):
    return L.funnel(candidates(spark, d))


_sums = "count(*) AS candidates, count(event_id) AS materialized, count(*) FILTER (status = 'certified') AS certified, count(*) FILTER (status = 'reviewable') AS reviewable, count(*) - count(event_id) AS excluded"


@query("history_ledger", f"{CANDIDATES} SELECT coalesce(district_id, -1) AS district_id, {_sums} FROM own WHERE changed GROUP BY 1")
def history_ledger(spark, d):
    """Each district's candidates, materialized or excluded; -1 is no known district."""
    return L.coverage(candidates(spark, d).withColumn("district_id", F.coalesce("district_id", F.lit(-1))), "district_id")


@query("history_excluded_reasons", f"{CANDIDATES} SELECT primary_reason AS reason_code, count(*) AS n FROM own WHERE changed AND event_id IS NULL GROUP BY 1")
def history_excluded_reasons(spark, d):
    return L.excluded_reasons(candidates(spark, d))


_points = "SELECT event_id, project_id, status, 'previous' AS role, previous_value AS value, previous_ts AS observed_at FROM own WHERE event_id IS NOT NULL UNION ALL SELECT event_id, project_id, status, 'current', value, ts FROM own WHERE event_id IS NOT NULL"
_details = {"observation": "'structured_snapshot_history'", "fact": "CASE WHEN status = 'certified' THEN 'historical_signal_not_current_benchmark' ELSE 'reviewable_history_signal' END", "evidence": "concat('PEN ', CAST(floor(value) AS BIGINT))"}


@query("history_records", f"{CANDIDATES}, p AS ({_points}) " + " UNION ALL ".join(f"SELECT '{k}' AS record, concat('{k}:', event_id, ':', role) AS record_id, event_id, project_id, role, value, observed_at, status, {v} AS detail FROM p" for k, v in _details.items()))
def history_records(spark, d):
    return L.records(candidates(spark, d))


#: Events as they reach a scenario: some have lost their id, or have that of another project of their district.
_arrived = "CASE WHEN CAST(project_id AS BIGINT) % 79 = 6 THEN NULL WHEN CAST(project_id AS BIGINT) % 5 = 4 AND CAST(project_id AS BIGINT) % 3 = 0 THEN concat('history:d', district_id) ELSE event_id END"
_age = f"((epoch_us(TIMESTAMP '{CUTOFF}') - epoch_us(ts)) / 86400e6)"
_case = lambda c, values: f"CASE {' '.join(f"WHEN {c} = '{v}' THEN {i}" for i, v in enumerate(values))} ELSE {len(values)} END"
TIMELINE = f"""{CANDIDATES}, arrived AS (SELECT district_id, project_id, {_arrived} AS event_id, status, direction, percent, delta, ts, CASE WHEN {_age} < 0 THEN 'unknown' WHEN {_age} <= 30 THEN 'current' WHEN {_age} <= 90 THEN 'aging' ELSE 'historical' END AS validity FROM own WHERE event_id IS NOT NULL),
firsts AS (SELECT *, min(project_id) OVER (PARTITION BY district_id, event_id) AS first FROM arrived), judged AS (SELECT *, CASE WHEN event_id IS NULL OR first <> project_id THEN 'duplicate_or_missing_event_id' END AS integrity FROM firsts),
flagged AS (SELECT *, integrity IS NULL AND status IN ('certified', 'reviewable') AND validity <> 'unknown' AND direction IN ('increase', 'decrease') AS shown FROM judged),
timeline AS (SELECT *, CASE WHEN shown THEN row_number() OVER (PARTITION BY district_id, shown ORDER BY {_case('status', L.STATUSES)}, {_case('validity', L.VALIDITIES)}, abs(coalesce(percent, delta, 0)) DESC, ts DESC, event_id, project_id) END AS rank FROM flagged)"""


def timeline(spark, d):
    events = candidates(spark, d).where("event_id is not null").withColumn("event_id", F.expr(_arrived))
    return L.context(events.select("district_id", "project_id", "event_id", "status", "direction", "percent", "delta", "ts"), CUTOFF, validities=L.VALIDITIES[:3])


@query("history_context", f"{TIMELINE} SELECT district_id, project_id, event_id, status, validity, direction, integrity, shown, coalesce(rank, 0) AS rank FROM timeline")
def history_context(spark, d):
    """Every event of every district's scenario: shown, in its place, filtered out, or excluded for its id; those not shown have rank 0."""
    return timeline(spark, d).select("district_id", "project_id", "event_id", "status", "validity", "direction", "integrity", "shown", F.coalesce("rank", F.lit(0)).alias("rank"))


COUNTERS = f"""{TIMELINE}, counts AS (SELECT district_id, count(*) AS candidates, count(*) FILTER (integrity IS NULL) AS events, count(integrity) AS integrity_excluded, count(*) FILTER (shown) AS shown_events, count(*) FILTER (integrity IS NULL AND NOT shown) AS filtered_out,
{', '.join(f"count(*) FILTER (integrity IS NULL AND status = '{s}') AS {s}" for s in L.STATUSES[:2])}, {', '.join(f"count(*) FILTER (integrity IS NULL AND validity = '{v}') AS {v}_events" for v in L.VALIDITIES)}, count(*) FILTER (shown AND status = 'certified') AS sure FROM timeline GROUP BY 1),
agendas AS (SELECT t.district_id AS of, string_agg(concat('agenda:', event_id), ',' ORDER BY rank) AS agenda FROM timeline t JOIN counts c ON c.district_id = t.district_id WHERE shown AND rank <= 3 AND (sure = 0 OR status = 'certified') GROUP BY 1),
counters AS (SELECT * EXCLUDE (of, sure, agenda), coalesce(agenda, 'agenda:history-expand-or-review-scope') AS agenda, CASE WHEN sure > 0 THEN 'review_observed_change' WHEN agenda IS NOT NULL THEN 'validate_signal' ELSE 'expand_or_review_scope' END AS action FROM counts LEFT JOIN agendas ON of = district_id)"""


@query("history_context_coverage", f"{COUNTERS} SELECT * FROM counters")
def history_context_coverage(spark, d):
    return L.counters(timeline(spark, d))
