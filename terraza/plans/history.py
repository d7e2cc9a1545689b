"""Queries on change history."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import history as H
from terraza.operators import ordered as O
from terraza.registry import query
from terraza.sources import adapter as A

CUTOFF = "2024-06-30 00:00:00"
_pct = S.half_up_sql(S.ratio_sql("delta * 100", "previous"), 2)
_lags = ", ".join(f"lag({c}) OVER w AS previous_{c}" for c in ("currency", "evidence_state", "semantic"))
_pairs = f"""WITH {A.CHANGES_SQL}, lagged AS (SELECT *, lag(value) OVER w AS previous, lag(ts) OVER w AS previous_ts, {_lags} FROM changes WINDOW w AS (PARTITION BY entity_id, field ORDER BY ts, event_id)),
deltas AS (SELECT *, {S.half_up_sql('value - previous', 2)} AS delta FROM lagged WHERE previous IS NOT NULL), pairs AS (SELECT *, {_pct} AS percent FROM deltas)"""
_open = "evidence_state = 'authorized' AND previous_evidence_state = 'authorized'"
_why = S.reasons_sql(
    base_zero="previous = 0", extreme_change="abs(percent) > 30", unknown_currency="currency <> 'PEN' OR previous_currency <> 'PEN'", invalid_date_order="ts <= previous_ts", semantic_mismatch="semantic <> 'price' OR previous_semantic <> 'price'",
    entity_mismatch="NOT resolved", evidence_missing=f"NOT ({_open}) AND evidence_state <> 'restricted' AND previous_evidence_state <> 'restricted'", restricted="evidence_state = 'restricted' OR previous_evidence_state = 'restricted'",
    outside_cutoff=f"ts > TIMESTAMP '{CUTOFF}'", duplicate="duplicate",
)
_assessed = f"""{_pairs}, why AS (SELECT *, {_why} AS codes FROM pairs), assessed AS (SELECT event_id, entity_id, field, delta, percent, array_to_string(codes, ',') AS reasons,
CASE WHEN len(list_filter(codes, lambda r: r NOT IN ('base_zero', 'extreme_change'))) > 0 THEN 'insufficient' WHEN len(codes) > 0 THEN 'reviewable' ELSE 'certified' END AS status, CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'unchanged' END AS direction FROM why)"""


def assessed(spark, d):
    return H.assess(H.lag_change(A.changes(spark, d)), CUTOFF)


@query("lag_price_change", f"{_pairs} SELECT event_id, entity_id, field, ts, value, previous, previous_ts, delta, percent FROM pairs")
def lag_change(spark, d):
    return H.lag_change(A.changes(spark, d)).select("event_id", "entity_id", "field", "ts", "value", "previous", "previous_ts", "delta", "percent")


@query("history_assess", f"{_assessed} SELECT * FROM assessed")
def assess(spark, d):
    return assessed(spark, d)


_placed = "assessed JOIN supplier ON s_suppkey = entity_id JOIN nation ON n_nationkey = s_nationkey"


@query("agg_history_coverage", f"""{_assessed}, own AS (SELECT n_name AS district, status, reasons FROM {_placed}), r AS (SELECT district, unnest(string_split(reasons, ',')) AS reason FROM own WHERE status = 'insufficient'), top AS (SELECT district, arg_min(reason, (-n, reason)) AS reason FROM (SELECT district, reason, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT o.district, count(*) AS candidates, count(*) FILTER (status <> 'insufficient') AS materialized, count(*) FILTER (status = 'certified') AS certified, count(*) FILTER (status = 'reviewable') AS reviewable, count(*) FILTER (status = 'insufficient') AS insufficient, max(reason) AS first_reason FROM own o LEFT JOIN top t ON t.district = o.district GROUP BY 1""")
def coverage(spark, d):
    """Counts of each district's pairs by status, and the commonest reason against one."""
    places = A.table(spark, d, "supplier").join(A.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("entity_id"), F.col("n_name").alias("district"))
    own = assessed(spark, d).join(places, "entity_id").select("district", "status", "reasons")
    counts = H.coverage(own, "district")
    reasons = own.where("status = 'insufficient'").select("district", F.explode(F.split("reasons", ",")).alias("reason")).groupBy("district", "reason").agg(F.count("*").alias("n"))
    first = reasons.groupBy("district").agg(F.min_by("reason", F.struct(-F.col("n"), "reason")).alias("first_reason"))
    return counts.join(first, "district", "left")


@query("reason_histogram", f"{_assessed}, r AS (SELECT unnest(string_split(reasons, ',')) AS reason FROM assessed WHERE reasons <> '') SELECT reason, count(*) AS n FROM r GROUP BY 1")
def reason_histogram(spark, d):
    return H.reason_counts(assessed(spark, d))


@query("top_price_changes", f"{_assessed} SELECT event_id, entity_id, field, percent FROM assessed WHERE percent IS NOT NULL ORDER BY abs(percent) DESC, event_id LIMIT 15")
def top_changes(spark, d):
    return H.largest(assessed(spark, d), 15)


@query("rank_agenda", f"""{_assessed}, narrow AS (SELECT * REPLACE (concat(field, ':', entity_id) AS field) FROM assessed), own AS (SELECT * FROM narrow WHERE status IN ('certified', 'reviewable') AND percent IS NOT NULL), best AS (SELECT field, min(status) AS status FROM own GROUP BY 1),
r AS (SELECT o.field, o.status, o.event_id, o.percent, CAST(row_number() OVER (PARTITION BY o.field ORDER BY abs(o.percent) DESC, o.event_id) AS INTEGER) AS rank FROM own o JOIN best b ON b.field = o.field AND b.status = o.status), f AS (SELECT * FROM r WHERE rank <= 3)
SELECT e.field, coalesce(f.status, 'expand_or_review_scope') AS status, concat('agenda:', coalesce(CAST(event_id AS VARCHAR), 'history-expand-or-review-scope')) AS item_id, percent, coalesce(rank, 1) AS rank FROM (SELECT DISTINCT field FROM narrow) e LEFT JOIN f ON f.field = e.field""")
def agenda(spark, d):
    """Agendas of each entity and kind of change: some have certified changes, some only reviewable ones, some none."""
    return H.agenda(assessed(spark, d).withColumn("field", F.concat("field", F.lit(":"), F.col("entity_id").cast("string"))))


_age = f"((epoch_us(TIMESTAMP '{CUTOFF}') - epoch_us(ts)) / 86400e6)"
for _name, _days, _whole in (("validity_build", f"floor({_age})", True), ("validity_runtime", _age, False)):
    query(_name, f"WITH {A.CHANGES_SQL} SELECT event_id, CASE WHEN {_days} IS NULL OR {_days} < 0 THEN 'unknown' WHEN {_days} <= 30 THEN 'current' WHEN {_days} <= 90 THEN 'aging' ELSE 'historical' END AS validity FROM changes")(
        lambda spark, d, w=_whole: H.validity(A.changes(spark, d), CUTOFF, w)
    )


@query("history_index", f"WITH {A.CHANGES_SQL} SELECT entity_id, event_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY event_id) AS INTEGER) AS nth FROM changes")
def history_index(spark, d):
    own = O.ranked(A.changes(spark, d).select("entity_id", "event_id"), {"event_id": "asc"}, by=("entity_id",), name="nth")
    return own.select("entity_id", "event_id", F.col("nth").cast("int").alias("nth"))


@query("direction", f"{_assessed} SELECT field, direction, count(*) AS n FROM assessed GROUP BY 1, 2")
def direction(spark, d):
    return assessed(spark, d).groupBy("field", "direction").agg(F.count("*").alias("n"))
