"""Price history of projects from source rows: candidates, events with their lineage and records, exclusions, ledgers that add up, and a scenario's timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import history as H
from terraza.operators import ordered as O
from terraza.sources.scratch import written

# The stages of the audit, each within the one before but for the last two, and the orders of status and validity.
FUNNEL = ("source_rows", "changed", "positive_values", "pen_currency", "valid_chronology", "within_certified_threshold", "canonical_within_certified_threshold", "materialized_by_policy")
STATUSES, VALIDITIES = ("certified", "reviewable", "insufficient"), ("current", "aging", "historical", "unknown")


def candidates(rows: DataFrame, cutoff: str, threshold: float = 30, currency: str = "PEN") -> DataFrame:
    """Each project's first source row with what is counted of it and, if its price changed, its assessment.

    rows: project_id, row_id, district_id, previous_value, previous_ts, value, ts, currency, evidence_state, canonical. A project with
    several rows is marked as duplicate and judged by the row with the least id; a row without a project is one of the project 'unknown'.
    copies is how many rows a project has. reasons are in order of precedence; primary_reason is the first that blocks. Whatever is null
    speaks against a change where a rule needs it.
    """
    named = rows.withColumn("project_id", F.coalesce(F.col("project_id").cast("string"), F.lit("unknown")))
    values = [c for c in rows.columns if c not in ("project_id", "row_id")]
    one = named.groupBy("project_id").agg(F.count("*").alias("copies"), F.min_by(F.struct(*values), "row_id").alias("r")).select("project_id", "copies", "r.*")
    no = lambda c: F.coalesce(c, F.lit(False))
    changed = no(F.col("previous_value") != F.col("value"))
    delta = S.half_up(F.col("value") - F.col("previous_value"), 2)
    own = one.withColumns({"duplicate": F.col("copies") > 1, "changed": changed, "positive": changed & no((F.col("previous_value") > 0) & (F.col("value") > 0)), "delta": delta})
    own = own.withColumns({"percent": S.half_up(S.ratio(F.col("delta") * 100, F.col("previous_value")), 2), "in_currency": F.col("positive") & no(F.col("currency") == currency)})
    own = own.withColumn("chronological", F.col("in_currency") & no(F.col("previous_ts") < F.col("ts")))
    own = own.withColumn("preliminary", F.col("chronological") & ~F.col("duplicate") & no(F.abs("percent") <= threshold))
    at = F.to_timestamp_ntz(F.lit(cutoff), F.lit("yyyy-MM-dd HH:mm:ss"))
    restricted = no(F.col("evidence_state") == "restricted")
    why = S.reasons(
        base_zero=F.col("previous_value") == 0, extreme_change=F.abs("percent") > threshold, unknown_currency=~no(F.col("currency") == currency), invalid_date_order=~no(F.col("previous_ts") < F.col("ts")),
        entity_mismatch=~no(F.col("canonical")) | F.col("district_id").isNull(), evidence_missing=~restricted & ~no(F.col("evidence_state") == "authorized"), restricted=restricted,
        outside_cutoff=F.col("ts").cast("timestamp_ntz") > at, duplicate=F.col("duplicate"),
    )
    blocking = F.filter(why, lambda r: ~r.isin(*H.REVIEW))
    status = F.when(F.size(blocking) > 0, "insufficient").when(F.size(why) > 0, "reviewable").otherwise("certified")
    direction = F.when(F.col("delta") > 0, "increase").when(F.col("delta") < 0, "decrease").otherwise("unchanged")
    only = lambda c: F.when(F.col("changed"), c)
    return own.withColumns({"reasons": only(F.array_join(why, ",")), "primary_reason": only(F.get(blocking, F.lit(0))), "status": only(status), "direction": only(direction), "event_id": F.when(F.col("changed") & (F.size(blocking) == 0), F.concat(F.lit("history:"), "project_id"))})


def funnel(own: DataFrame) -> DataFrame:
    """(stage, n): how many source rows, then how many projects, are left at each stage of the audit; one pass."""
    tests = {"changed": "changed", "positive_values": "positive", "pen_currency": "in_currency", "valid_chronology": "chronological", "within_certified_threshold": "preliminary", "canonical_within_certified_threshold": "preliminary and coalesce(canonical, false)", "materialized_by_policy": "event_id is not null"}
    sums = own.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("source_rows"), *(F.count_if(F.expr(c)).alias(k) for k, c in tests.items()))
    return sums.unpivot([], list(FUNNEL), "stage", "n")


def coverage(own: DataFrame, *by: str) -> DataFrame:
    """Of each group: candidates, those materialized, by status, and those excluded; candidates are materialized and excluded together."""
    there = F.col("event_id").isNotNull()
    return own.where("changed").groupBy(*by).agg(F.count("*").alias("candidates"), F.count_if(there).alias("materialized"), F.count_if(F.col("status") == "certified").alias("certified"), F.count_if(F.col("status") == "reviewable").alias("reviewable"), F.count_if(~there).alias("excluded"))


def excluded_reasons(own: DataFrame) -> DataFrame:
    """(reason_code, n): exclusions by the reason that blocks first; they add up to the excluded candidates."""
    return own.where("changed and event_id is null").groupBy(F.col("primary_reason").alias("reason_code")).agg(F.count("*").alias("n"))


def records(own: DataFrame) -> DataFrame:
    """(record, record_id, event_id, project_id, role, value, observed_at, status, detail): of each event's two points an observation, a fact and its evidence.

    detail is how an observation was taken, why a fact isn't of today's benchmark, and what the evidence says: the value's whole part. Lineage is the event_id
    that all of an event's records share.
    """
    points = F.inline(F.array(*(F.struct(F.lit(r).alias("role"), F.col(v).alias("value"), F.col(t).alias("observed_at")) for r, v, t in (("previous", "previous_value", "previous_ts"), ("current", "value", "ts")))))
    each = own.where("event_id is not null").select("event_id", "project_id", "status", points)
    why = F.when(F.col("status") == "certified", "historical_signal_not_current_benchmark").otherwise("reviewable_history_signal")
    kinds = {"observation": F.lit("structured_snapshot_history"), "fact": why, "evidence": F.concat(F.lit("PEN "), F.floor("value").cast("string"))}
    rows = F.inline(F.array(*(F.struct(F.lit(k).alias("record"), F.concat(F.lit(f"{k}:"), "event_id", F.lit(":"), "role").alias("record_id"), d.alias("detail")) for k, d in kinds.items())))
    return each.select("event_id", "project_id", "role", "value", "observed_at", "status", rows).select("record", "record_id", "event_id", "project_id", "role", "value", "observed_at", "status", "detail")


def context(events: DataFrame, cutoff: str, statuses: tuple[str, ...] = STATUSES[:2], validities: tuple[str, ...] = VALIDITIES, directions: tuple[str, ...] = ("increase", "decrease")) -> DataFrame:
    """A scenario's events with what is wrong with them, whether the filters show them, and their place in the timeline.

    events: district_id (the scenario), project_id, event_id, status, direction, percent, delta, ts. An event without an id, or with that of another project
    in the scenario with a smaller id, is an integrity exclusion. rank orders the shown ones by status, validity, size, recency and id;
    it is null for the others.
    """
    validity = F.coalesce(*(F.when(c, v) for c, v in ((F.col("age").isNull() | (F.col("age") < 0), "unknown"), (F.col("age") <= 30, "current"), (F.col("age") <= 90, "aging"))), F.lit("historical"))
    own = written(events.withColumn("age", H.age_days(F.col("ts"), cutoff)).withColumn("validity", validity).drop("age"), "events")
    first = own.where("event_id is not null").groupBy("district_id", "event_id").agg(F.min("project_id").alias("_first"))
    own = own.join(first, [own["district_id"].eqNullSafe(first["district_id"]), own["event_id"] == first["event_id"]], "left").select(own["*"], "_first")
    sound = F.coalesce(F.col("_first") == F.col("project_id"), F.lit(False))
    shown = sound & F.col("status").isin(*statuses) & F.col("validity").isin(*validities) & F.col("direction").isin(*directions)
    own = written(own.select("*", F.when(~sound, "duplicate_or_missing_event_id").alias("integrity"), F.coalesce(shown, F.lit(False)).alias("shown")).drop("_first"), "timeline")
    place = lambda c, values: "CASE " + " ".join(f"WHEN {c} = '{v}' THEN {i}" for i, v in enumerate(values)) + f" ELSE {len(values)} END"
    order = {place("status", STATUSES): "asc", place("validity", VALIDITIES): "asc", "abs(coalesce(percent, delta, 0))": "desc", "ts": "desc", "event_id": "asc", "project_id": "asc"}
    ranked = O.ranked(own.where("shown").select("district_id", "project_id", "status", "validity", "percent", "delta", "ts", "event_id"), order, by=("district_id",)).select("district_id", "project_id", "rank")
    return own.join(ranked, [own["district_id"].eqNullSafe(ranked["district_id"]), own["project_id"] == ranked["project_id"]], "left").select(own["*"], "rank")


def counters(timeline: DataFrame) -> DataFrame:
    """Of each scenario: candidates = events + integrity_excluded, and events = shown + filtered_out, by status and validity; and its agenda, at most three events."""
    sound = F.col("integrity").isNull()
    if_ = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = timeline.groupBy("district_id").agg(
        F.count("*").alias("candidates"), if_(sound).alias("events"), if_(~sound).alias("integrity_excluded"), if_(F.col("shown")).alias("shown_events"), if_(sound & ~F.col("shown")).alias("filtered_out"),
        *(if_(sound & (F.col("status") == s)).alias(s) for s in STATUSES[:2]), *(if_(sound & (F.col("validity") == v)).alias(f"{v}_events") for v in VALIDITIES),
        if_(F.col("shown") & (F.col("status") == "certified")).alias("_certified"),
    )
    # Shown events come certified first, so the three first certified ones, or else reviewable ones, are the first three places.
    top = timeline.where("shown and rank <= 3").join(counts.select(F.col("district_id").alias("_of"), "_certified"), F.col("district_id").eqNullSafe(F.col("_of")))
    top = top.where("_certified = 0 or status = 'certified'").groupBy("_of").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id"))).alias("a"))
    agenda = F.coalesce(F.array_join(F.transform("a", lambda x: F.concat(F.lit("agenda:"), x["event_id"])), ","), F.lit("agenda:history-expand-or-review-scope"))
    action = F.when(F.col("_certified") > 0, "review_observed_change").when(F.col("a").isNotNull(), "validate_signal").otherwise("expand_or_review_scope")
    return counts.join(top, F.col("district_id").eqNullSafe(F.col("_of")), "left").withColumns({"agenda": agenda, "action": action}).drop("_of", "_certified", "a")
