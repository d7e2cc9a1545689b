"""Price history on a small table with every reason, and ledgers that add up."""

import datetime as dt

from pyspark.sql import functions as F

from terraza.operators import timeline as L

CUTOFF = "2024-06-30 00:00:00"
DAY = [dt.datetime(2024, 5, 1) + dt.timedelta(days=k) for k in range(400)]
SCHEMA = "project_id string, row_id long, district_id int, previous_value double, previous_ts timestamp_ntz, value double, ts timestamp_ntz, currency string, evidence_state string, canonical boolean"
ROWS = [
    ("a", 1, 1, 100.0, DAY[0], 110.0, DAY[20], "PEN", "authorized", True),
    ("b", 2, 1, 100.0, DAY[0], 150.0, DAY[20], "PEN", "authorized", True),  # extreme: reviewable
    ("c", 3, 1, 0.0, DAY[0], 150.0, DAY[20], "PEN", "authorized", True),  # no base: reviewable
    ("d", 4, 1, 100.0, DAY[0], 90.0, DAY[20], "USD", "authorized", True),
    ("e", 5, 2, 100.0, DAY[20], 90.0, DAY[20], "PEN", "authorized", True),
    ("f", 6, 2, 100.0, DAY[0], 90.0, DAY[20], "PEN", "restricted", True),
    ("g", 7, 2, 100.0, DAY[0], 90.0, DAY[20], "PEN", None, True),
    ("h", 8, None, 100.0, DAY[0], 90.0, DAY[20], "PEN", "authorized", True),
    ("i", 9, 2, 100.0, DAY[0], 90.0, DAY[90], "PEN", "authorized", True),
    ("j", 10, 2, 100.0, DAY[0], 90.0, DAY[20], "PEN", "authorized", True),
    ("j", 11, 2, 100.0, DAY[0], 100.0, DAY[20], "PEN", "authorized", True),
    ("k", 12, 2, 100.0, DAY[0], 100.0, DAY[20], "PEN", "authorized", True),  # unchanged
    ("l", 13, 2, None, DAY[0], 100.0, DAY[20], "PEN", "authorized", True),
    (None, 14, 2, 100.0, DAY[0], 98.0, DAY[1], None, "missing", False),
]


def test_candidates_and_ledgers(spark):
    own = L.candidates(spark.createDataFrame(ROWS, SCHEMA), CUTOFF).cache()
    got = {r["project_id"]: (r["status"], r["reasons"], r["primary_reason"]) for r in own.collect()}
    assert got == {
        "a": ("certified", "", None), "b": ("reviewable", "extreme_change", None), "c": ("reviewable", "base_zero", None), "d": ("insufficient", "unknown_currency", "unknown_currency"), "e": ("insufficient", "invalid_date_order", "invalid_date_order"),
        "f": ("insufficient", "restricted", "restricted"), "g": ("insufficient", "evidence_missing", "evidence_missing"), "h": ("insufficient", "entity_mismatch", "entity_mismatch"), "i": ("insufficient", "outside_cutoff", "outside_cutoff"), "j": ("insufficient", "duplicate", "duplicate"),
        "k": (None, None, None), "l": (None, None, None), "unknown": ("insufficient", "unknown_currency,entity_mismatch,evidence_missing", "unknown_currency"),
    }
    assert {r["stage"]: r["n"] for r in L.funnel(own).collect()} == dict(zip(L.FUNNEL, (14, 11, 10, 8, 7, 5, 5, 3), strict=True))
    totals = L.coverage(own).first()
    assert totals["candidates"] == totals["materialized"] + totals["excluded"] == 11 and totals["materialized"] == totals["certified"] + totals["reviewable"] == 3
    assert sum(r["n"] for r in L.excluded_reasons(own).collect()) == totals["excluded"] == sum(r["excluded"] for r in L.coverage(own, "district_id").collect())
    records = L.records(own).collect()
    assert len(records) == len({r["record_id"] for r in records}) == 3 * 2 * 3 and {(r["value"], r["observed_at"]) for r in records if r["event_id"] == "history:a"} == {(100.0, DAY[0]), (110.0, DAY[20])}
    assert L.funnel(L.candidates(spark.createDataFrame([], SCHEMA), CUTOFF)).agg(F.sum("n")).first()[0] == 0


def test_timeline(spark):
    row = lambda d, p, e, status, percent, ts, direction="increase": (d, p, e, status, direction, percent, 1.0, ts)
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 20)
    rows = [row(1, "a", "e1", "certified", 5.0, new), row(1, "b", "e2", "certified", -9.0, new, "decrease"), row(1, "c", "e3", "reviewable", 50.0, new), row(1, "d", "e4", "certified", 70.0, old), row(1, "e", "e2", "certified", 1.0, new), row(1, "f", None, "certified", 1.0, new), row(1, "g", "e7", "certified", 0.0, new, "unchanged"), row(1, "h", "e8", "certified", 2.0, dt.datetime(2025, 1, 1)),
            row(2, "a", "e1", "reviewable", 5.0, old), row(3, "a", "e1", "certified", 1.0, dt.datetime(2025, 1, 1)), row(None, "a", "e1", "certified", None, new)]
    df = spark.createDataFrame(rows, "district_id int, project_id string, event_id string, status string, direction string, percent double, delta double, ts timestamp_ntz")
    own = L.context(df, CUTOFF, validities=L.VALIDITIES[:3]).cache()
    place = {(r["district_id"], r["project_id"]): (r["integrity"] is None, r["shown"], r["rank"], r["validity"]) for r in own.collect()}
    assert place == {
        (1, "a"): (True, True, 2, "current"), (1, "b"): (True, True, 1, "current"), (1, "c"): (True, True, 4, "current"), (1, "d"): (True, True, 3, "historical"), (1, "e"): (False, False, None, "current"), (1, "f"): (False, False, None, "current"),
        (1, "g"): (True, False, None, "current"), (1, "h"): (True, False, None, "unknown"), (2, "a"): (True, True, 1, "historical"), (3, "a"): (True, False, None, "unknown"), (None, "a"): (True, True, 1, "current"),
    }
    counts = {r["district_id"]: r for r in L.counters(own).collect()}
    for r in counts.values():
        assert r["candidates"] == r["events"] + r["integrity_excluded"] and r["events"] == r["shown_events"] + r["filtered_out"] == sum(r[f"{v}_events"] for v in L.VALIDITIES) == r["certified"] + r["reviewable"]
    assert {d: (r["agenda"], r["action"]) for d, r in counts.items()} == {
        1: ("agenda:e2,agenda:e1,agenda:e4", "review_observed_change"), 2: ("agenda:e1", "validate_signal"), 3: ("agenda:history-expand-or-review-scope", "expand_or_review_scope"), None: ("agenda:e1", "review_observed_change"),
    }
