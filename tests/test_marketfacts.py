"""Benchmark facts, their index and four ledgers on a small table with every case."""

import datetime as dt

import pytest

from terraza.operators import marketfacts as K

EARLY, LATE = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)
SCHEMA = "project_id long, captured_at timestamp_ntz, currency string, price double, area double, units long, parking long, attributes string"
ROWS = [
    (1, EARLY, "PEN", 300000.0, 90.0, 5, 0, "Pool GYM pool"), (2, EARLY, "USD", 100000.0, 80.0, None, None, "junk mystery"), (3, LATE, "PEN", 1.0, 1.0, 1, 1, "pool"), (4, EARLY, "PEN", 10.0, 4.0, 2, 1, None),
    (5, EARLY, "EUR", 10.0, 4.0, 0, -1, "swimming"), (6, None, "PEN", None, 4.0, 2, 1, "pool"), (7, EARLY, "PEN", -5.0, 0.0, 2, 1, ""),
]


def test_facts_index_and_ledgers(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    blocked = spark.createDataFrame([(4,), (4,), (99,)], "project_id long")
    catalog = spark.createDataFrame([("pool", "attribute:pool"), ("swimming", "attribute:pool"), ("gym", "attribute:gym-room"), ("junk", None)], "term string, attribute_id string")
    own, tokens, facts = K.materialized(rows, blocked, catalog, "2024-06-30 00:00:00")
    assert {(r["project_id"], r["token"]) for r in tokens.where("not known").collect()} == {(2, "mystery")}
    got = {(r["project_id"], r["field_name"]): (r["value"] if r["text"] is None else r["text"], r["exclusion_reason"], r["eligible"]) for r in facts.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {
        "published_price_from": (300000.0, None, True), "total_area_min": (90.0, None, True), "price_per_total_m2_orientative": (3333.33, "price_area_link_unresolved", False), "reported_unit_count": (5.0, None, True), "parking_count": (0.0, None, True),
        "attribute_pool": ("Pool", None, True), "attribute_gym_room": ("GYM", None, True),
    }
    assert got[2, "published_price_from"][1] == "currency" and got[3, "attribute_pool"][1] == "cutoff" and got[4, "total_area_min"][1] == "blocking_issue" and got[4, "parking_count"][2] and (4, "price_per_total_m2_orientative") not in got
    assert got[5, "published_price_from"][1] == "currency" and got[5, "attribute_pool"][0] == "swimming" and got[5, "reported_unit_count"][0] == 0.0 and (5, "parking_count") not in got and not any(k == (7, "total_area_min") for k in got)
    index = {r["project_id"]: r for r in K.index(own, facts).collect()}
    assert {k: r["pairing_status"] for k, r in index.items()} == {1: "project_minima_pair_unresolved", 2: "project_minima_pair_unresolved", 3: "project_minima_pair_unresolved", 4: "conflicting", 5: "missing", 6: "missing", 7: "missing"}
    assert index[4]["area_fact"] is None and index[4]["price_fact"] and index[1]["attributes"] == 2 and index[1]["ppm_fact"] == "fact:1:price_per_total_m2_orientative"
    entries = K.ledgers(own, facts)
    state = {(r["indicator"], r["project_id"]): r["reason"] or r["state"] for r in entries.collect()}
    assert [state["price_per_m2_total", i] for i in range(1, 8)] == ["price_area_link_unresolved", "currency", "cutoff", "blocking_issue", "missing", "cutoff", "missing"]
    assert [state["attributes_announced", i] for i in range(1, 8)] == ["used", "missing", "cutoff", "missing", "used", "cutoff", "missing"] and [state["parking_reported", i] for i in (1, 2, 5)] == ["used", "missing", "missing"]
    assert all(r["parted"] and r["used"] + r["missing"] + r["excluded"] == r["projects"] == 7 for r in K.coverage(entries, own).collect())
    broken = K.coverage(entries.unionByName(entries.where("project_id = 1 and indicator = 'units_reported'")), own)
    assert {r["indicator"] for r in broken.where("not parted").collect()} == {"units_reported"}
    with pytest.raises(ValueError, match="1 projects with several source rows: 1"):
        K.read(rows.unionByName(rows.where("project_id = 1")), blocked, "2024-06-30 00:00:00")


def test_entries_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(K, "TASK", 10)
    projects = spark.range(95).withColumnRenamed("id", "project_id")
    entries = projects.selectExpr("'a' AS indicator", "project_id", "'used' AS state").unionByName(projects.where("project_id > 0").selectExpr("'b' AS indicator", "project_id", "'missing' AS state")).unionByName(spark.sql("SELECT 'b' AS indicator, 1L AS project_id, 'used' AS state"))
    out = K.coverage(entries, projects)
    assert "hashpartitioning(project_id" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 10)" in plan
    assert {tuple(r) for r in out.collect()} == {("a", 95, 95, 0, 0, True), ("b", 95, 1, 94, 0, False)}
