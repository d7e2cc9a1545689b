"""Ledgers, violations and dossiers of cases, on a small table with every branch."""

import pytest
from pyspark.sql import functions as F

from terraza.operators import cases as K
from terraza.operators import checks as C

LISTS = {"fact": "facts", "observation": "seen", "source": "sources"}


@pytest.fixture(scope="module")
def known(spark):
    facts = spark.createDataFrame([(1, 10, 100, "certified"), (2, 10, 100, "certified"), (3, 11, 101, "conflict"), (4, 12, 102, "reviewable"), (5, 13, 103, "certified"), (5, 13, 104, "conflict")], "id long, seen long, source long, quality string")
    seen = spark.createDataFrame([(k,) for k in (10, 11, 12, 13)], "id int")
    sources = spark.createDataFrame([(k, k == 102) for k in range(100, 106)], "id long, hidden boolean")
    return C.union([K.records("fact", facts, "id", {"observation": "seen", "source": "source"}, "quality"), K.records("observation", seen, "id"), K.records("source", sources, "id", exposed="hidden")])


ROWS = [
    (1, [1, 2], [10], [100], "x"),  # whole
    (2, [3], [11], [101], "x"),  # a fact in conflict
    (3, [4, 4], [12], [102], "x"),  # listed twice, and a source that is exposed
    (4, [1], [11], [100, 105], "x"),  # an observation and a source that nothing cites, and one that is not listed
    (5, [99, None], None, [], "x"),  # no record, and no id
    (6, [5], [13], [103, 104], "x"),  # two records with one id
    (7, None, None, None, "x"),  # lists nothing
    (8, [1], [10], None, "x"), (8, [2], None, [100], "x"),  # one case in two rows
]


@pytest.fixture(scope="module")
def members(spark, known):
    return K.ledger(spark.createDataFrame(ROWS, "case_id int, facts array<int>, seen array<long>, sources array<long>, kind string"), LISTS, known)


def test_ledger(members):
    got = {tuple(r)[:3]: (r["times"], r["copies"], r["cited"], r["exposed"], r["quality"]) for r in members.collect()}
    assert got[(1, "source", 100)] == (1, 1, 2, False, None) and got[(1, "fact", 1)] == (1, 1, 0, False, "certified")
    assert got[(3, "fact", 4)] == (2, 1, 0, False, "reviewable") and got[(3, "source", 102)] == (1, 1, 1, True, None)
    assert got[(4, "observation", 10)] == (0, 0, 1, False, None) and got[(4, "source", 105)] == (1, 1, 0, False, None)
    assert got[(5, "fact", None)] == got[(5, "fact", 99)] == (1, 0, 0, False, None)
    assert got[(6, "fact", 5)] == (1, 2, 0, False, "conflict") and got[(6, "observation", 13)] == (1, 1, 2, False, None)
    assert got[(8, "source", 100)][2] == 2 and 7 not in {k[0] for k in got}


def test_violations(members):
    got = sorted(tuple(r) for r in K.violations(members.where("ref is not null")).collect())
    assert got == sorted([
        (3, "fact", 4, "LISTED_TWICE"), (3, "source", 102, "EXPOSED"), (4, "observation", 10, "OWNER_UNLISTED"), (4, "observation", 11, "NOT_CITED"), (4, "source", 105, "NOT_CITED"), (5, "fact", 99, "RECORD_MISSING"), (6, "fact", 5, "RECORD_AMBIGUOUS"),
    ])


def test_dossiers(members):
    got = {r["case_id"]: r for r in K.dossiers(members, tuple(LISTS)).collect()}
    assert {k: r["decision"] for k, r in got.items()} == {1: "certified", 2: "conflict", 3: "reviewable", 4: "reviewable", 5: "insufficient", 6: "conflict", 8: "certified"}
    assert (got[1]["fact_ids"], got[1]["observation_ids"], got[1]["codes"], got[1]["violations"]) == ("1,2", "10", "", 0)
    assert (got[4]["source_ids"], got[4]["codes"], got[4]["violations"]) == ("100,105", "NOT_CITED,OWNER_UNLISTED", 3)
    assert (got[5]["fact_ids"], got[5]["facts"], got[5]["codes"]) == ("", 0, "RECORD_MISSING")


def test_coverage_adds_up(members):
    got = {r["kind"]: r.asDict() for r in K.coverage(members).collect()}
    assert all(r["listed"] == r["found"] + r["missing"] for r in got.values())
    assert got["fact"] == {"kind": "fact", "listed": 10, "found": 8, "missing": 2, "repeated": 1, "exposed": 0, "unlisted": 0} and got["observation"]["unlisted"] == 1


def test_empty(spark, known):
    nothing = spark.createDataFrame([], "case_id int, facts array<int>, seen array<long>, sources array<long>")
    assert K.ledger(nothing, LISTS, known).count() == 0
    lonely = K.ledger(spark.createDataFrame(ROWS[:1], "case_id int, facts array<int>, seen array<long>, sources array<long>, kind string"), LISTS, known.limit(0))
    assert {r["code"] for r in K.violations(lonely).collect()} == {"RECORD_MISSING", "NOT_CITED"} and lonely.where(F.col("copies") > 0).count() == 0


def test_rows_list_what_arrays_do(spark, known):
    rows = spark.createDataFrame([(1, 1, 10, 100), (1, 2, None, 100), (2, 3, 11, None), (3, 4, 12, 102), (3, 4, 12, 102), (9, None, None, None)], "case_id int, a long, b int, c long")
    own = K.listed(rows, {"fact": "a", "observation": "b", "source": "c"}, ("observation", "source"))
    assert {tuple(r) for r in own.collect()} == {(1, "fact", 1, 1), (1, "fact", 2, 1), (1, "observation", 10, 1), (1, "source", 100, 1), (2, "fact", 3, 1), (2, "observation", 11, 1), (3, "fact", 4, 2), (3, "observation", 12, 1), (3, "source", 102, 1)}
    arrays = rows.groupBy("case_id").agg(F.collect_list("a").alias("facts"), F.collect_set("b").alias("seen"), F.collect_set("c").alias("sources"))
    ledger = K.ledger_of(own, known)
    assert {tuple(r) for r in ledger.collect()} == {tuple(r) for r in K.ledger(arrays, LISTS, known).collect()}
    plan = K.dossiers(ledger, tuple(LISTS))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("collect_list(kind") == 0 and not [x for x in plan.split("\n") if "Exchange hashpartitioning(case_id" in x and "REPARTITION" not in x]  # dossiers take the ledger's shuffle
