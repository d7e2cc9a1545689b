"""Registry, merged projects, exact matches and fingerprints of sets, on small tables with every case."""

import pytest
from pyspark.sql import functions as F

from terraza.operators import identity as I
from terraza.operators import sets as E


def test_registry(spark):
    rows = [("Uno S.A.", "uno.pe"), ("UNO S A", "uno.pe"), ("Dos", "comun.pe"), ("Tres", "comun.pe"), ("Cuatro", "par.pe"), ("Cinco", "par.pe"), ("Seis", "par.pe"), ("Siete", None), ("--", "x.pe"), ("Ocho", ""), ("Dos", "dos.pe")]
    allowed = spark.createDataFrame([("cuatro", "Cinco"), ("CINCO", "seis")], "a string, b string")
    got = {(r["source_name"], r["domain"]): (r["agency_id"], r["resolution"]) for r in I.registry(spark.createDataFrame(rows, "n string, d string"), "n", "d", allowed).collect()}
    assert got[("Uno S.A.", "uno.pe")] == got[("UNO S A", "uno.pe")] == ("agency:uno-s-a", "resolved")  # one normalized name
    assert {got[(n, "par.pe")] for n in ("Cuatro", "Cinco", "Seis")} == {("agency:cinco", "resolved")}  # a chain of allowed pairs
    assert got[("Dos", "comun.pe")] == got[("Tres", "comun.pe")] == got[("Dos", "dos.pe")] == (None, "manual_review")
    assert got[("Siete", None)] == ("agency:siete", "resolved") and got[("Ocho", None)] == ("agency:ocho", "resolved") and len(got) == 10


def test_merged_projects(spark):
    listed = spark.createDataFrame([("p1", "a", "one", "old"), ("p2", None, "two", "old"), ("p3", "a", "three", "old"), ("p4", "a", "four", "old")], "project_id string, agency_id string, name string, status string")
    controlled = spark.createDataFrame([("p1", "a", "x", "new", "CT-G"), ("p3", "a", "x", "new", "CT-A"), ("p4", "a", "x", "new", "CT-G"), ("p4", "a", "y", "new", "CT-G"), ("p9", "b", "nine", "new", "CT-A")], "project_id string, agency_id string, name string, status string, case_id string")
    got = I.merged_projects(listed, controlled, ("CT-G",))
    assert {r["project_id"]: (r["name"], r["status"], r["origin"]) for r in got.collect()} == {"p1": ("one", "new", "merged"), "p2": ("two", "old", "unresolved"), "p3": ("three", "old", "collision"), "p4": ("four", "old", "collision"), "p9": ("nine", "new", "controlled")}
    with pytest.raises(ValueError, match="2 collisions: p3, p4"):
        I.raised(got.where("origin = 'collision'").select("project_id"), "collisions")
    I.raised(got.where("false"), "collisions")


def test_exact_matches(spark):
    left = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, 8), (None, 7)], "key long, agency_id long")
    right = spark.createDataFrame([(10, 7), (11, 7), (12, None)], "key long, agency_id long")
    rows = [(1, 7, "match_high", 1, 10, True, False), (2, 7, "match_high", 1, 10, True, False), (3, 7, "match_high", 2, 10, True, False), (4, 7, "match_high", 1, 99, False, True), (5, None, "match_medium", 1, 10, True, False), (6, 7, "match_medium", 3, 11, True, True), (7, 7, "match_high", 1, 12, True, None), (8, 7, "match_high", None, 10, True, False)]
    df = spark.createDataFrame(rows, "match_id long, agency_id long, match_class string, left_key long, right_key long, confirmed boolean, review boolean")
    judged = I.exact_matches(df, left, right)
    assert {r["match_id"]: r["reasons"] for r in judged.collect()} == {
        1: [], 2: [], 3: ["LEFT_JOIN_COUNT"], 4: ["MATCHED_ON_AGENCY_NOT_TRUE", "RIGHT_JOIN_COUNT", "HIGH_REQUIRES_HUMAN_REVIEW"], 5: ["MATCH_AGENCY_UNRESOLVED"], 6: ["LEFT_AGENCY_MISMATCH"], 7: ["HIGH_REQUIRES_HUMAN_REVIEW", "RIGHT_AGENCY_MISMATCH"], 8: ["LEFT_JOIN_COUNT"],
    }
    assert [tuple(r) for r in I.kept_matches(judged).collect()] == [(7, "match_high", 1, 10, 1)]
    assert {r["match_id"] for r in I.contradictions(judged).collect()} == {3, 4, 7, 8}
    with pytest.raises(ValueError, match="4 contradictions"):
        I.raised(I.contradictions(judged), "contradictions")


def test_fingerprints_tell_sets_apart(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    sets = {"a": df, "b": df.orderBy(F.desc("x")), "c": df.where("g < 2").withColumn("x", F.when(F.col("x") == 4, 5000).otherwise(F.col("x")))}
    prints = None
    for name, s in sets.items():
        own = E.fingerprints(s, ["g"], "x").withColumn("who", F.lit(name))
        prints = own if prints is None else prints.unionByName(own)
    assert {r["g"]: (r["distinct_sets"], r["missing"], r["agree"]) for r in E.agreement(prints, ["g"], "who", tuple(sets)).collect()} == {0: (1, 0, True), 1: (2, 0, False), 2: (1, 1, False)}
