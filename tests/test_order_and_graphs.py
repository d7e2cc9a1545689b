"""Order over ranges and peeling of graphs, against plain loops."""

import random

from pyspark.sql import functions as F

from terraza.operators import graphs as G
from terraza.operators import ordered as O


def test_lag_crosses_ranges(spark):
    """One group holds most rows, so it lies in all ranges; groups may be null."""
    pick = random.Random(5)
    rows = [("hot" if pick.random() < 0.8 else pick.choice(["a", None, "z"]), pick.choice([None, *range(300)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, t int, id int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: (r["before"], r["t_before"]) for r in O.lagged(df, ["g"], ["t", "id"], before="id", t_before="t").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = {}, {}
    for g, t, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[i], last[g] = last.get(g, (None, None)), (i, t)
    assert got == want


def test_breaks_anywhere_are_found(spark):
    ids = list(range(3000))
    for at in (0, 999, 1500, 2998):
        ids[at], ids[at + 1] = ids[at + 1], ids[at]
    df = spark.createDataFrame([("c", i, p) for p, i in enumerate(ids)] + [("d", 5, 1), ("d", 3, 1)], "c string, id long, position long").repartition(5)
    got = {(r["c"], r["id"], r["before"]) for r in O.out_of_order(df, ["c"], "position", "id").collect()}
    assert got == {("c", at, at + 1) for at in (0, 999, 1500, 2998)} | {("d", 3, 5)}
    assert O.out_of_order(df.where("false"), ["c"], "position", "id").count() == 0


def test_rank_counts_every_row(spark):
    rows = [(i, None if i % 11 == 0 else float(i * 7919 % 501)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(6)
    for way in ("asc", "desc"):
        got = [r["id"] for r in O.ranked(df, {"x": way, "id": "asc"}).orderBy("rank").collect()]
        assert got == [i for i, x in sorted(rows, key=lambda r: (r[1] is None, (r[1] or 0) * (1 if way == "asc" else -1), r[0]))]
    assert O.ranked(df, {"x": "asc", "id": "asc"}).agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()[:] == (1, 1000, 1000)


def graph(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_components(spark):
    pick = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(400)] + [(pick.randrange(2000, 2400), pick.randrange(2000, 2400)) for _ in range(250)] + [(5000, 5000), (None, 7)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    assert {tuple(r) for r in G.components(graph(spark, edges)).collect()} == {(x, root(x)) for x in top}


def test_a_long_cycle_is_left_and_all_chains_go(spark):
    cycle, tail, ending = [(i, (i + 1) % 40) for i in range(40)], [(100 + i, 101 + i if i < 6 else 3) for i in range(7)], [(i, i + 1) for i in range(200, 212)]
    bridge = [(500, 501), (501, 500), (501, 510), (510, 520), (520, 521), (521, 520), (521, 530)]  # 510 lies between two cycles
    got = {tuple(r) for r in G.cyclic(graph(spark, cycle + tail + ending + bridge + [(900, 900), (7, 200), (None, 3)])).collect()}
    assert got == {(i, 0, 40) for i in range(40)} | {(i, 500, 5) for i in (500, 501, 510, 520, 521)} | {(900, 900, 1)}
    assert G.cyclic(graph(spark, ending)).count() == 0


def test_nodes_are_not_broadcast(spark, monkeypatch):
    plans, own = [], G.written
    monkeypatch.setattr(G, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, name))
    assert G.cyclic(graph(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])).count() == 3
    assert len(plans) > 5 and not [p for p in plans if "Broadcast" in p]
