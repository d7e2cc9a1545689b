"""Coverage reports and composed scenarios on small tables."""

from terraza.operators import reports, scenario, scoring
from terraza.sources import files, scratch


def test_counts(spark):
    df = spark.createDataFrame([("a", True), ("a", None), (None, True), ("none", False)], "kind string, open boolean")
    got = {tuple(r)[1:3]: r["n"] for r in reports.counts(df, "things", "kind", "open").collect()}
    assert got == {("total", "all"): 4, ("kind", "a"): 2, ("kind", "none"): 2, ("open", "true"): 2, ("open", "false"): 1, ("open", "none"): 1}
    assert reports.counts(df.limit(0), "things", "kind").count() == 0


def test_report_is_written_alike(spark):
    df = reports.counts(spark.createDataFrame([(k % 3, k % 2) for k in range(30)], "a int, b int"), "things", "a", "b")
    texts = []
    for parts in (1, 7):
        path = scratch.path(spark, "report")
        files.sink_json(df.repartition(parts), path, "collection", "section", "key")
        texts.append("\n".join(r["value"] for r in spark.read.text(path).orderBy("value").collect()))
    assert texts[0] == texts[1] and len(texts[0].splitlines()) == 6


SCHEMA = "listing_id int, lat double, lon double, area double, bedrooms_min int, bedrooms_max int, typology string, delivery_year int, ppm double, currency string, district_id int"
PAST = "district_id int, candidates long, events long, shown_events long, agenda string, action string, note string"


def test_composed(spark):
    alike = lambda k, ppm, district, currency="PEN", lat=-12.15: (k, lat, -77.05, 100.0, 2, 3, "ECONOMY", 1996, ppm, currency, district)
    rows = [alike(k, 1500.0, 1) for k in range(4)] + [alike(10 + k, 1000.0, 2) for k in range(3)] + [alike(20, 1500.0, 3), alike(21, None, 3), alike(22, 1500.0, 3, "USD")]
    rows += [alike(30 + k, 2000.0, 4) for k in range(3)] + [alike(34, 2000.0, 4, lat=None)] + [alike(40, 1500.0, None)]
    past = [(1, 5, 4, 3, "a", "look", "x"), (4, 1, 1, 1, "b", "look", "x"), (None, 2, 0, 0, "c", "wait", "x"), (9, 1, 1, 1, "d", "look", "x")]
    target = scoring.Target(-12.15, -77.05, 8000.0, 100.0, 2, "ECONOMY", 1996, 1500.0)
    got = {r["district_id"]: r for r in scenario.composed(spark.createDataFrame(rows, SCHEMA), target, spark.createDataFrame(past, PAST)).collect()}
    assert {k: (r["in_scope"], r["placed"], r["references"], r["position"], r["state"]) for k, r in got.items()} == {
        1: (4, 4, 4, "Alineado", "ready"), 2: (3, 3, 3, "Premium", "without_history"), 3: (3, 3, 1, "insufficient", "insufficient"), 4: (4, 3, 4, "Entrada", "partial"), -1: (1, 1, 1, "insufficient", "insufficient"),
    }
    assert (got[1]["candidates"], got[1]["shown_events"], got[1]["agenda"]) == (5, 3, "a") and (got[2]["events"], got[2]["action"]) == (0, "") and got[-1]["agenda"] == "c" and got[3]["median"] == 1500.0


def test_findings(spark):
    rows = [(1, 1, "PEN", 10.0, 50.0, 1996), (2, 1, "USD", 9.0, 70.0, 1995), (3, 1, "PEN", None, 70.0, 1994), (4, 2, "PEN", 8.0, 60.0, 1996), (5, 2, "PEN", 8.0, 61.0, None), (6, 3, "PEN", 1.0, 1.0, 1)]
    got = scenario.findings(spark.createDataFrame(rows, "listing_id int, district_id int, currency string, ppm double, area double, delivery_year int"), "district_id").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, "currencies_differ", -1), (1, 2, "lowest_ppm", 2), (1, 3, "largest_area", 2), (2, 1, "largest_area", 5)]
