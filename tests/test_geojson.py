"""Collections read by many tasks, whatever stands in their strings, and written as the same bytes."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from terraza.sources import geojson


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def collection(n, seed):
    pick = random.Random(seed)
    odd = ['a "quoted" {brace}', "back\\slash\\\\ }", '"}]', "é漢", "{", "[[", '\\"', "", 'x{"type":"Feature"}']
    features = [{"type": "Feature", "properties": {"relation": str(i), "name": pick.choice(odd), "more": [{"k": pick.choice(odd)}, [pick.choice(odd)] * pick.choice((0, 3, 60 if i % 40 == 0 else 1))]}, "geometry": {"type": pick.choice(("Polygon", "MultiPolygon", "Point")), "coordinates": [[[i, 1.5], [2, 3]]]}} for i in range(n)]
    return {"type": "FeatureCollection", "crs": {"properties": {"name": "} {"}}, "features": features, "after": [{"type": "other"}]}


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_every_feature_is_read_once(spark, small_ranges, tmp_path, layout):
    whole = {f"{k}.json": collection(n, k) for k, n in ((1, 150), (2, 1), (3, 0))}
    for name, c in whole.items():
        (tmp_path / name).write_text(json.dumps(c, **layout), encoding="utf-8")
    got = geojson.features(spark, str(tmp_path))
    found = [json.loads(r["feature"]) for r in got.collect()]
    assert sorted(json.dumps(f, sort_keys=True) for f in found if f.get("type") == "Feature") == sorted(json.dumps(f, sort_keys=True) for c in whole.values() for f in c["features"])
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20  # so features and strings are cut all over


def test_scan_and_sink(spark, small_ranges, tmp_path):
    own = collection(60, 9)["features"]
    rows = spark.createDataFrame([(i, json.dumps(f, separators=(",", ":"))) for i, f in enumerate(own)], "relation long, feature string")
    said = []
    for k, n in enumerate((1, 7)):
        geojson.sink(rows.repartition(n), f"{tmp_path}/out{k}")
        said.append("".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{tmp_path}/out{k}/part-*"))))
    assert said[0] == said[1] and [f["properties"]["relation"] for f in json.loads(said[0])["features"]] == [str(i) for i in range(60)]
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "one.json").write_text(said[0], encoding="utf-8")
    got = {r["relation"]: (r["name"], r["kind"], json.loads(r["coordinates"])) for r in geojson.scan(spark, f"{tmp_path}/again").collect()}
    assert got == {f["properties"]["relation"]: (f["properties"]["name"], f["geometry"]["type"], f["geometry"]["coordinates"]) for f in own if f["geometry"]["type"] != "Point"}
    (tmp_path / "again" / "two.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f for f in own if f["geometry"]["type"] != "Point"][:1]}), encoding="utf-8")
    with pytest.raises(ValueError, match="occurs 2 times"):
        geojson.scan(spark, f"{tmp_path}/again")
    geojson.sink_many(rows, f"{tmp_path}/many", 25)
    each = [json.loads(open(p, encoding="utf-8").read())["features"] for p in sorted(glob.glob(f"{tmp_path}/many/nth=*/part-*"))]
    assert [len(e) for e in each] == [25, 25, 10] and [f["properties"]["relation"] for e in each for f in e] == [str(i) for i in range(60)]
    geojson.sink(rows.where("false"), f"{tmp_path}/none")
    assert json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/none/part-*")))) == {"features": [], "type": "FeatureCollection"}
    assert geojson.features(spark, f"{tmp_path}/none").select(F.count("*")).first()[0] == 0
