"""Strict scans, digests and sinks; the streaming window count."""

import hashlib


import pytest
from pyspark.sql import functions as F

from terraza.sources import files
from terraza.streaming import windows


def test_csv_keeps_quotes_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n2,\n')
    rows = files.scan_csv(spark, str(tmp_path / "a.csv"), ["id", "text"], required=True).collect()
    assert [tuple(r) for r in rows] == [("1", 'two\nlines, "quoted"'), ("2", None)]
    (tmp_path / "b.csv").write_text("id,text\n1,2,3\n")
    with pytest.raises(Exception):
        files.scan_csv(spark, str(tmp_path / "b.csv"), ["id", "text"]).collect()
    (tmp_path / "c.csv").write_text("id,text\n")
    with pytest.raises(ValueError):
        files.scan_csv(spark, str(tmp_path / "c.csv"), ["id", "text"], required=True)
    with pytest.raises(ValueError):
        files.scan_csv(spark, str(tmp_path / "c.csv"), ["id", "id"])


def test_digests(spark, tmp_path):
    (tmp_path / "g.json").write_text("{}")
    digest = hashlib.sha256(b"{}").hexdigest()
    expected = spark.createDataFrame([("g.json", digest), ("h.json", digest)], "name string, sha256 string")
    assert {tuple(r) for r in files.verify(files.digests(spark, str(tmp_path)), expected).collect()} == {("g.json", "valid"), ("h.json", "missing")}


def test_payload_is_stable_and_never_overwrites_inputs(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "z long, a string")
    files.sink_json(df, f"{tmp_path}/out", "z")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/out").orderBy(F.get_json_object("value", "$.z")).collect()] == ['{"a":null,"z":1}', '{"a":"b","z":2}']
    with pytest.raises(ValueError):
        files.sink_json(df, "/x/in/", "z", inputs=("/x/in",))


def test_stream_gives_the_batch_counts(spark):
    data = "/root/testdata/sf0.001"
    got = windows.run_available(spark, data).agg(F.sum("n"), F.countDistinct("event_type")).first()
    events = spark.read.parquet(f"{data}/events.parquet")
    assert tuple(got) == (events.count(), events.select("event_type").distinct().count())


def test_documents_fit(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert [r["a"] for r in files.scan_json(spark, str(tmp_path / "a.json"), "a int").collect()] == [1, 2]
    (tmp_path / "b.json").write_text('[{"a": 1')
    with pytest.raises(Exception):
        files.scan_json(spark, str(tmp_path / "b.json"), "a int").collect()


def test_rings_keep_corners_beyond_the_tolerance():
    import numpy as np

    from terraza.operators import rings

    rng = np.random.default_rng(1)
    for _ in range(200):
        p = rng.uniform(0, 10, (rng.integers(1, 12), 2))
        kept = rings.keep(p, 1.5)
        assert kept[0] and (kept.all() or kept.sum() >= 3)
        closed, at = np.concatenate([p, p[:1]]), [*np.flatnonzero(kept).tolist(), len(p)]
        for a, b in zip(at, at[1:], strict=False):
            for i in range(a + 1, b):  # a dropped corner lies within the tolerance of the side that took its place
                along = closed[b] - closed[a]
                t = min(1, max(0, (closed[i] - closed[a]) @ along / max(along @ along, 1e-300)))
                assert np.hypot(*(closed[i] - closed[a] - t * along)) <= 1.5
    square = np.array([[0, 0], [5, 0.1], [10, 0], [10, 10], [0, 10]], float)
    assert rings.keep(square, 1).tolist() == [True, False, True, True, True] and rings.keep(square, 0).all()


def test_rings_are_split_side_by_side_as_one_by_one(monkeypatch):
    import math
    import sys

    import numpy as np
    import pyarrow as pa

    from terraza.operators import rings

    def distance(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(p[0] - (a[0] + t * dx), p[1] - (a[1] + t * dy))

    def line(p, own, tolerance):
        if len(own) < 3:
            return set(own)
        away = [distance(p[i], p[own[0]], p[own[-1]]) for i in own[1:-1]]
        at = 1 + away.index(max(away))
        return {own[0], own[-1]} if max(away) <= tolerance else line(p, own[: at + 1], tolerance) | line(p, own[at:], tolerance)

    def one_by_one(p, tolerance):
        if len(p) < 4:
            return list(range(len(p)))
        away = [math.dist(q, p[0]) for q in p]
        far = max(1, away.index(max(away)))
        found = line(p, list(range(far + 1)), tolerance) | line(p, [*range(far, len(p)), 0], tolerance)
        return sorted(found) if len(found) > 2 else list(range(len(p)))

    # In these a corner is as far as the tolerance but for a last digit.
    for p, tolerance, stay in ([(8, 5), (9, 2), (11, 1), (2, 6), (11, 6)], 1, [0, 1, 2, 3, 4]), ([(4, 10), (1, 6), (1, 11), (6, 11)], 3, [0, 1, 2]):
        assert np.flatnonzero(rings.keep(np.array(p, float), tolerance)).tolist() == stay == one_by_one(p, tolerance)

    monkeypatch.setattr(rings.F, "arrow_udf", lambda kind: lambda drop: lambda _: drop)  # what runs in the tasks
    monkeypatch.setattr(rings, "AT_ONCE", 5_000, raising=False)
    drop, rng, calls = rings.simplified(None, 1.5), np.random.default_rng(2), 0

    def count(frame, event, _):
        nonlocal calls
        calls += event in ("call", "c_call")

    def counted(shapes):
        nonlocal calls
        column, calls = pa.array([None if p is None else [{"x": float(x), "y": float(y)} for x, y in p] for p in shapes]), 0
        before = sys.getprofile()
        sys.setprofile(count)
        try:
            found = drop(column)
        finally:
            sys.setprofile(before)
        return found.to_pylist(), calls

    shapes = [[tuple(c) for c in rng.integers(0, 12, (n, 2)).tolist()] for n in [*rng.integers(0, 12, 2_000).tolist(), 7_000, 3, 20, 1]]
    shapes[1_000] = None
    assert [[(c["x"], c["y"]) for c in r] for r in counted(shapes)[0]] == [[p[i] for i in one_by_one(p, 1.5)] for p in (p or [] for p in shapes)]
    few = [p for p in shapes if p and len(p) < 12][:50]
    assert counted(few * 10)[1] < 2 * counted(few)[1]  # rounds, not rings
