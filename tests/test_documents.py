"""JSON documents walked to any depth, what in them is private, and paths into nested columns."""

import json

from pyspark.sql import functions as F

from terraza.functions import paths as P
from terraza.operators import documents as D


def every(value, path="$", name=None):
    """(path, name, kind, value) by a plain walk."""
    if isinstance(value, dict):
        yield path, name, "object", None
        for k, v in value.items():
            yield from every(v, f"{path}.{k}", k)
    elif isinstance(value, list):
        yield path, name, "array", None
        for i, v in enumerate(value):
            yield from every(v, f"{path}[{i}]")
    elif value is None or isinstance(value, bool):
        yield path, name, "null" if value is None else "boolean", None if value is None else str(value).lower()
    else:
        yield path, name, "string" if isinstance(value, str) else "number", str(value)


def test_walk(spark):
    deep = {"x": 1}
    for i in range(12):
        deep = {"k": [deep]} if i % 2 else {"k": deep}
    texts = [{"a": [1, [2, {"b": None}]], "c": {"d": {"e": {"f": {"g": [[["end"]]]}}}}, "t": True, "n": -5}, [], {}, "x", 7, deep]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)] + [(90, "{"), (91, None), (0, '{"again": 1}')], "id int, text string")
    got = sorted(map(str, ((r["id"], r["path"], r["name"], r["kind"], r["value"]) for r in D.walk(df, "id", "text").collect())))
    want = [(i, *x) for i, t in enumerate(texts) for x in every(t)] + [(90, "$", None, "invalid", None), (91, "$", None, "invalid", None), (0, "$", None, "object", None), (0, "$.again", "again", "number", "1")]
    assert got == sorted(map(str, want))
    assert D.walk(df.where("false"), "id", "text").count() == 0


def test_private_values(spark):
    doc = {"policy": {"contains_contact_pii": False}, "work_phone": 1, "telephone": 2, "E_Mail": "none", "deep": [{"note": "mail me: a.b@c.org"}, {"note": "on Whats App"}], "raw_payloads_included": True, "contains_contact_pii": True}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id int, text string")
    got = {(r["path"], r["code"]) for r in D.private(D.walk(df, "id", "text"), "id").collect()}
    assert got == {("$.work_phone", "forbidden_key"), ("$.E_Mail", "forbidden_key"), ("$.contains_contact_pii", "forbidden_key"), ("$.deep[0].note", "email"), ("$.deep[1].note", "messaging_app")}


def test_paths(spark):
    row = {"a": {"b": [{"id": "x", "n": 1, "c": ["p", "q"]}, None, {"id": "y", "n": 2, "c": None}, {"id": "x", "n": 3, "c": ["r"]}]}, "l": [["u"], ["v", None]]}
    schema = "a struct<b: array<struct<id: string, n: int, c: array<string>>>>, l array<array<string>>"
    df = spark.createDataFrame([(row,), (None,), ({"a": None, "l": None},)], f"root struct<{schema.replace('a struct', 'a: struct', 1).replace(', l array', ', l: array')}>")
    got = lambda path: [r[0] for r in df.select(P.at(path, "root", df.schema)).collect()]
    assert got("a.b[].n")[0] == [1, None, 2, 3] and got("a.b[x].n")[0] == [1, 3] and got("a.b[x].c[]")[0] == ["p", "q", "r"] and got("a.b[].c[]")[0] == ["p", "q", "r"]
    assert got("l[]")[0] == [["u"], ["v", None]] and got("a.b[z].n")[0] == [] and got("a.none")[0] == [None] and got("a[].b")[0] == [] and got("a.b[")[0] == [] and got("l[x]")[0] == []
    assert got("a.b[].n")[1:] == [[], []] and got("a.b")[1:] == [[None], [None]]
    assert df.select(F.size(P.at("a.b[1].n", "root", df.schema))).first()[0] == 0  # numbers don't count as that string
