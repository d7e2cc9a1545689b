"""Files of any content, written by rows and held against manifests: every status, by the bytes on disk."""

import hashlib
import json

import pytest

from terraza.plans import files as P
from terraza.sources import blobs, files


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_every_status(spark, tmp_path):
    webp = b"RIFF" + (22).to_bytes(4, "little") + b"WEBPVP8 " + (10).to_bytes(4, "little") + b"\0\0\0\x9d\x01\x2a" + (640).to_bytes(2, "little") + (480).to_bytes(2, "little")
    held = {"assets/a.txt": "línea\n".encode(), "assets/deep/b.json": b'{"features": []}', "assets/c.json": b'{"features": {}}', "assets/d.json": b"{", "assets/e.txt": b"\xff\xfe", "assets/f.webp": webp, "assets/g.webp": webp[:-1], "other/h.txt": b"h", "assets/empty.txt": b""}
    root = f"{tmp_path}/files"
    blobs.write(spark.createDataFrame([(k, bytearray(v)) for k, v in held.items()], "path string, content binary").repartition(3), root)
    assert all((tmp_path / "files" / k).read_bytes() == v for k, v in held.items()) and (tmp_path / "files" / "_SUCCESS").exists()
    listed = {"one": [("assets/a.txt", sha("línea".encode()), "text"), ("assets/deep/b.json", sha(held["assets/deep/b.json"]), "json"), ("assets/c.json", sha(held["assets/c.json"]), "json"), ("assets/d.json", sha(b"{"), "json"), ("assets/e.txt", sha(b"\xff\xfe"), "text")],
              "two": [("assets/f.webp", sha(webp), "webp"), ("assets/g.webp", sha(webp[:-1]), "webp"), ("other/h.txt", sha(b"h"), "text"), ("assets/../x", sha(b""), "text"), ("assets/gone.txt", sha(b""), "text"), ("assets/a.txt", sha(b"else"), "text"), ("assets/empty.txt", sha(b""), "text"), (None, None, "text")]}
    (tmp_path / "manifest.json").write_text("\n".join(json.dumps({"document": k, "assets": [dict(zip(("path", "sha256", "format"), a, strict=True)) for a in v]}) for k, v in listed.items()))
    entries = blobs.manifest(spark, f"{tmp_path}/manifest.json")
    assert {r["path"] for r in entries.where("repeated").collect()} == {"assets/a.txt"}
    got = {(r["document"], r["path"]): r for r in blobs.checked(entries, spark, root, files.webp_size).collect()}
    assert {k[1] if k != ("two", "assets/a.txt") else "again": r["status"] for k, r in got.items()} == {
        "assets/a.txt": "valid", "assets/deep/b.json": "valid", "assets/c.json": "contract", "assets/d.json": "parse_error", "assets/e.txt": "not_utf8", "assets/f.webp": "valid", "assets/g.webp": "parse_error",
        "other/h.txt": "bad_path", "assets/../x": "bad_path", "assets/gone.txt": "missing", "again": "hash_mismatch", "assets/empty.txt": "missing", None: "bad_path",
    }
    image = got[("two", "assets/f.webp")]
    assert (image["width"], image["height"], image["bytes"]) == (640, 480, 30) and got[("two", "other/h.txt")]["bytes"] is None


def test_paths_are_checked_before_anything_is_written(spark, tmp_path):
    for rows in ([("a/../b", b"")], [("/a", b"")], [(".a", b"")], [(None, b"")], [("a", b"1"), ("a", b"2")]):
        with pytest.raises(ValueError):
            blobs.write(spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "path string, content binary"), f"{tmp_path}/x")
    assert not (tmp_path / "x").exists()
    blobs.write(spark.createDataFrame([("a", None)], "path string, content binary"), f"{tmp_path}/y")
    assert (tmp_path / "y" / "a").read_bytes() == b""


def test_files_are_dealt_to_tasks_by_rows(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('assets/', id % 3, '/', id, '.bin') AS path", "CAST(repeat('x', CAST(id AS INT)) AS BINARY) AS content").coalesce(1)
    root = f"{tmp_path}/files"
    blobs.write(rows, root)
    (tmp_path / "files" / "assets" / "with blank.bin").write_bytes(b"b")
    (tmp_path / "files" / "assets" / ".hidden.bin").write_bytes(b"h")
    found = blobs.listing(spark, root)
    assert {r["path"] for r in found.collect()} == {f"assets/{i % 3}/{i}.bin" for i in range(300)} | {"assets/with blank.bin"}
    own = blobs.contents(found.unionByName(found).unionByName(spark.createDataFrame([("assets",), ("gone",)], "path string")), root)
    assert {r["path"]: bytes(r["content"]) for r in own.collect()} == {f"assets/{i % 3}/{i}.bin": b"x" * i for i in range(1, 300)} | {"assets/with blank.bin": b"b"}
    assert own.count() == 300 and own.rdd.getNumPartitions() == blobs._tasks(spark)  # and not one for 32 files, as Spark's own reader deals them
    assert blobs.listing(spark, f"{tmp_path}").count() == 301


def test_a_manifest_alone_writes_no_files(spark, monkeypatch):
    monkeypatch.setattr(blobs, "write", lambda *x: pytest.fail("files were written"))
    assert P.scan_manifest_assets(spark, "/root/testdata/sf0.001").count() > 0
