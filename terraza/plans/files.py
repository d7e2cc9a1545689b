"""Queries that write tables as files and scan them strictly, and that check artifacts against what is expected of them."""

from pyspark.sql import functions as F

from terraza.operators import checks as C
from terraza.operators import ordered as O
from terraza.operators import reports
from terraza.operators import rings as R
from terraza.registry import query
from terraza.sources import adapter as A
from terraza.sources import blobs, files, geojson, scratch
from terraza.sources import model as M


@query("scan_required_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def scan_required_csv(spark, d):
    to, names = scratch.path(spark, "files"), ["s_suppkey", "s_name", "s_nationkey"]
    A.table(spark, d, "supplier").select(*(F.col(c).cast("string").alias(c) for c in names)).write.csv(to, header=True, escape='"')
    return files.scan_csv(spark, to, names, required=True)


@query("scan_json", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def scan_json(spark, d):
    """One JSON document, an object with an array, of each region; the nations of a region are few."""
    to = scratch.path(spark, "files")
    own = A.table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    own.select("n_regionkey", F.to_json(F.struct("n_regionkey", "nations"), {"pretty": "true"}).alias("value")).repartition("n_regionkey").select("value", F.col("n_regionkey").alias("part")).write.partitionBy("part").text(to)
    found = files.scan_json(spark, f"{to}/part=*", "n_regionkey int, nations array<struct<n_nationkey: int, n_name: string>>")
    return found.select("n_regionkey", F.inline("nations"))


#: A polygon, or two, around each listing of the part; a third of them are points, which are no polygons.
_kind = "CASE o_orderkey % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'MultiPolygon' ELSE 'Polygon' END"
_note = """CASE o_orderkey % 5 WHEN 0 THEN 'a "quoted" } brace' WHEN 1 THEN 'back\\slash [' ELSE o_orderpriority END"""


def _features(spark, d):
    at = lambda u, v: F.array(F.col("o_orderkey") % 1000 + u, F.col("o_custkey") % 1000 + v)
    ring = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 0))
    coordinates = F.when(F.col("kind") == "MultiPolygon", F.to_json(F.array(F.array(ring)))).when(F.col("kind") == "Polygon", F.to_json(F.array(ring))).otherwise(F.to_json(at(0, 0)))
    text = F.concat(F.lit('{"geometry":{"coordinates":'), coordinates, F.lit(',"type":"'), F.col("kind"), F.lit('"},"properties":'), F.to_json(F.struct(F.col("note").alias("name"), F.col("o_orderkey").cast("string").alias("relation"))), F.lit(',"type":"Feature"}'))
    own = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(_kind).alias("kind"), F.expr(_note.replace("\\", "\\\\")).alias("note"))
    return own.select(F.col("o_orderkey").alias("relation"), text.alias("feature"))


@query("scan_geojson", f"SELECT CAST(o_orderkey AS VARCHAR) AS relation, {_note} AS name, {_kind} AS kind FROM orders WHERE o_orderkey % 3 > 0")
def scan_geojson(spark, d):
    """Collections of all listings, written and read again by ranges of bytes; points are no polygons and are left out."""
    to = scratch.path(spark, "collections")
    geojson.sink_many(_features(spark, d), to, 4000)
    return geojson.scan(spark, to).select("relation", "name", "kind")


@query("sink_geojson", f"""WITH o AS (SELECT *, {_kind} AS kind, o_orderkey % 1000 AS u, o_custkey % 1000 AS v FROM orders), r AS (SELECT *, concat('[[', u, ',', v, '],[', u + 1, ',', v, '],[', u + 1, ',', v + 1, '],[', u, ',', v, ']]') AS ring FROM o)
SELECT rank AS nth, concat(CASE WHEN rank > 1 THEN ',' ELSE '' END, '{{"geometry":{{"coordinates":', CASE kind WHEN 'MultiPolygon' THEN concat('[[', ring, ']]') WHEN 'Polygon' THEN concat('[', ring, ']') ELSE concat('[', u, ',', v, ']') END, ',"type":"', kind, '"}},"properties":{{"name":', to_json({_note}), ',"relation":"', o_orderkey, '"}},"type":"Feature"}}') AS line
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rank FROM r)""")
def sink_geojson(spark, d):
    """The lines of the collection as they stand in the files, with their places."""
    to = scratch.path(spark, "collection")
    geojson.sink(_features(spark, d), to)
    lines = spark.read.text(to).select("value", F.get_json_object(F.regexp_replace("value", "^,", ""), "$.properties.relation").cast("long").alias("o_orderkey"))
    return O.ranked(lines.where("o_orderkey is not null"), {"o_orderkey": "asc"}, name="nth").select("nth", F.col("value").alias("line"))


#: Every part has an asset: a text, JSON or an image; some are missing, changed, broken or listed under a path that isn't plain.
_width, _height = "(p_partkey * 7 + p_size) % 16384", "(p_partkey * 3 + 5) % 16384"
_format = "CASE p_partkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'json' ELSE 'webp' END"
_path = "concat('assets/', p_partkey % 10, '/', p_partkey, '.', CASE p_partkey % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'json' ELSE 'webp' END)"
_listed = f"CASE WHEN p_partkey % 37 = 4 THEN concat('assets/../', p_partkey) ELSE {_path} END"
_faults = {"gone": "p_partkey % 29 = 3", "changed": "p_partkey % 23 = 2", "broken": "p_size % 10 = 3", "foreign": "p_size % 10 = 4"}


def _assets(spark, d):
    """The parts' assets, each with its content and where it is listed."""
    two = lambda x: F.concat(F.lpad(F.hex(x % 256), 2, "0"), F.lpad(F.hex(F.floor(x / 256)), 2, "0"))
    mark = F.when(F.expr(_faults["broken"]), "57454251").otherwise("57454250")
    image = F.unhex(F.concat(F.lit("52494646"), F.lit("16000000"), mark, F.lit("56503820"), F.lit("0A000000"), F.lit("000000"), F.lit("9D012A"), two(F.expr(_width)), two(F.expr(_height))))
    text = F.when(F.expr(_faults["broken"]), F.unhex(F.lit("C328"))).otherwise(F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.lit("0A"))))
    json = F.encode(F.when(F.expr(_faults["broken"]), "{").when(F.expr(_faults["foreign"]), '{"features": 1}').otherwise(F.concat(F.lit('{"features": ['), F.col("p_size").cast("string"), F.lit("]}"))), "UTF-8")
    content = F.when(F.expr(_format) == "text", text).when(F.expr(_format) == "json", json).otherwise(image)
    return A.table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_name", content.alias("content"), F.expr(_format).alias("format"), F.expr(_path).alias("path"), F.expr(_listed).alias("listed"))


def _files(spark, d):
    """The folder with the assets as files."""
    root = scratch.path(spark, "assets")
    blobs.write(_assets(spark, d).where(f"NOT ({_faults['gone']})").select("path", "content"), root)
    return root


def _manifests(spark, d):
    """The folder with manifests of the assets, some for each brand."""
    own, manifests = _assets(spark, d), scratch.path(spark, "manifests")
    digest = F.when(F.expr(_faults["changed"]), F.sha2(F.lit("other"), 256)).otherwise(F.sha2(F.when(F.col("format") == "text", blobs.plain(F.col("content"))).otherwise(F.col("content")), 256))
    entry = F.struct(F.col("listed").alias("path"), digest.alias("sha256"), "format")
    # Some entries are listed twice; a manifest lists a few hundred assets at most, as its number is part of its name.
    named = own.select(F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / 500)).alias("document"), F.explode(F.when(F.col("p_partkey") % 19 == 0, F.array(entry, entry)).otherwise(F.array(entry))).alias("e"))
    named.groupBy("document").agg(F.collect_list("e").alias("assets")).write.json(manifests)
    return manifests


_entries = f"entries AS (SELECT p_partkey, {_listed} AS path, {_format} AS format, p_size, p_name, p_partkey % 19 = 0 AS repeated, {_listed} = {_path} AS path_ok, unnest(CASE WHEN p_partkey % 19 = 0 THEN [1, 2] ELSE [1] END) AS nth, {', '.join(f'{c} AS {k}' for k, c in _faults.items())} FROM part)"
_state = """CASE WHEN NOT path_ok THEN 'bad_path' WHEN gone THEN 'missing' WHEN changed THEN 'hash_mismatch' WHEN format = 'text' AND broken THEN 'not_utf8' WHEN format <> 'text' AND broken THEN 'parse_error' WHEN format = 'json' AND "foreign" THEN 'contract' ELSE 'valid' END"""
_entries = _entries.replace("AS foreign", 'AS "foreign"')


@query("scan_manifest_assets", f"WITH {_entries} SELECT path, format, path_ok, repeated FROM entries")
def scan_manifest_assets(spark, d):
    return blobs.manifest(spark, _manifests(spark, d)).select("path", "format", "path_ok", "repeated")


@query("fetch_verified_artifact", f"WITH {_entries} SELECT path, format, {_state} AS status FROM entries")
def fetch_verified_artifact(spark, d):
    """What the files on disk are worth against the manifests that list them."""
    return blobs.checked(blobs.manifest(spark, _manifests(spark, d)), spark, _files(spark, d), files.webp_size).select("path", "format", "status")


@query("scan_binary_asset", f"SELECT {_path} AS path, CAST({_width} AS INTEGER) AS width, CAST({_height} AS INTEGER) AS height FROM part WHERE p_partkey % 3 = 2 AND p_size % 10 <> 3 AND NOT ({_faults['gone']})")
def binary_asset(spark, d):
    """Sizes in the heads of the images on disk; those without a sound head have none."""
    root = _files(spark, d)
    own = blobs.contents(blobs.listing(spark, root).where(F.endswith("path", F.lit(".webp"))), root)
    size = files.webp_size(F.col("content"))
    return own.select("path", size.alias("size")).where("size is not null").select("path", "size.width", "size.height")


@query("asset_hash_check", f"WITH {_entries} SELECT path, count(*) AS entries, bool_and({_state} NOT IN ('missing', 'bad_path') AND NOT changed) AS same FROM entries GROUP BY 1")
def asset_hash(spark, d):
    """Whether every entry for a path has the hash of the file there, one closing line end of a text left out."""
    own = blobs.checked(blobs.manifest(spark, _manifests(spark, d)), spark, _files(spark, d), files.webp_size)
    return own.groupBy("path").agg(F.count("*").alias("entries"), F.every(~F.col("status").isin("bad_path", "missing", "hash_mismatch")).alias("same"))


@query("sink_guard", "WITH o AS (SELECT page_id, lower(regexp_replace(url, '/+$', '')) AS key FROM pages), i AS (SELECT DISTINCT lower(regexp_replace(url, '/+$', '')) AS key FROM pages WHERE page_id % 3 = 0) SELECT page_id, i.key IS NULL AS allowed FROM o LEFT JOIN i ON i.key = o.key")
def sink_guard(spark, d):
    """Whether a page's address may be written to: not if it is an input's."""
    pages = A.table(spark, d, "pages").select("page_id", F.lower(F.regexp_replace("url", "/+$", "")).alias("key"))
    inputs = pages.where("page_id % 3 = 0").select("key").distinct().withColumn("input", F.lit(True))
    return pages.join(inputs, "key", "left").select("page_id", F.col("input").isNull().alias("allowed"))


_tables = ("nation", "orders", "part", "pages", "region", "supplier")


@query("discover_inputs", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _tables))
def discover_inputs(spark, d):
    """Names of the tables that rows were read from, as the scan itself says."""
    name = F.regexp_extract(F.input_file_name(), r"/([a-z]+)\.parquet", 1)
    parts = [A.table(spark, d, t).select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n")) for t in _tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("name")


#: What the coverage report counts of each collection.
REPORTED = {"facts": ("semantic_type", "currency", "value_kind", "quality_status", "benchmark_eligible", "exclusion_reason"), "observations": ("evidence_status", "absence_reason", "currency"), "issues": ("issue_code", "quality_status", "benchmark_blocking"), "records": ("publish_permission", "availability", "has_fragment"), "docs": ("source", "publish_permission", "availability", "has_asset")}


@query("sink_report", f"{M.sql(*REPORTED)} " + " UNION ALL ".join(reports.counts_sql(c, *sections) for c, sections in REPORTED.items()))
def sink_report(spark, d):
    """The coverage report, written as stable JSON lines in order and read back."""
    path = scratch.path(spark, "report")
    files.sink_json(C.union([reports.counts(M.read(spark, d, c), c, *sections) for c, sections in REPORTED.items()]), path, "collection", "section", "key")
    return spark.read.schema("collection string, section string, key string, n long").json(path)


@query("simplify_ring")
def simplify_ring(spark, d):
    """The lines of an order as a ring of points in the order of their numbers, with fewer corners; an order has few lines."""
    points = A.table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y")).alias("p"))
    own = points.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p")).alias("p")).select("l_orderkey", F.transform("p", lambda p: F.struct(p["x"], p["y"])).alias("ring"))
    return own.select("l_orderkey", F.size("ring").alias("corners"), F.size(R.simplified(F.col("ring"), 5.0)).alias("kept"))
