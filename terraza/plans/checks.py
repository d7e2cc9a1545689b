"""Queries that check records: references, facts, permissions, issues, order, and the pilot."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import checks as C
from terraza.operators import graphs as G
from terraza.operators import ordered as O
from terraza.registry import query
from terraza.sources import adapter as A
from terraza.sources import model as M
from terraza.sources.scratch import apart

# (collection, its column, the referenced table, its key)
REFERENCES = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "supplier", "s_suppkey"), ("conversations", "conv_id", "pages", "page_id"),
)


@query("anti_join_reference_closure", " UNION ALL ".join(f"SELECT '{t}' AS collection, '{c}' AS field, CAST({c} AS BIGINT) AS id, count(*) AS n FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p} WHERE {k} IS NOT NULL) GROUP BY 3" for t, c, p, k in REFERENCES))
def reference_closure(spark, d):
    return C.union([C.dangling(A.table(spark, d, t), c, A.table(spark, d, p), k, t) for t, c, p, k in REFERENCES])


BAD = ", ".join(f"'{x}'" for x in C.BAD_QUALITY)
FACT_RULES = {
    "SIMULATED_ELIGIBLE": "value_kind = 'simulated' AND benchmark_eligible",
    "BAD_QUALITY_ELIGIBLE": f"quality_status IN ({BAD}) AND benchmark_eligible",
    "EXCLUSION_REASON_MISSING": "NOT benchmark_eligible AND coalesce(length(exclusion_reason), 0) = 0",
    "PRICE_UNIT_MISMATCH": "semantic_type = 'price' AND currency IS NOT NULL AND unit <> currency",
    "PPM_UNIT_MISMATCH": "semantic_type = 'price_per_m2' AND currency IS NOT NULL AND unit <> concat(currency, '/m2')",
    "OBSERVED_EVIDENCE_UNEXPLAINED": "value_kind = 'observed' AND evidence_status <> 'available' AND absence_reason IS NULL",
    "DERIVED_INPUT_INELIGIBLE": "value_kind = 'derived' AND benchmark_eligible AND bad_inputs > 0",
    "DERIVED_CURRENCY_MISMATCH": "value_kind = 'derived' AND currencies > 1",
    "DERIVED_OUTPUT_CURRENCY_MISMATCH": "value_kind = 'derived' AND semantic_type IN ('price', 'price_per_m2') AND currencies = 1 AND currency <> input_currency",
    "DENOMINATOR_MISSING": "value_kind = 'derived' AND semantic_type = 'price_per_m2' AND (denominator_area_type = 'total' AND totals = 0 OR denominator_area_type = 'built' AND builts = 0)",
    "PRICE_MISSING": "value_kind = 'derived' AND semantic_type = 'price_per_m2' AND (currency = 'PEN' AND pens = 0 OR currency = 'USD' AND dollars = 0)",
}
# What a derived fact's inputs, the observed and simulated facts of its observation, come to.
_INPUTS = {
    "bad_inputs": f"count(CASE WHEN NOT benchmark_eligible OR value_kind = 'simulated' OR quality_status IN ({BAD}) THEN 1 END)", "currencies": "count(DISTINCT currency)", "input_currency": "min(currency)",
    "totals": "count(CASE WHEN area_type = 'total' THEN 1 END)", "builts": "count(CASE WHEN area_type = 'built' THEN 1 END)", "pens": "count(CASE WHEN semantic_type = 'price' AND currency = 'PEN' THEN 1 END)", "dollars": "count(CASE WHEN semantic_type = 'price' AND currency = 'USD' THEN 1 END)",
}


@query("check_facts", f"""{M.sql('facts', 'observations')}, inputs AS (SELECT observation_id, {', '.join(f'{e} AS {c}' for c, e in _INPUTS.items())} FROM facts WHERE value_kind <> 'derived' GROUP BY 1),
own AS (SELECT f.*, o.evidence_status, o.absence_reason, {', '.join(c if c == 'input_currency' else f'coalesce({c}, 0) AS {c}' for c in _INPUTS)} FROM facts f LEFT JOIN observations o ON o.observation_id = f.observation_id LEFT JOIN inputs i ON i.observation_id = f.observation_id)
{C.broken_sql('fact_id', 'own', **FACT_RULES)}""")
def check_facts(spark, d):
    facts, seen = M.read(spark, d, "facts"), M.read(spark, d, "observations").select("observation_id", "evidence_status", "absence_reason")
    inputs = facts.where("value_kind <> 'derived'").groupBy("observation_id").agg(*(F.expr(e).alias(c) for c, e in _INPUTS.items()))
    own = facts.join(seen, "observation_id", "left").join(inputs, "observation_id", "left").fillna(0, [c for c in _INPUTS if c != "input_currency"])
    return C.broken(own, "fact_id", **FACT_RULES)


RECORD_RULES = {
    "RESTRICTED_FRAGMENT_EXPOSED": "has_fragment AND (publish_permission <> 'authorized' OR availability <> 'available')",
    "FRAGMENT_DOCUMENT_REQUIRED": "has_fragment AND document_permission IS NULL",
    "PERMISSION_MISMATCH": "publish_permission = 'authorized' AND document_permission <> 'authorized'",
    "AVAILABILITY_MISMATCH": "availability = 'available' AND document_availability <> 'available'",
    "HASH_MISMATCH": "stated_sha256 <> sha256",
    "OWNER_MISMATCH": "stated_source <> source",
    "FRAGMENT_DOCUMENT_RESTRICTED": "has_fragment AND (document_permission <> 'authorized' OR document_availability <> 'available')",
}
_asset = "has_asset AND (publish_permission <> 'authorized' OR availability <> 'available')"


#: The text and the source that a record states of its document; some state another.
_stated_text, _stated_source = "concat(text, CASE WHEN doc_id % 13 = 2 THEN ' ' ELSE '' END)", "CASE WHEN doc_id % 17 = 3 THEN 'elsewhere' ELSE source END"


@query("check_permissions", f"""{M.sql('records', 'docs')}, texts AS (SELECT doc_id, source, sha256(text) AS sha256, sha256({_stated_text}) AS stated_sha256, {_stated_source} AS stated_source FROM documents),
own AS (SELECT r.*, d.publish_permission AS document_permission, d.availability AS document_availability, t.source, sha256, stated_sha256, stated_source FROM records r LEFT JOIN docs d ON d.document_id = r.document_id LEFT JOIN texts t ON t.doc_id = r.document_id)
SELECT document_id AS id, 'RESTRICTED_ASSET_EXPOSED' AS code FROM docs WHERE {_asset} UNION ALL {C.broken_sql('evidence_id AS id', 'own', **RECORD_RULES)}""")
def check_permissions(spark, d):
    """Exposed assets and fragments, records more public than their document, and records that state another hash or owner; texts are hashed where they are read, and only digests are shuffled."""
    docs, records = M.read(spark, d, "docs"), M.read(spark, d, "records")
    state = docs.select("document_id", F.col("publish_permission").alias("document_permission"), F.col("availability").alias("document_availability"))
    texts = A.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", F.sha2("text", 256).alias("sha256"), F.sha2(F.expr(_stated_text), 256).alias("stated_sha256"), F.expr(_stated_source).alias("stated_source"))
    own = records.join(state, "document_id", "left").join(texts, "document_id", "left").withColumnRenamed("evidence_id", "id")
    assets = C.broken(docs.withColumnRenamed("document_id", "id"), "id", RESTRICTED_ASSET_EXPOSED=_asset)
    return assets.unionByName(C.broken(own, "id", **RECORD_RULES))


@query("check_issues", f"{M.sql('facts', 'issues')} SELECT DISTINCT f.fact_id, i.issue_id FROM facts f JOIN issues i ON i.project_id = f.project_id WHERE i.benchmark_blocking AND f.benchmark_eligible")
def check_issues(spark, d):
    blocking = M.read(spark, d, "issues").where("benchmark_blocking").select("issue_id", "project_id")
    return M.read(spark, d, "facts").where("benchmark_eligible").join(blocking, "project_id").select("fact_id", "issue_id").distinct()


_tiers = "CASE WHEN s_acctbal > 8000 THEN 'deep' WHEN s_acctbal > 5000 THEN 'enriched' ELSE 'base' END"
_published = "CASE WHEN s_nationkey % 5 = 0 THEN 'deep' WHEN s_nationkey % 2 = 0 THEN 'enriched' ELSE 'base' END"


@query("check_pilot", f"""WITH own AS (SELECT s_suppkey % 4 < 3 AS selected, s_suppkey % 5 < 4 AS piloted, {_tiers} AS tier, {_published} AS published FROM supplier),
n AS (SELECT count(*) FILTER (selected <> piloted) AS set_mismatch, count(*) FILTER (selected) AS base_count, count(*) FILTER (selected AND tier <> 'base') AS enriched_count, count(*) FILTER (selected AND tier = 'deep') AS deep_count,
count(*) FILTER (piloted) AS base_published, count(*) FILTER (piloted AND published <> 'base') AS enriched_published, count(*) FILTER (piloted AND published = 'deep') AS deep_published FROM own)
SELECT 'PILOT_AGENCY_SET_MISMATCH' AS code, set_mismatch AS expected, 0 AS found FROM n WHERE set_mismatch > 0 UNION ALL SELECT 'BASE_COUNT', base_count, base_published FROM n WHERE base_count <> base_published
UNION ALL SELECT 'ENRICHED_COUNT', enriched_count, enriched_published FROM n WHERE enriched_count <> enriched_published UNION ALL SELECT 'DEEP_COUNT', deep_count, deep_published FROM n WHERE deep_count <> deep_published""")
def check_pilot(spark, d):
    own = A.table(spark, d, "supplier").selectExpr("s_suppkey % 4 < 3 AS selected", "s_suppkey % 5 < 4 AS piloted", f"{_tiers} AS tier", f"{_published} AS published")
    each = lambda flag, tier: (F.count_if(flag), F.count_if(flag & (F.col(tier) != "base")), F.count_if(flag & (F.col(tier) == "deep")))
    ours, theirs = each(F.col("selected"), "tier"), each(F.col("piloted"), "published")
    rows = [F.struct(F.lit("PILOT_AGENCY_SET_MISMATCH").alias("code"), F.count_if(F.col("selected") != F.col("piloted")).alias("expected"), F.lit(0).cast("long").alias("found"))]
    rows += [F.struct(F.lit(k).alias("code"), a.alias("expected"), b.alias("found")) for k, a, b in zip(("BASE_COUNT", "ENRICHED_COUNT", "DEEP_COUNT"), ours, theirs, strict=True)]
    return own.agg(F.array(*rows).alias("r")).select(F.inline("r")).where("expected <> found")


#: Collections in the order that they are published in: the table, the id that they should be ordered by, and the position; some records are out of place.
COLLECTIONS = {
    "listings": ("orders", "o_orderkey", "o_orderkey + CASE WHEN o_orderkey % 97 = 5 THEN 3 ELSE 0 END"), "projects": ("part", "p_partkey", "CASE WHEN p_partkey % 71 = 9 THEN p_partkey + 150 ELSE p_partkey END"),
    "sources": ("supplier", "s_suppkey", "s_suppkey"), "agencies": ("customer", "c_custkey", "CASE WHEN c_custkey = 40 THEN 0 ELSE c_custkey END"),
}
_ordered = "\nUNION ALL ".join(f"SELECT '{name}' AS collection, {key} AS id, {position} AS position FROM {table}" for name, (table, key, position) in COLLECTIONS.items())
_order = lambda where: f"WITH own AS ({_ordered}), l AS (SELECT *, lag(id) OVER (PARTITION BY collection ORDER BY position, id DESC) AS before FROM own) SELECT collection, id, before FROM l WHERE before > id AND {where}"


def _out_of_order(spark, d, names):
    parts = [A.table(spark, d, COLLECTIONS[n][0]).selectExpr(f"'{n}' AS collection", f"CAST({COLLECTIONS[n][1]} AS BIGINT) AS id", f"CAST({COLLECTIONS[n][2]} AS BIGINT) AS position") for n in names]
    return O.out_of_order(C.union(parts), ["collection"], "position", "id").select("collection", "id", "before")


@query("deterministic_order", _order("collection = 'listings'"))
def deterministic_order(spark, d):
    return _out_of_order(spark, d, ["listings"])


_event_breaks = "SELECT event_id, ts, lag(ts) OVER (ORDER BY position, event_id) AS before FROM (SELECT event_id, ts, CASE WHEN event_id % 499 = 7 THEN event_id + 20 ELSE event_id END AS position FROM events)"


@query("check_order", f"WITH e AS ({_event_breaks}) SELECT 'COLLECTION_ORDER' AS code, collection, id FROM ({_order('true')}) UNION ALL SELECT 'EVENT_ORDER', 'events', event_id FROM e WHERE before > ts")
def check_order(spark, d):
    """Collections by their ids, and events by their times: every record that stands after a larger one, across the whole collection."""
    events = A.table(spark, d, "events").selectExpr("event_id", "ts", "CASE WHEN event_id % 499 = 7 THEN event_id + 20 ELSE event_id END AS position")
    events = O.lagged(events, [], ["position", "event_id"], before="ts").where("before > ts")
    own = _out_of_order(spark, d, COLLECTIONS).select(F.lit("COLLECTION_ORDER").alias("code"), "collection", "id")
    return own.unionByName(events.select(F.lit("EVENT_ORDER").alias("code"), F.lit("events").alias("collection"), F.col("event_id").alias("id")))


ROOT_RULES = {
    "SNAPSHOT_RANGE": "last_ship < captured_at", "AREA_NOT_POSITIVE": "area <= 0 OR area IS NULL", "AREA_RANGE_REVERSED": "area_low > area_high", "PRICE_RANGE": "price < 1000",
}


@query("check_root", f"""WITH lines AS (SELECT l_orderkey, sum(l_quantity) AS area, min(l_quantity) * 10 AS area_low, max(l_quantity) AS area_high, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1),
own AS (SELECT o_orderkey AS listing_id, o_orderdate AS captured_at, o_totalprice AS price, area, area_low, area_high, last_ship FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey) {C.broken_sql('listing_id', 'own', **ROOT_RULES)}""")
def check_root(spark, d):
    lines = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("listing_id")).agg(F.sum("l_quantity").alias("area"), (F.min("l_quantity") * 10).alias("area_low"), F.max("l_quantity").alias("area_high"), F.max("l_shipdate").alias("last_ship"))
    own = A.table(spark, d, "orders").selectExpr("o_orderkey AS listing_id", "o_orderdate AS captured_at", "o_totalprice AS price").join(lines, "listing_id", "left")
    return C.broken(own, "listing_id", **ROOT_RULES)


_case = f"""{M.sql('facts', 'observations', 'issues')}, f AS (SELECT f.*, o.owner_id, o.evidence_status, i.benchmark_blocking FROM facts f JOIN observations o ON o.observation_id = f.observation_id LEFT JOIN issues i ON i.project_id = f.project_id),
cases AS (SELECT observation_id, count(*) AS facts, count(DISTINCT source_id) AS sources, count(*) FILTER (benchmark_eligible AND quality_status = 'certified') AS eligible, count(*) FILTER (benchmark_blocking) AS blocking, count(*) FILTER (source_id % 10 <> owner_id % 10) AS foreign_sources, min(evidence_status) AS evidence_status FROM f GROUP BY 1)"""


def cases(spark, d):
    """Facts, sources, eligible facts, blocking issues and foreign sources of each observation."""
    seen, issues = M.read(spark, d, "observations").select("observation_id", "owner_id", "evidence_status"), M.read(spark, d, "issues").select("project_id", "benchmark_blocking")
    own = M.read(spark, d, "facts").join(seen, "observation_id").join(issues, "project_id", "left")
    return own.groupBy("observation_id").agg(
        F.count("*").alias("facts"), F.countDistinct("source_id").alias("sources"), F.count_if(F.expr("benchmark_eligible AND quality_status = 'certified'")).alias("eligible"), F.count_if("benchmark_blocking").alias("blocking"),
        F.count_if(F.expr("source_id % 10 <> owner_id % 10")).alias("foreign_sources"), F.min("evidence_status").alias("evidence_status"),
    )


INSPECTOR_RULES = {"NO_ELIGIBLE_FACT": "eligible = 0", "BLOCKED_ELIGIBLE": "blocking > 0 AND eligible > 0", "SOURCE_OWNER": "foreign_sources = facts", "EVIDENCE_MISSING": "evidence_status = 'missing' AND eligible > 0", "SOURCES_REPEATED": "sources < facts"}


INSPECTOR_SQL = f"{_case} {C.broken_sql('observation_id', 'cases', **INSPECTOR_RULES)}"


def inspector_counts(spark, d):
    return C.broken(cases(spark, d), "observation_id", **INSPECTOR_RULES)


_decision = "CASE WHEN blocking > 0 THEN 'conflict' WHEN eligible = 0 THEN 'insufficient' WHEN eligible < facts THEN 'reviewable' ELSE 'certified' END"


@query("inspector_decision", f"{_case} SELECT observation_id, {_decision} AS status, {_decision} = 'certified' AND evidence_status = 'available' AS eligible FROM cases")
def inspector_decision(spark, d):
    return cases(spark, d).selectExpr("observation_id", f"{_decision} AS status", f"{_decision} = 'certified' AND evidence_status = 'available' AS eligible")


_benchmark = {
    "PAIR_WITHOUT_PRICE": "prices = 0 AND areas > 0", "PAIR_WITHOUT_AREA": "prices > 0 AND areas = 0", "UNPAIRED_ELIGIBLE": "(prices = 0 OR areas = 0) AND eligible > 0", "DUPLICATE_IDENTITY": "identities < facts",
}
_bench_agg = {
    "facts": "count(*)", "prices": "count(CASE WHEN semantic_type = 'price' THEN 1 END)", "areas": "count(CASE WHEN semantic_type = 'area' THEN 1 END)", "eligible": "count(CASE WHEN benchmark_eligible THEN 1 END)",
}


@query("check_benchmark", f"""{M.sql('facts')}, own AS (SELECT observation_id, {', '.join(f'{e} AS {c}' for c, e in _bench_agg.items())}, count(DISTINCT (project_id, field_name, source_id)) AS identities FROM facts GROUP BY 1) {C.broken_sql('observation_id', 'own', **_benchmark)}""")
def check_benchmark(spark, d):
    own = M.read(spark, d, "facts").groupBy("observation_id").agg(*(F.expr(e).alias(c) for c, e in _bench_agg.items()), F.countDistinct("project_id", "field_name", "source_id").alias("identities"))
    return C.broken(own, "observation_id", **_benchmark)


@query("benchmark_reference_closure", f"""{M.sql('facts', 'records', 'docs')}, ids AS (SELECT evidence_id FROM records)
SELECT fact_id, 'observation' AS owner FROM facts WHERE observation_id NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT fact_id, 'project' FROM facts WHERE project_id NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT fact_id, 'evidence' FROM facts WHERE benchmark_eligible AND source_id NOT IN (SELECT evidence_id FROM ids)""")
def benchmark_closure(spark, d):
    facts = M.read(spark, d, "facts")
    owners = (("observation", "observation_id", A.table(spark, d, "orders").selectExpr("o_orderkey AS observation_id"), "true"), ("project", "project_id", A.table(spark, d, "part").selectExpr("p_partkey AS project_id"), "true"), ("evidence", "source_id", M.read(spark, d, "records").selectExpr("evidence_id AS source_id"), "benchmark_eligible"))
    return C.union([facts.where(own).join(parent, key, "left_anti").select("fact_id", F.lit(name).alias("owner")) for name, key, parent, own in owners])


MANIFEST_RULES = {"ASSET_PATH": "NOT (url LIKE 'http://%' OR url LIKE 'https://%')", "EMPTY_ASSET": "bytes = 0", "TOO_LARGE": "bytes > 5000", "HASH": "length(sha256) <> 64", "REPEATED_PATH": "copies > 1"}


@query("evidence_manifest_check", f"WITH own AS (SELECT page_id, url, coalesce(strlen(html), 0) AS bytes, sha256(html) AS sha256, count(*) OVER (PARTITION BY url) AS copies FROM pages) {C.broken_sql('page_id', 'own', **MANIFEST_RULES)}")
def manifest_check(spark, d):
    pages = A.table(spark, d, "pages").select("page_id", "url", F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"), F.sha2("html", 256).alias("sha256"))
    copies = pages.groupBy("url").agg(F.count("*").alias("copies"))
    return C.broken(pages.join(copies, "url", "left"), "page_id", **MANIFEST_RULES)


BUNDLE_RULES = {"ID": "document_id IS NULL", "REFERENCE": "publish_permission IS NULL", "TRANSCRIPTION": "has_fragment AND coalesce(n_chars, 0) < 200", "UNUSED": "evidence_id IS NULL AND publish_permission = 'authorized'"}
_bundle = "own AS (SELECT coalesce(r.document_id, d.document_id) AS document_id, evidence_id, has_fragment, d.publish_permission, n_chars FROM records r FULL JOIN (SELECT docs.*, n_chars FROM docs JOIN documents ON documents.doc_id = docs.document_id) d ON d.document_id = r.document_id)"


@query("check_evidence_bundle", f"{M.sql('records', 'docs')}, {_bundle} {C.broken_sql('document_id', 'own', **BUNDLE_RULES)}")
def evidence_bundle(spark, d):
    docs = M.read(spark, d, "docs").select("document_id", "publish_permission").join(A.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "n_chars"), "document_id")
    own = M.read(spark, d, "records").select("document_id", "evidence_id", "has_fragment").join(docs, "document_id", "full")
    return C.broken(own, "document_id", **BUNDLE_RULES)


_row_key = "concat(CAST(l_orderkey AS VARCHAR(20)), ':', CAST(l_linenumber AS VARCHAR(20)))"
#: The keys that agencies cite of the snapshot's rows; some name a row that isn't there.
_cited_key = f"concat({_row_key}, CASE WHEN l_orderkey % 71 = 8 AND l_suppkey % 3 > 0 THEN '-old' ELSE '' END)"
AGENCY_RULES = {"ID_SHAPE": "NOT (id LIKE 'agency:%')", "ALIAS_UNRESOLVED": "customer IS NULL", "TIER": "tier = 'deep' AND listings < 3", "SELECTION": "listings IS NULL AND tier <> 'base'"}


@query("check_agency_artifacts", f"""WITH n AS (SELECT o_custkey, count(*) AS listings FROM orders GROUP BY 1), own AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN {S.slug_sql('s_name')} ELSE concat('agency:', {S.slug_sql('s_name')}) END AS id, c_custkey AS customer, {_tiers} AS tier, listings
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 20 LEFT JOIN n ON o_custkey = s_suppkey), cited AS (SELECT l_suppkey AS s_suppkey, sha256({_cited_key}) AS key FROM lineitem), snapshot AS (SELECT sha256({_row_key}) AS key, count(*) AS n FROM lineitem GROUP BY 1)
{C.broken_sql('s_suppkey', 'own', **AGENCY_RULES)} UNION ALL SELECT DISTINCT s_suppkey, CASE WHEN n IS NULL THEN 'ROW_KEY_MISSING' ELSE 'ROW_KEY_REPEATED' END FROM cited c LEFT JOIN snapshot s ON s.key = c.key WHERE n IS DISTINCT FROM 1""")
def agency_artifacts(spark, d):
    """Shapes, aliases and tiers of agencies, and the keys of their evidence rows, each of which has to be in the snapshot exactly once."""
    lines = A.table(spark, d, "lineitem")
    snapshot = lines.select(F.sha2(F.expr(_row_key), 256).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    cited = lines.select(F.col("l_suppkey").alias("s_suppkey"), F.sha2(F.expr(_cited_key), 256).alias("key")).join(snapshot, "key", "left").where("n IS DISTINCT FROM 1")
    keys = cited.select("s_suppkey", F.when(F.col("n").isNull(), "ROW_KEY_MISSING").otherwise("ROW_KEY_REPEATED").alias("code")).distinct()
    listings = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("s_suppkey")).agg(F.count("*").alias("listings"))
    known = A.table(spark, d, "customer").where("c_custkey % 20 = 0").select((F.col("c_custkey") / 20).cast("long").alias("s_suppkey"), F.col("c_custkey").alias("customer"))
    name = S.slug("s_name")
    own = A.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 3, name).otherwise(F.concat(F.lit("agency:"), name)).alias("id"), F.expr(_tiers).alias("tier"))
    return C.broken(own.join(known, "s_suppkey", "left").join(listings, "s_suppkey", "left"), "s_suppkey", **AGENCY_RULES).unionByName(keys)


#: Collections that a caller may leave out; each that is there is checked for repeated ids.
_collections = (("facts", "fact_id"), ("observations", "observation_id"), ("issues", "issue_id"), ("records", "evidence_id"))


@query("partial_validation", f"{M.sql('facts', 'observations', 'issues', 'records')} " + " UNION ALL ".join(f"SELECT '{c}' AS collection, count(*) AS records, count(*) - count(DISTINCT {k}) AS repeated FROM {c}" for c, k in _collections))
def partial_validation(spark, d):
    def each(name, key):
        own = M.read(spark, d, name).groupBy(key).agg(F.count("*").alias("n"))
        return own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("repeated")).select(F.lit(name).alias("collection"), "records", "repeated")

    return C.union([each(*x) for x in _collections])


#: What each project's facts derive from, for every project with facts: in blocks of 64 projects that are one cycle, or chains of 16 that end, or a
#: cycle of 40 with three chains of 8 into it; in every second block some projects also derive from one further on.
_in = "l_partkey % 64"
DERIVED = {
    "next": f"CASE l_partkey // 64 % 3 WHEN 0 THEN l_partkey // 64 * 64 + (l_partkey + 1) % 64 WHEN 1 THEN CASE WHEN l_partkey % 16 < 15 THEN l_partkey + 1 END ELSE CASE WHEN {_in} = 39 THEN l_partkey - 39 WHEN {_in} >= 40 AND l_partkey % 8 = 7 THEN l_partkey - {_in} + 5 ELSE l_partkey + 1 END END",
    "also": f"CASE WHEN l_partkey // 64 % 2 = 1 AND l_partkey % 7 = 3 AND {_in} < 60 THEN l_partkey + 2 END",
}


@query("derivation_cycle", f"""WITH RECURSIVE p AS (SELECT DISTINCT l_partkey FROM lineitem), e AS (SELECT l_partkey AS a, unnest([{', '.join(DERIVED.values())}]) AS b FROM p), edges AS (SELECT DISTINCT a, b FROM e WHERE b IN (FROM p)),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b), cyclic AS (SELECT a AS node FROM reach WHERE a = b),
held AS (SELECT node FROM cyclic UNION SELECT x.b FROM reach x WHERE x.a IN (FROM cyclic) AND x.b IN (SELECT a FROM reach WHERE b IN (FROM cyclic))),
linked AS (SELECT a, b FROM edges WHERE a IN (FROM held) AND b IN (FROM held) UNION SELECT b, a FROM edges WHERE a IN (FROM held) AND b IN (FROM held)),
joined AS (SELECT a, b FROM linked UNION SELECT j.a, n.b FROM joined j JOIN linked n ON n.a = j.b), c AS (SELECT a AS project_id, min(b) AS component FROM joined GROUP BY 1)
SELECT project_id, component, count(*) OVER (PARTITION BY component) AS nodes FROM c""")
def derivation_cycle(spark, d):
    """Projects whose facts derive from themselves, or lie between such ones: leaves of the derivation graph are peeled until none is left."""
    spark_sql = {k: e.replace("//", "div") for k, e in DERIVED.items()}
    known = A.table(spark, d, "lineitem").select("l_partkey").distinct()
    edges = known.select(F.col("l_partkey").alias("a"), F.explode(F.array(*(F.expr(e) for e in spark_sql.values()))).alias("b"))
    edges = edges.join(apart(known.select(F.col("l_partkey").alias("b"))), "b", "left_semi")
    return G.cyclic(edges).select(F.col("node").alias("project_id"), "component", "nodes")
