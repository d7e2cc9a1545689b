"""Queries on names, orders, scopes, contexts and answers: what a reader of the market sees."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.functions import paths as P
from terraza.functions import semantics as S
from terraza.functions import unicode as U
from terraza.operators import checks as C
from terraza.operators import documents as D
from terraza.operators import evidence as E
from terraza.operators import history as H
from terraza.operators import listings as L
from terraza.operators import text as T
from terraza.plans import history as PH
from terraza.registry import query
from terraza.sources import adapter as A
from terraza.sources import model as M
from terraza.sources.scratch import written

LISTINGS = f"WITH {A.LISTINGS_SQL}"
h = S.half_up_sql


def rule(name: str, table: str, key: str, alias: str, sql: str, column) -> None:
    """Registers one text rule over a key of a table."""
    query(name, f"SELECT {key}, {sql} AS {alias} FROM {table}")(lambda spark, d: A.table(spark, d, table).select(key, column().alias(alias)))


# Names of kinds of homes and the kind each stands for.
TYPOLOGY = {"departamento": "departamento", "departamentos": "departamento", "depa": "departamento", "flat": "departamento", "casa": "casa", "casas": "casa", "duplex": "duplex", "triplex": "triplex", "loft": "loft"}
_home = "CASE p_size % 6 WHEN 0 THEN 'Depa' WHEN 1 THEN ' FLAT' WHEN 2 THEN 'Departamentos' WHEN 3 THEN 'CASAS' WHEN 4 THEN 'Dúplex' ELSE p_type END"
_white = r"[\t-\r ]+"
_compare = lambda x: f"regexp_replace(regexp_replace(lower(regexp_replace({U.unmarked_sql(x)}, '^{_white}|{_white}$', '', 'g')), '[_-]+', ' ', 'g'), '{_white}', ' ', 'g')"


def text_compare(x):
    """Without marks, in lower case, trimmed; underscores, dashes and white space are single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(U.unmarked(x), f"^{_white}|{_white}$", "")), "[_-]+", " "), _white, " ")


#: Whole texts, in every second row with the commonest letters written as a letter and a mark.
_written = lambda key: f"CASE WHEN {key} % 2 = 0 THEN replace(replace(replace(text, 'é', 'e\u0301'), 'ñ', 'n\u0303'), 'á', 'a\u0301') ELSE text END"
rule("norm_district", "nation", "n_nationkey", "district_key", S.words_sql("n_name"), lambda: S.words("n_name"))
rule("norm_history_name", "benchmark", "item_id", "name", U.words_sql(_written("item_id")), lambda: U.words(F.expr(_written("item_id"))))
rule("norm_term", "documents", "doc_id", "term", f"lower(regexp_replace(nfc_normalize({_written('doc_id')}), '^{_white}|{_white}$', '', 'g'))", lambda: F.lower(F.regexp_replace(U.normal(F.expr(_written("doc_id")), "NFC"), f"^{_white}|{_white}$", "")))
rule("norm_search", "documents", "doc_id", "term", f"lower({U.unmarked_sql(_written('doc_id'))})", lambda: F.lower(U.unmarked(F.expr(_written("doc_id")))))
_named = "concat(' ', p_name, '_', chr(9), p_type, '--É', 'e\u0301 ', chr(10))"
rule("norm_text_compare", "part", "p_partkey", "name", _compare(_named), lambda: text_compare(F.expr(_named)))
rule("norm_typology", "part", "p_partkey", "kind", f"coalesce(MAP {TYPOLOGY}[{_compare(_home)}], {_compare(_home)})", lambda: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPOLOGY.items() for x in kv)), text_compare(F.expr(_home))), text_compare(F.expr(_home))))
rule("slug_typology", "part", "p_partkey", "slug", S.slug_sql("concat(p_type, ' — ', p_name)"), lambda: S.slug(F.concat("p_type", F.lit(" — "), "p_name")))
rule("slug_stable", "customer", "c_custkey", "slug", S.slug_sql("CASE WHEN c_custkey % 7 = 0 THEN '--' ELSE c_name END"), lambda: S.slug(F.expr("CASE WHEN c_custkey % 7 = 0 THEN '--' ELSE c_name END")))
_money = "CASE o_orderpriority WHEN '1-URGENT' THEN 'PEN' WHEN '2-HIGH' THEN 'USD' WHEN '3-MEDIUM' THEN 'pen' ELSE NULL END"
rule("norm_currency", "orders", "o_orderkey", "currency", f"CASE WHEN {_money} IN ('PEN', 'USD') THEN {_money} ELSE 'unknown' END", lambda: F.expr(f"CASE WHEN {_money} IN ('PEN', 'USD') THEN {_money} ELSE 'unknown' END"))
_marked = "concat(' <b>', chr(7), text, chr(10), '</b> ')"
rule("safe_text", "benchmark", "item_id", "safe", T.safe_text_sql(_marked), lambda: T.safe_text(F.expr(_marked)))
rule("norm_query", "benchmark", "item_id", "query", T.normalised_sql(_written("item_id")), lambda: T.normalised(F.expr(_written("item_id"))))
rule("issue_id", "events", "event_id", "issue_id", "concat('issue:', regexp_replace(concat(event_type, '.', event_id), '[^a-z0-9]+', '-', 'g'))", lambda: F.concat(F.lit("issue:"), F.regexp_replace(F.concat("event_type", F.lit("."), F.col("event_id").cast("string")), "[^a-z0-9]+", "-")))
_id, _idp, _shap = "concat(CASE WHEN doc_id % 9 = 0 THEN 'Doc' ELSE 'doc' END, ':', source, '-', doc_id)", "^[a-z][a-z0-9_-]*:[a-z0-9][a-z0-9._-]*$", "^[a-f0-9]{64}$"
query("id_pattern", f"SELECT doc_id, regexp_matches({_id}, '{_idp}') AS id_ok, regexp_matches(CASE WHEN doc_id % 5 = 0 THEN upper(sha256(text)) ELSE sha256(text) END, '{_shap}') AS sha_ok FROM documents")(
    lambda spark, d: A.table(spark, d, "documents").select("doc_id", F.rlike(F.expr(_id), F.lit(_idp)).alias("id_ok"), F.rlike(F.expr("CASE WHEN doc_id % 5 = 0 THEN upper(sha2(text, 256)) ELSE sha2(text, 256) END"), F.lit(_shap)).alias("sha_ok"))
)


@query("path_variants", """WITH a AS (SELECT page_id, concat(url, '/%25252e%252e/x%20y') AS v0 FROM pages), b AS (SELECT *, url_decode(v0) AS v1 FROM a), c AS (SELECT *, url_decode(v1) AS v2 FROM b), e AS (SELECT *, url_decode(v2) AS v3 FROM c)
SELECT page_id, array_to_string(list_distinct([v0, v1, v2, v3]), '') = '' AS none, len(list_distinct([v0, v1, v2, v3])) AS variants, v3 AS last, contains(v3, '/../') AS traversal FROM e""")
def path_variants(spark, d):
    out = A.table(spark, d, "pages").select("page_id", F.concat("url", F.lit("/%25252e%252e/x%20y")).alias("v0"))
    for k in range(3):
        out = out.withColumn(f"v{k + 1}", F.coalesce(F.try_url_decode(f"v{k}"), f"v{k}"))
    return out.select("page_id", F.lit(False).alias("none"), F.size(F.array_distinct(F.array("v0", "v1", "v2", "v3"))).cast("long").alias("variants"), F.col("v3").alias("last"), F.contains("v3", F.lit("/../")).alias("traversal"))


@query("json_canonical", "SELECT p_partkey, CAST(to_json({'brand': p_brand, 'name': p_name, 'size': p_size}) AS VARCHAR) AS json FROM part")
def json_canonical(spark, d):
    return A.table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), {"ignoreNullFields": "false"}).alias("json"))


#: A document of each event, up to seven levels deep, with arrays in arrays, empty parts and some keys and values that may not be published.
_doc = """concat('{"id": ', event_id, ', "kind": "', event_type, '", "value": ', CAST(event_id % 7 AS VARCHAR(9)), '.25, "props": ', props, ', "owner": {', CASE WHEN event_id % 10 = 0 THEN concat('"email": "u', user_id, '@x.org"') ELSE concat('"name": "u', user_id, '"') END,
', "tags": ["a", ', event_id % 9, ', [true, ["x", {"deep": {"note": "', CASE WHEN event_id % 17 = 0 THEN 'ask +51 999 888 777' ELSE 'ok' END, '"}}]]]}, "policy": {"contains_contact_pii": ', CASE WHEN event_id % 13 = 0 THEN 'true' ELSE 'false' END, '}, "empty": {}, "none": null, "list": []',
CASE WHEN event_id % 19 = 0 THEN ', "old_phone_2": 5' ELSE '' END, CASE WHEN event_id % 101 = 0 THEN '' ELSE '}' END)"""
_tree = f"""docs AS (SELECT event_id, {_doc} AS text FROM events), tree AS (SELECT event_id, t.fullkey AS path, CASE WHEN t.fullkey LIKE '%]' OR t.fullkey = '$' THEN NULL ELSE regexp_extract(t.fullkey, '[.]([^.]+)$', 1) END AS name,
CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, t.atom ->> '$' AS value FROM (SELECT event_id, CAST(text AS JSON) AS j FROM docs WHERE json_valid(text)) d, json_tree(d.j) t)"""


def walked(spark, d):
    return D.walk(A.table(spark, d, "events").select("event_id", F.expr(_doc).alias("text")), "event_id", "text")


@query("json_recursive_scan", f"WITH {_tree} SELECT event_id, path, kind, value FROM tree UNION ALL SELECT event_id, '$', 'invalid', NULL FROM docs WHERE NOT json_valid(text)")
def json_scan(spark, d):
    return walked(spark, d).select("event_id", "path", "kind", "value")


_forbidden = " OR ".join(f"contains(concat('_', lower(name), '_'), '_{w}_')" for w in D.FORBIDDEN_WORDS)
_breaks = [f"SELECT event_id, path, 'forbidden_key' AS code FROM tree WHERE ({_forbidden}) AND NOT (name IN ('contains_contact_pii', 'raw_payloads_included') AND kind = 'boolean' AND value = 'false')"]
_breaks += [f"SELECT event_id, path, '{k}' FROM tree WHERE kind = 'string' AND regexp_matches(value, '{p}')" for k, p in E.PATTERNS.items()]
query("check_document_privacy", f"WITH {_tree} {' UNION ALL '.join(_breaks)}")(lambda spark, d: D.private(walked(spark, d), "event_id"))


#: Paths into an order with its lines: a plain one, all elements, those that a field tells, nested arrays, and fields that aren't there.
PATHS = {"owner": "owner.id", "numbers": "lines[].line", "returned": "lines[R].line", "notes": "lines[A].notes[]", "kinds": "lines[].kind.flag", "absent": "owner.none", "nothing": "owner[].id"}
_picked = lambda where, what: f"array_to_string(list_transform(list_filter(ls, lambda x: {where}), lambda x: {what}), ',')"


@query("json_path_select", f"""WITH l AS (SELECT l_orderkey, list({{'line': l_linenumber, 'flag': l_returnflag, 'status': l_linestatus}} ORDER BY l_linenumber, l_returnflag, l_linestatus) AS ls FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS owner, coalesce({_picked('true', 'x.line')}, '') AS numbers, coalesce({_picked("x.flag = 'R' OR x.status = 'R'", 'x.line')}, '') AS returned, coalesce({_picked("x.flag = 'A' OR x.status = 'A'", "concat('n', x.line, ',', x.status)")}, '') AS notes,
coalesce({_picked('true', 'x.flag')}, '') AS kinds, 1 AS absent, 0 AS nothing FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def json_select(spark, d):
    """Values at paths of an order's document; an order has few lines."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.struct(F.col("l_returnflag").alias("flag")).alias("kind"), F.array(F.concat(F.lit("n"), F.col("l_linenumber").cast("string")), "l_linestatus").alias("notes"))
    lines = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    own = A.table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.struct(F.struct(F.col("o_custkey").alias("id")).alias("owner"), "lines").alias("order"))
    found = {k: P.at(path, "order", own.schema) for k, path in PATHS.items()}
    counted = {k: F.size(found.pop(k)) for k in ("absent", "nothing")}
    return own.select("o_orderkey", *(F.array_join(v.cast("array<string>"), ",").alias(k) for k, v in found.items()), *(v.alias(k) for k, v in counted.items()))


_stamp = "concat('20', lpad(CAST(event_id % 30 AS VARCHAR(10)), 2, '0'), '-', lpad(CAST(event_id % 14 AS VARCHAR(10)), 2, '0'), '-', lpad(CAST(event_id % 33 AS VARCHAR(10)), 2, '0'), 'T', lpad(CAST(event_id % 25 AS VARCHAR(10)), 2, '0'), ':', lpad(CAST(event_id % 61 AS VARCHAR(10)), 2, '0'), ':00', CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:30' WHEN 2 THEN '-24:00' ELSE '' END)"
_rfc = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
_field = lambda a, n: f"TRY_CAST(substr(s, {a}, {n}) AS INTEGER)"
_leap = f"({_field(1, 4)} % 4 = 0 AND ({_field(1, 4)} % 100 <> 0 OR {_field(1, 4)} % 400 = 0))"
_days = f"CASE WHEN {_field(6, 2)} IN (4, 6, 9, 11) THEN 30 WHEN {_field(6, 2)} = 2 THEN CASE WHEN {_leap} THEN 29 ELSE 28 END ELSE 31 END"
_sound = f"{_field(6, 2)} BETWEEN 1 AND 12 AND {_field(9, 2)} BETWEEN 1 AND {_days} AND {_field(12, 2)} <= 23 AND {_field(15, 2)} <= 59 AND {_field(18, 2)} <= 59 AND (length(s) = 20 OR {_field(21, 2)} <= 23 AND {_field(24, 2)} <= 59)"


@query("rfc3339", f"WITH a AS (SELECT event_id, {_stamp} AS s FROM events) SELECT event_id, s, CASE WHEN regexp_matches(s, '{_rfc}') THEN {_sound} ELSE false END AS valid FROM a")
def rfc3339(spark, d):
    own = A.table(spark, d, "events").select("event_id", F.expr(_stamp).alias("s"))
    return own.select("event_id", "s", F.when(F.rlike("s", F.lit(_rfc)), F.expr(_sound)).otherwise(False).alias("valid"))


_power = "pow(10e0, floor(log10(o_totalprice)))"


@query("nice_distance", f"SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN CASE WHEN o_totalprice / {_power} >= 5 THEN 5e0 WHEN o_totalprice / {_power} >= 2 THEN 2e0 WHEN o_totalprice / {_power} >= 1 THEN 1e0 ELSE 0.5e0 END * {_power} ELSE 100e0 END AS step FROM orders")
def nice_distance(spark, d):
    x = F.col("o_totalprice")
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    step = F.when(x / power >= 5, 5.0).when(x / power >= 2, 2.0).when(x / power >= 1, 1.0).otherwise(0.5)
    return A.table(spark, d, "orders").select("o_orderkey", F.when(x > 0, step * power).otherwise(100.0).alias("step"))


_space = {"x": "l_discount * 5", "y": "l_tax * 8", "width": "l_quantity / 50", "height": "l_linenumber / 9e0", "space": "CASE l_linenumber WHEN 1 THEN 'pixels' WHEN 2 THEN 'other' ELSE 'normalized' END"}
_scale = "CASE WHEN space = 'pixels' THEN 4e0 ELSE 1e0 END"
_fits = f"space IN ('pixels', 'normalized') AND x >= 0 AND y >= 0 AND width > 0 AND height > 0 AND x + width <= {_scale} AND y + height <= {_scale}"
_region = {k: f"{v} / ({_scale}) * 100" for k, v in (("left_pct", "x"), ("top_pct", "y"), ("width_pct", "width"), ("height_pct", "height"))}


@query("region_normalize", f"WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'{v} AS {k}' for k, v in _space.items())} FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(h(v, 6) + f' AS {k}' for k, v in _region.items())} FROM a WHERE {_fits}")
def region_normalize(spark, d):
    own = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(F.expr(v).alias(k) for k, v in _space.items())).where(_fits)
    return own.select("l_orderkey", "l_linenumber", "l_partkey", *(S.half_up(F.expr(v), 6).alias(k) for k, v in _region.items()))


@query("bedroom_match", f"{LISTINGS} SELECT listing_id, CASE WHEN coalesce(bedrooms_min, 0) <> 0 AND coalesce(bedrooms_max, 0) <> 0 THEN 2 BETWEEN bedrooms_min AND bedrooms_max ELSE contains(concat(coalesce(bedrooms_min, 0), '-', coalesce(units, 0)), '2') END AS has_two FROM listings")
def bedroom_match(spark, d):
    low, high = F.coalesce("bedrooms_min", F.lit(0)), F.coalesce("bedrooms_max", F.lit(0))
    text = F.concat(low.cast("string"), F.lit("-"), F.coalesce("units", F.lit(0)).cast("string"))
    return A.listings(spark, d, "listing_id", "bedrooms_min", "bedrooms_max", "units").select("listing_id", F.when((low != 0) & (high != 0), F.lit(2).between(low, high)).otherwise(F.contains(text, F.lit("2"))).alias("has_two"))


_ppm = "CASE WHEN units % 3 = 0 THEN ppm END"
_area = "coalesce(CASE WHEN phase = 'F' THEN area END, CASE WHEN phase = 'O' THEN area * 0.9e0 END, area * 1.1e0)"


@query("legacy_price_m2", f"{LISTINGS} SELECT listing_id, {h(f'coalesce({_ppm}, {S.ratio_sql('price', _area)})', 4)} AS price_m2 FROM listings")
def legacy_price(spark, d):
    return A.listings(spark, d, "listing_id", "units", "ppm", "phase", "area", "price").select("listing_id", S.half_up(F.coalesce(F.expr(_ppm), S.ratio(F.col("price"), F.expr(_area))), 4).alias("price_m2"))


@query("sample_head", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 240")
def sample_head(spark, d):
    return A.table(spark, d, "documents").orderBy("doc_id").limit(240).select("doc_id", "n_chars")


_movers = "SELECT 'price' AS kind, CAST(event_id AS VARCHAR) AS id, percent AS value FROM assessed WHERE percent IS NOT NULL AND percent <> 0 ORDER BY abs(percent) DESC, event_id LIMIT 5"
_loads = "SELECT 'district' AS kind, CAST(c_nationkey AS VARCHAR) AS id, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey ORDER BY 3 DESC, c_nationkey LIMIT 3"


@query("top_market_events", f"{PH._assessed}, p AS ({_movers}), q AS ({_loads}) SELECT * FROM p UNION ALL SELECT * FROM q")
def top_market_events(spark, d):
    movers = PH.assessed(spark, d).where("percent is not null and percent <> 0").orderBy(F.desc(F.abs("percent")), "event_id").limit(5)
    loads = A.listings(spark, d, "district_id").groupBy("district_id").agg(F.count("*").cast("double").alias("value")).orderBy(F.desc("value"), "district_id").limit(3)
    return movers.select(F.lit("price").alias("kind"), F.col("event_id").cast("string").alias("id"), F.col("percent").alias("value")).unionByName(loads.select(F.lit("district").alias("kind"), F.col("district_id").cast("string").alias("id"), "value"))


@query("agg_coverage_agencies", f"""{M.sql('facts')} SELECT source_id, count(*) AS fields, {h('avg(CASE WHEN normalized_value > 0 THEN 100e0 ELSE 0e0 END)', 0)} AS coverage, {h('avg(CASE WHEN benchmark_eligible THEN 100e0 ELSE 0e0 END)', 0)} AS evidence, count(*) FILTER (quality_status = 'certified' AND benchmark_eligible) AS primary_candidates,
count(*) FILTER (quality_status = 'reviewable') AS review_fields, arg_min(field_name, fact_id) AS first_field FROM facts GROUP BY 1""")
def coverage_agencies(spark, d):
    share = lambda c: S.half_up(F.avg(F.when(c, 100.0).otherwise(0.0)), 0)
    return M.read(spark, d, "facts").groupBy("source_id").agg(
        F.count("*").alias("fields"), share(F.col("normalized_value") > 0).alias("coverage"), share(F.col("benchmark_eligible")).alias("evidence"), F.count_if(F.expr("quality_status = 'certified' AND benchmark_eligible")).alias("primary_candidates"),
        F.count_if(F.col("quality_status") == "reviewable").alias("review_fields"), F.min_by("field_name", "fact_id").alias("first_field"),
    )


_scope = "CASE WHEN s_acctbal > 8000 THEN 'MVP automatizable' WHEN s_acctbal > 4000 THEN 'MVP condicionado / enriquecimiento' WHEN s_acctbal > 1000 THEN 'Backlog posterior' ELSE 'Fuera de alcance' END"
_go = "CASE WHEN s_acctbal > 6000 THEN 'Go' WHEN s_nationkey % 3 = 0 THEN 'Review' ELSE 'No-go' END"
for _name, _dimensions in (("agg_scope_summary", ("scope_level", "final_decision", "archetype")), ("normalize_scope_match", ())):
    _own = f"own AS (SELECT s_suppkey, {S.clean_sql('s_name')} AS agency, {_scope} AS scope_level, {_go} AS final_decision, CAST(s_nationkey % 4 AS VARCHAR) AS archetype FROM supplier)"

    def scope_rows(spark, d):
        return A.table(spark, d, "supplier").select("s_suppkey", S.clean("s_name").alias("agency"), F.expr(_scope).alias("scope_level"), F.expr(_go).alias("final_decision"), (F.col("s_nationkey") % 4).cast("string").alias("archetype"))

    if _dimensions:
        query(_name, f"WITH {_own} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS name, count(*) AS n FROM own GROUP BY 2" for c in _dimensions))(lambda spark, d, c=_dimensions: L.distribution(scope_rows(spark, d), *c))
    else:
        query(_name, f"WITH {_own} SELECT * FROM own")(scope_rows)


@query("agg_registry_report", f"""WITH own AS (SELECT s_suppkey, {S.slug_sql('s_name')} AS slug, {_go} AS decision, s_nationkey % 6 = 1 AS manual FROM supplier)
SELECT 'raw' AS measure, count(*) AS n FROM own UNION ALL SELECT 'canonical', count(DISTINCT slug) FROM own UNION ALL SELECT 'resolved', count(*) FROM own WHERE NOT manual UNION ALL SELECT 'manual_review', count(*) FROM own WHERE manual UNION ALL SELECT concat('decision:', decision), count(*) FROM own GROUP BY decision""")
def registry_report(spark, d):
    own = A.table(spark, d, "supplier").select(S.slug("s_name").alias("slug"), F.expr(_go).alias("decision"), (F.col("s_nationkey") % 6 == 1).alias("manual"))
    one = own.agg(F.count("*").alias("raw"), F.countDistinct("slug").alias("canonical"), F.count_if(~F.col("manual")).alias("resolved"), F.count_if("manual").alias("manual_review"))
    counts = one.unpivot([], ["raw", "canonical", "resolved", "manual_review"], "measure", "n")
    return counts.unionByName(own.groupBy(F.concat(F.lit("decision:"), "decision").alias("measure")).agg(F.count("*").alias("n")))


for _name, _least in (("sample_status", 3), ("quality_projection", 5)):
    query(_name, f"{LISTINGS} SELECT district, typology, count(ppm) AS n, CASE WHEN count(ppm) = 0 THEN 'insufficient' WHEN count(ppm) < {_least} THEN 'orientative' ELSE 'ready' END AS status, {h('avg(CASE WHEN ppm > 0 THEN 1e0 ELSE 0e0 END)', 4)} AS pass_rate FROM listings GROUP BY 1, 2")(
        lambda spark, d, k=_least: A.listings(spark, d, "district", "typology", "ppm").groupBy("district", "typology").agg(F.count("ppm").alias("n"), S.half_up(F.avg(F.when(F.col("ppm") > 0, 1.0).otherwise(0.0)), 4).alias("pass_rate")).withColumn("status", F.when(F.col("n") == 0, "insufficient").when(F.col("n") < k, "orientative").otherwise("ready"))
    )

_event = "event_id, entity_id, field, direction, delta, percent, status, concat('lineage:', entity_id, ':', field) AS lineage_id"
query("history_event_projection", f"{PH._assessed} SELECT {_event} FROM assessed")(lambda spark, d: PH.assessed(spark, d).selectExpr(*_event[: _event.index(", concat")].split(", "), _event[_event.index("concat") :]))


@query("history_detail", f"{PH._assessed} SELECT field, event_id, status, percent FROM assessed WHERE (field, event_id) IN (SELECT (field, max(event_id)) FROM assessed GROUP BY field)")
def history_detail(spark, d):
    return PH.assessed(spark, d).groupBy("field").agg(F.max(F.struct("event_id", "status", "percent")).alias("e")).select("field", "e.*")


_published = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END"


@query("published_prices", f"WITH {A.CHANGES_SQL}, p AS (SELECT event_id, coalesce({_published}, min(value) OVER w) AS current_price, lag(value) OVER (PARTITION BY entity_id, field ORDER BY ts, event_id) AS previous_price FROM changes WINDOW w AS (PARTITION BY entity_id, field ORDER BY ts, event_id)) SELECT *, current_price IS DISTINCT FROM previous_price AS changed FROM p")
def published_prices(spark, d):
    order = W.partitionBy("entity_id", "field").orderBy("ts", "event_id")
    current = F.coalesce(F.expr(_published), F.min("value").over(order))
    own = A.changes(spark, d).select("event_id", current.alias("current_price"), F.lag("value").over(order).alias("previous_price"))
    return own.withColumn("changed", ~F.col("current_price").eqNullSafe(F.col("previous_price")))


@query("district_counts", f"{PH._assessed} SELECT n_name AS district, count(*) AS n FROM assessed JOIN supplier ON s_suppkey = entity_id JOIN nation ON n_nationkey = s_nationkey WHERE delta <> 0 AND abs(percent) <= 30 AND status <> 'insufficient' GROUP BY 1")
def district_counts(spark, d):
    places = A.table(spark, d, "supplier").join(A.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("entity_id"), F.col("n_name").alias("district"))
    return PH.assessed(spark, d).where("delta <> 0 and abs(percent) <= 30 and status <> 'insufficient'").join(places, "entity_id").groupBy("district").agg(F.count("*").alias("n"))


@query("controlled_agencies", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 3 THEN 'D' ELSE 'E' END AS fixture, count(*) OVER (PARTITION BY s_name) > 1 AS repeated FROM supplier WHERE s_suppkey % 6 NOT IN (2, 5)")
def controlled_agencies(spark, d):
    own = A.table(spark, d, "supplier").where("s_suppkey % 6 NOT IN (2, 5)")
    names = own.groupBy("s_name").agg((F.count("*") > 1).alias("repeated"))
    return own.join(names, "s_name").selectExpr("s_suppkey", "CASE s_suppkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 3 THEN 'D' ELSE 'E' END AS fixture", "repeated")


@query("market_districts", f"{LISTINGS}, g AS (SELECT district_id, district, count(*) AS projects FROM listings GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (ORDER BY projects DESC, district_id) AS INTEGER) AS rank FROM g) SELECT district, projects, rank, district_id = 9 AS active FROM r WHERE rank <= 7 OR district_id = 9")
def market_districts(spark, d):
    own = A.listings(spark, d, "district_id", "district").groupBy("district_id", "district").agg(F.count("*").alias("projects"))
    ranked = own.withColumn("rank", F.row_number().over(W.orderBy(F.desc("projects"), "district_id")))  # one row of each district
    return ranked.where("rank <= 7 or district_id = 9").select("district", "projects", "rank", (F.col("district_id") == 9).alias("active"))


_level = "CASE WHEN projects >= 60 OR agencies >= 28 THEN 'Alta' WHEN projects >= 20 OR agencies >= 10 THEN 'Media' ELSE 'Baja' END"
_position = "CASE WHEN mean IS NULL THEN 'sin precio' WHEN 1500 < mean * 0.92e0 THEN 'Entrada competitiva' WHEN 1500 > mean * 1.08e0 THEN 'Sobre el mercado' ELSE 'Alineado al mercado' END"
# Sentences of advice.
_advice = f"""CASE WHEN ({_position}) = 'sin precio' THEN CASE WHEN pressure THEN 'Priorizar diferenciación por ubicación, entrega y atributos visibles.' ELSE 'Explorar una campaña de entrada con educación del distrito y captura temprana de leads.' END
WHEN ({_position}) = 'Entrada competitiva' THEN CASE WHEN pressure THEN 'Comunicar oportunidad, ahorro relativo y urgencia frente a competidores directos.' ELSE 'Posicionar como alternativa de valor y capturar leads tempranos.' END
WHEN ({_position}) = 'Alineado al mercado' THEN CASE WHEN pressure THEN 'Diferenciar por ubicación, entrega, financiamiento y áreas comunes.' ELSE 'Reforzar atributos del distrito y beneficios concretos para sostener conversión.' END
ELSE 'Reforzar ubicación, acabados, exclusividad, financiamiento y beneficios diferenciales en la campaña.' END"""
_market = f"{LISTINGS}, g AS (SELECT district, typology, count(*) AS projects, count(DISTINCT agency) AS agencies, avg(ppm) AS mean FROM listings GROUP BY 1, 2), m AS (SELECT *, projects >= 24 OR ({_level}) = 'Alta' AS pressure FROM g)"


def market(spark, d):
    own = A.listings(spark, d, "district", "typology", "agency", "ppm").groupBy("district", "typology").agg(F.count("*").alias("projects"), F.countDistinct("agency").alias("agencies"), F.avg("ppm").alias("mean"))
    return own.withColumn("pressure", F.expr(f"projects >= 24 OR ({_level}) = 'Alta'"))


query("commercial_recommendation", f"{_market} SELECT district, typology, {_position} AS position, pressure, {_advice} AS action FROM m")(lambda spark, d: market(spark, d).selectExpr("district", "typology", f"{_position} AS position", "pressure", f"{_advice} AS action"))
# The sentence of a district's insight.
_insight = f"concat(district, ' muestra ', lower({_level}), ' competencia, ', projects, ' proyectos visibles y una ', CASE WHEN mean IS NULL THEN 'precio por m2 aún no concluyente' ELSE 'media publicada' END, '.')"
query("district_insight", f"{_market} SELECT district, typology, {_insight} AS text FROM m")(lambda spark, d: market(spark, d).selectExpr("district", "typology", f"{_insight} AS text"))


@query("top_competitors", f"{LISTINGS} SELECT district, listing_id, rank FROM (SELECT district, listing_id, CAST(row_number() OVER (PARTITION BY district ORDER BY abs(price - 200000), listing_id) AS INTEGER) AS rank FROM listings WHERE contains(lower(agency), '1')) WHERE rank <= 3")
def top_competitors(spark, d):
    own = A.listings(spark, d, "district", "listing_id", "price", "agency").where(F.contains(F.lower("agency"), F.lit("1")))
    return L.rank_within(own, "district", 3, F.abs(F.col("price") - 200000), F.col("listing_id")).select("district", "listing_id", "rank")


_canonical = "CASE WHEN id LIKE 'project:%' THEN id WHEN id LIKE 'observed:feed-%' THEN concat('project:feed-', substr(id, 15)) WHEN id LIKE 'observed:%' THEN NULL ELSE concat('project:feed-', id) END"
_observed = "CASE WHEN id LIKE 'observed:%' THEN id WHEN id LIKE 'project:feed-%' THEN concat('observed:feed-', substr(id, 14)) WHEN id LIKE 'project:%' THEN NULL ELSE concat('observed:feed-', id) END"
_legacy = "CASE WHEN id LIKE 'project:feed-%' THEN substr(id, 14) WHEN id LIKE 'observed:feed-%' THEN substr(id, 15) WHEN contains(id, ':') THEN NULL ELSE id END"
_names = "concat(CASE p_partkey % 5 WHEN 0 THEN 'project:' WHEN 1 THEN 'project:feed-' WHEN 2 THEN 'observed:feed-' WHEN 3 THEN 'observed:' ELSE '' END, p_partkey)"
query("join_id_translation", f"WITH a AS (SELECT p_partkey, {_names} AS id FROM part), u AS (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1) SELECT p_partkey, {_canonical} AS canonical, {_observed} AS observed, {_legacy} AS legacy, uses FROM a LEFT JOIN u ON l_partkey = p_partkey")(
    lambda spark, d: A.table(spark, d, "part").selectExpr("p_partkey", f"{_names} AS id").join(A.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses")), "p_partkey", "left").selectExpr("p_partkey", f"{_canonical} AS canonical", f"{_observed} AS observed", f"{_legacy} AS legacy", "uses")
)


@query("join_map_rows", f"""{LISTINGS} SELECT l.listing_id, n_name AS place, r_name AS region, CASE WHEN currency <> 'PEN' THEN 'excluded' WHEN ppm IS NULL THEN 'without price' WHEN ppm > 1500 THEN 'above' ELSE 'reference' END AS status
FROM listings l LEFT JOIN nation ON n_nationkey = district_id LEFT JOIN region ON r_regionkey = n_regionkey""")
def map_rows(spark, d):
    places = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("place"), F.col("r_name").alias("region"))
    status = F.when(F.col("currency") != "PEN", "excluded").when(F.col("ppm").isNull(), "without price").when(F.col("ppm") > 1500, "above").otherwise("reference")
    return A.listings(spark, d, "listing_id", "district_id", "currency", "ppm").join(places, "district_id", "left").select("listing_id", "place", "region", status.alias("status"))


@query("join_comparable_rows", f"{LISTINGS}, ids AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1:3] AS ids FROM orders GROUP BY 1), e AS (SELECT o_custkey, unnest(ids) AS listing_id, unnest(range(len(ids))) AS position FROM ids) SELECT e.o_custkey, e.position, l.listing_id, l.price, ppm IS NOT NULL AS has_price FROM e LEFT JOIN listings l ON l.listing_id = e.listing_id")
def comparable_rows(spark, d):
    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    ids = A.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("listing_id"), (F.row_number().over(order) - 1).cast("long").alias("position")).where("position < 3")
    return ids.join(A.listings(spark, d, "listing_id", "price", "ppm"), "listing_id", "left").select("o_custkey", "position", "listing_id", "price", F.col("ppm").isNotNull().alias("has_price"))


@query("district_alias_index", f"WITH a AS (SELECT n_nationkey, unnest([n_name, lower(n_name), concat('Distrito ', n_nationkey % 20)]) AS alias FROM nation), k AS (SELECT DISTINCT {S.words_sql('alias')} AS key, n_nationkey FROM a) SELECT key, min(n_nationkey) AS district_id, count(*) > 1 AS ambiguous FROM k GROUP BY 1")
def district_alias_index(spark, d):
    names = F.explode(F.array("n_name", F.lower("n_name"), F.concat(F.lit("Distrito "), (F.col("n_nationkey") % 20).cast("string"))))
    keys = A.table(spark, d, "nation").select("n_nationkey", names.alias("alias")).select(S.words("alias").alias("key"), "n_nationkey").distinct()
    return keys.groupBy("key").agg(F.min("n_nationkey").alias("district_id"), (F.count("*") > 1).alias("ambiguous"))


@query("pilot_preconditions", f"""WITH own AS (SELECT s_suppkey, s_nationkey, {_go} AS decision, s_suppkey % 7 = 0 AS mandatory FROM supplier), n AS (SELECT count(*) FILTER (mandatory) AS mandatory, count(*) FILTER (s_suppkey IN (14, 21)) AS pair, count(*) FILTER (mandatory AND decision = 'No-go') AS contradictions FROM own)
SELECT 'mandatory' AS condition, mandatory AS found, mandatory >= 10 AS met FROM n UNION ALL SELECT 'alias_pair', pair, pair = 2 FROM n UNION ALL SELECT 'no_contradiction', contradictions, contradictions = 0 FROM n""")
def pilot_preconditions(spark, d):
    own = A.table(spark, d, "supplier").selectExpr("s_suppkey", f"{_go} AS decision", "s_suppkey % 7 = 0 AS mandatory")
    one = own.agg(F.count_if("mandatory").alias("m"), F.count_if(F.col("s_suppkey").isin(14, 21)).alias("p"), F.count_if(F.expr("mandatory AND decision = 'No-go'")).alias("c"))
    row = lambda name, n, met: F.struct(F.lit(name).alias("condition"), F.col(n).alias("found"), met.alias("met"))
    return one.select(F.inline(F.array(row("mandatory", "m", F.col("m") >= 10), row("alias_pair", "p", F.col("p") == 2), row("no_contradiction", "c", F.col("c") == 0))))


# What a scenario may ask for.
MODES, RADII, QUADRANTS = "'district', 'quadrant', 'radius'", "500, 1000, 1500, 2000", "'NE', 'NW', 'SE', 'SW'"
_asked = {
    "asked_district": "CASE WHEN o_orderkey % 11 = 0 THEN 99 ELSE o_custkey % 25 END", "mode": "CASE o_orderkey % 5 WHEN 0 THEN 'quadrant' WHEN 1 THEN 'radius' WHEN 2 THEN 'circle' ELSE 'district' END",
    "quadrant": "CASE o_orderkey % 3 WHEN 0 THEN 'NE' WHEN 1 THEN 'SW' ELSE 'XX' END", "radius": "CASE o_orderkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 700 ELSE 1500 END", "version": "CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END",
}
_valid_scope = f"CASE WHEN version <> 1 THEN 'INVALID_VERSION' WHEN asked_district > 24 THEN 'INVALID_DISTRICT' WHEN mode NOT IN ({MODES}) THEN 'INVALID_SCOPE' WHEN mode = 'quadrant' AND quadrant NOT IN ({QUADRANTS}) THEN 'INVALID_QUADRANT' WHEN mode = 'radius' AND radius NOT IN ({RADII}) THEN 'INVALID_RADIUS_SCOPE' END"
_given = f"CASE WHEN ({_valid_scope}) IS NULL THEN mode ELSE 'district' END"
_fallback = f"CASE WHEN version <> 1 OR asked_district > 24 THEN 0 ELSE asked_district END"
query("scenario_validate", f"WITH a AS (SELECT o_orderkey, {', '.join(f'{e} AS {c}' for c, e in _asked.items())} FROM orders) SELECT o_orderkey, {_valid_scope} AS correction, {_given} AS scope_mode, CAST({_fallback} AS BIGINT) AS district_id FROM a")(
    lambda spark, d: A.table(spark, d, "orders").selectExpr("o_orderkey", *(f"{e} AS {c}" for c, e in _asked.items())).selectExpr("o_orderkey", f"{_valid_scope} AS correction", f"{_given} AS scope_mode", f"CAST({_fallback} AS BIGINT) AS district_id")
)

@query("benchmark_context", f"""{M.sql('facts')}, q AS (SELECT project_id, count(*) AS facts, count(*) FILTER (semantic_type = 'attribute') AS attributes, count(*) FILTER (semantic_type = 'price_per_m2' AND benchmark_eligible) AS references_, avg(CASE WHEN semantic_type = 'price_per_m2' AND benchmark_eligible THEN normalized_value END) AS mean FROM facts GROUP BY 1)
SELECT project_id, facts, attributes, references_, {h('mean', 2)} AS mean, CASE WHEN references_ = 0 THEN 'insufficient' WHEN references_ < 3 OR attributes = 0 THEN 'orientative' ELSE 'ready' END AS status FROM q""")
def benchmark_context(spark, d):
    reference = F.expr("semantic_type = 'price_per_m2' AND benchmark_eligible")
    own = M.read(spark, d, "facts").groupBy("project_id").agg(F.count("*").alias("facts"), F.count_if(F.col("semantic_type") == "attribute").alias("attributes"), F.count_if(reference).alias("references_"), S.half_up(F.avg(F.when(reference, F.col("normalized_value"))), 2).alias("mean"))
    return own.withColumn("status", F.when(F.col("references_") == 0, "insufficient").when((F.col("references_") < 3) | (F.col("attributes") == 0), "orientative").otherwise("ready"))


@query("checklist_model", f"{LISTINGS}, g AS (SELECT district, count(*) AS comparable, count(ppm) AS priced, array_to_string(list(listing_id ORDER BY listing_id)[1:3], ',') AS first_three FROM listings GROUP BY 1) SELECT district, comparable, priced, first_three AS \"references\", CASE WHEN comparable = 0 THEN 'blocked' WHEN priced < 3 THEN 'partial' ELSE 'ready' END AS state FROM g")
def checklist(spark, d):
    own = A.listings(spark, d, "district", "listing_id", "ppm")
    first = L.rank_within(own, "district", 3, F.col("listing_id")).groupBy("district").agg(F.array_join(F.array_sort(F.collect_list("listing_id")).cast("array<string>"), ",").alias("references"))  # three ids
    counts = own.groupBy("district").agg(F.count("*").alias("comparable"), F.count("ppm").alias("priced"))
    return counts.join(first, "district").withColumn("state", F.when(F.col("comparable") == 0, "blocked").when(F.col("priced") < 3, "partial").otherwise("ready"))
