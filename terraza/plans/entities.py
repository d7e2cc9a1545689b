"""Queries on entities, matches and ledgers of facts."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import entities as N
from terraza.operators import ordered as O
from terraza.registry import query
from terraza.sources import adapter as A

LISTINGS, FACTS, EVIDENCE, CHANGES = (f"WITH {x}" for x in (A.LISTINGS_SQL, A.FACTS_SQL, A.EVIDENCE_SQL, A.CHANGES_SQL))


@query("join_alias_agency", f"SELECT s.s_suppkey, {S.words_sql('s.s_name')} AS alias, c.agency FROM supplier s LEFT JOIN (SELECT {S.words_sql('c_name')} AS alias, min(c_custkey) AS agency FROM customer GROUP BY 1) c ON replace({S.words_sql('s.s_name')}, 'supplier', 'customer') = c.alias")
def join_alias(spark, d):
    aliases = A.table(spark, d, "customer").groupBy(S.words("c_name").alias("alias")).agg(F.min("c_custkey").alias("agency")).withColumn("alias", F.replace("alias", F.lit("customer"), F.lit("supplier")))
    return N.alias_join(A.table(spark, d, "supplier").select("s_suppkey", "s_name"), aliases, "s_name").select("s_suppkey", "alias", "agency")


_metrics = f"{LISTINGS}, m AS (SELECT agency, count(*) AS listings, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, bool_or(coalesce(units > 6, false)) AS deep, count(DISTINCT typology) AS typologies FROM listings GROUP BY 1)"


def metrics(spark, d):
    return A.listings(spark, d, "agency", "units", "typology").groupBy("agency").agg(F.count("*").alias("listings"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.bool_or(F.coalesce(F.col("units") > 6, F.lit(False))).alias("deep"), F.countDistinct("typology").alias("typologies"))


@query("join_candidate_metrics", f"{_metrics} SELECT * FROM m")
def candidate_metrics(spark, d):
    return metrics(spark, d)


@query("tier_assignment", f"{_metrics} SELECT agency, CASE WHEN deep AND typologies >= 3 THEN 'deep' WHEN listings >= 10 THEN 'enriched' ELSE 'base' END AS tier FROM m")
def tier_assignment(spark, d):
    return metrics(spark, d).select("agency", N.tier(F.col("deep") & (F.col("typologies") >= 3), F.col("listings") >= 10).alias("tier"))


@query("agg_pilot_counts", f"{_metrics}, t AS (SELECT CASE WHEN deep AND typologies >= 3 THEN 'deep' WHEN listings >= 10 THEN 'enriched' ELSE 'base' END AS tier FROM m) SELECT tier, count(*) AS n FROM t GROUP BY 1")
def pilot_counts(spark, d):
    return tier_assignment(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query("rank_pilot", f"{_metrics}, c AS (SELECT *, typologies >= 5 AS mandatory FROM m ORDER BY mandatory DESC, listings DESC, units DESC, agency LIMIT 30) SELECT agency, mandatory, listings, CAST(row_number() OVER (ORDER BY listings DESC, units DESC, agency) AS INTEGER) AS rank FROM c")
def rank_pilot(spark, d):
    return N.pilot(metrics(spark, d), F.col("typologies") >= 5, 30, F.desc("listings"), F.desc("units"), F.col("agency")).select("agency", "mandatory", "listings", "rank")


@query("build_pilot", f"{LISTINGS} SELECT district, count(*) AS n FROM listings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def build_pilot(spark, d):
    return A.listings(spark, d, "district").groupBy("district").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "district").limit(7)


# One record of an order's line: what was published, how it is paired, and whether it may be shown.
_record = {
    "price": "CASE WHEN l_quantity > 3 THEN l_extendedprice END", "area": "CASE WHEN l_discount < 0.095 THEN l_quantity END", "currency": "CASE WHEN l_suppkey % 13 = 0 THEN 'USD' ELSE 'PEN' END", "area_type": "CASE WHEN l_suppkey % 7 = 0 THEN 'built' ELSE 'total' END",
    "pairing": "CASE l_linenumber WHEN 1 THEN 'source_paired' WHEN 2 THEN 'source_paired' WHEN 3 THEN 'project_minima_pair_unresolved' ELSE 'unpaired' END", "basis": "CASE WHEN l_tax < 0.065 THEN 'offer_id' ELSE 'guess' END", "restricted": "l_tax > 0.075 AND l_suppkey % 5 = 0",
}
_complete = "price > 0 AND area > 0"
_paired = f"{_complete} AND pairing = 'source_paired' AND basis IN ('offer_id', 'typology_id', 'native_metric') AND currency = 'PEN' AND area_type = 'total'"
STANDING = "CASE WHEN barred > 0 THEN 'restricted' WHEN complete = 0 THEN 'missing' WHEN signatures > 1 THEN 'conflicting_observations' WHEN signatures = 1 THEN 'eligible' WHEN unresolved > 0 THEN 'price_area_link_unresolved' ELSE 'conflicting_observations' END"
_counts = {"barred": "count(CASE WHEN restricted THEN 1 END)", "complete": f"count(CASE WHEN {_complete} THEN 1 END)", "unresolved": f"count(CASE WHEN {_complete} AND pairing = 'project_minima_pair_unresolved' THEN 1 END)"}


@query("benchmark_classify", f"""WITH r AS (SELECT l_orderkey AS listing_id, {', '.join(f'{e} AS {c}' for c, e in _record.items())} FROM lineitem), g AS (SELECT listing_id, {', '.join(f'{e} AS {c}' for c, e in _counts.items())}, count(DISTINCT CASE WHEN {_paired} THEN (price, area) END) AS signatures FROM r GROUP BY 1) SELECT listing_id, {STANDING} AS standing FROM g""")
def benchmark_classify(spark, d):
    """Standing of a listing's records: restricted, missing, in conflict, eligible or of an unresolved pair, in order of precedence."""
    own = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id"), *(F.expr(e).alias(c) for c, e in _record.items()))
    signature = F.when(F.expr(_paired), F.struct("price", "area"))
    return own.groupBy("listing_id").agg(*(F.expr(e).alias(c) for c, e in _counts.items()), F.countDistinct(signature).alias("signatures")).select("listing_id", F.expr(STANDING).alias("standing"))


@query("entry_signature", f"{FACTS} SELECT listing_id, sha256(array_to_string(list_sort(list(DISTINCT concat_ws('|', semantic_type, unit, printf('%.2f', value)))), ';')) AS signature FROM facts GROUP BY 1")
def entry_signature(spark, d):
    return N.signatures(A.facts(spark, d))


@query("modal_typology", f"{LISTINGS}, c AS (SELECT district, typology, count(*) AS n FROM listings WHERE typology IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY n DESC, typology) AS k FROM c) SELECT district, typology, n FROM r WHERE k = 1")
def modal_typology(spark, d):
    return N.modal(A.listings(spark, d, "district", "typology"), "district", "typology")


_field = "CASE l_linenumber WHEN 1 THEN 'area' WHEN 2 THEN 'price' WHEN 3 THEN 'floor' ELSE concat('field', l_linenumber) END"
_shares = {"sampled": "100e0", "coverage": "CASE WHEN l_quantity > 3 THEN 100e0 ELSE 0e0 END", "evidence": "CASE WHEN l_tax < 0.045 THEN 100e0 ELSE 0e0 END", "mismatch": "CASE WHEN l_discount > 0.085 THEN 100e0 ELSE 0e0 END"}
_means = ", ".join(f"{S.half_up_sql(f'avg({e})', 2 if c == 'mismatch' else 0)} AS {c}" for c, e in _shares.items())


@query("agg_coverage_fields", f"""WITH own AS (SELECT {_field} AS field, l_returnflag AS recommended_use, * FROM lineitem), u AS (SELECT field, recommended_use, count(*) AS n FROM own GROUP BY 1, 2), m AS (SELECT field, arg_min(recommended_use, (-n, recommended_use)) AS recommended_use FROM u GROUP BY 1),
g AS (SELECT field, {_means} FROM own GROUP BY 1) SELECT g.*, m.recommended_use, g.field IN ('area', 'price') AS critical FROM g JOIN m ON m.field = g.field""")
def coverage_fields(spark, d):
    own = A.table(spark, d, "lineitem").withColumn("field", F.expr(_field))
    uses = own.groupBy("field", "l_returnflag").agg(F.count("*").alias("n"), *(F.sum(F.expr(e)).alias(c) for c, e in _shares.items()))  # few rows: everything else follows from them
    g = uses.groupBy("field").agg(F.sum("n").alias("total"), F.min_by("l_returnflag", F.struct(-F.col("n"), "l_returnflag")).alias("recommended_use"), *(F.sum(c).alias(c) for c in _shares))
    return g.select("field", "recommended_use", *(S.half_up(F.col(c) / F.col("total"), 2 if c == "mismatch" else 0).alias(c) for c in _shares), F.col("field").isin("area", "price").alias("critical"))


@query("agg_rollup_quality", f"{FACTS} SELECT listing_id, CASE WHEN bool_or(quality = 'reviewable') THEN 'reviewable' ELSE 'certified' END AS quality FROM facts GROUP BY 1")
def rollup_quality(spark, d):
    return N.worst_quality(A.facts(spark, d))


_issue = "SELECT p_partkey FROM part WHERE p_size = 1"


@query("blocked_fact_filter", f"{FACTS} SELECT listing_id, line, source_id, part_id FROM facts WHERE eligible AND part_id NOT IN ({_issue})")
def blocked_facts(spark, d):
    issues = A.table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("part_id"))
    return A.facts(spark, d).where("eligible").join(issues, "part_id", "left_anti").select("listing_id", "line", "source_id", "part_id")


@query("join_blocking_issue", f"{FACTS} SELECT listing_id, count(DISTINCT part_id) AS issues FROM facts WHERE part_id IN ({_issue}) GROUP BY 1")
def blocking_issue(spark, d):
    issues = A.table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("part_id"))
    return A.facts(spark, d).join(issues, "part_id", "left_semi").groupBy("listing_id").agg(F.countDistinct("part_id").alias("issues"))


_bad = S.reasons_sql(ineligible="NOT eligible", not_certified="quality <> 'certified'", value_missing="value IS NULL")


@query("derived_eligibility", f"{FACTS}, e AS (SELECT listing_id, unnest({_bad}) AS reason FROM facts), g AS (SELECT listing_id, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM e GROUP BY 1) SELECT f.listing_id, coalesce(g.reasons, '') AS reasons FROM (SELECT DISTINCT listing_id FROM facts) f LEFT JOIN g ON g.listing_id = f.listing_id")
def derived_eligibility(spark, d):
    why = S.reasons(ineligible=~F.col("eligible"), not_certified=F.col("quality") != "certified", value_missing=F.col("value").isNull())
    return A.facts(spark, d).groupBy("listing_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(why)))), ",").alias("reasons"))


@query("join_reconcile", "SELECT c.c_custkey AS observed, CASE WHEN s.s_suppkey IS NULL THEN 'unreconciled' ELSE 'reconciled' END AS status FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def reconcile(spark, d):
    known = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("observed"), F.lit(True).alias("known"))
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("observed")).join(known, "observed", "left").select("observed", F.when(F.col("known"), "reconciled").otherwise("unreconciled").alias("status"))


@query("range_join_bedrooms", f"{LISTINGS}, t AS (SELECT DISTINCT p_brand, p_size % 6 AS target FROM part) SELECT p_brand, target, count(*) AS n FROM listings JOIN t ON target BETWEEN bedrooms_min AND bedrooms_max GROUP BY 1, 2")
def range_bedrooms(spark, d):
    """Each brand's targets against the listings whose range holds them: listings are counted by bedroom first, so the join has few rows."""
    offered = A.listings(spark, d, "bedrooms_min", "bedrooms_max").where("bedrooms_min is not null").select(F.explode(F.sequence("bedrooms_min", "bedrooms_max")).alias("target")).groupBy("target").agg(F.count("*").alias("n"))
    wanted = A.table(spark, d, "part").select("p_brand", (F.col("p_size") % 6).cast("int").alias("target")).distinct()
    return wanted.join(offered, "target").select("p_brand", "target", "n")


@query("asof_price_change", f"{CHANGES}, v AS (SELECT * FROM changes WHERE field = 'view'), p AS (SELECT * FROM changes WHERE field = 'purchase') SELECT p.event_id, (SELECT max(v.ts) FROM v WHERE v.entity_id = p.entity_id AND v.ts <= p.ts) AS seen FROM p")
def asof(spark, d):
    """The last view of each purchase's entity up to then: views come first of what happens at one time, and the last is carried over ranges."""
    own = A.changes(spark, d).where(F.col("field").isin("view", "purchase")).select("entity_id", "ts", (F.col("field") == "purchase").alias("bought"), "event_id", F.when(F.col("field") == "view", F.col("ts")).alias("viewed"))
    return O.last_known(own, ["entity_id"], ["ts", "bought", "event_id"], "viewed").where("bought").select("event_id", F.col("known").alias("seen"))


@query("restricted_projects", f"{EVIDENCE} SELECT DISTINCT source, doc_id FROM evidence WHERE permission = 'restricted'")
def restricted(spark, d):
    return A.evidence(spark, d).where("permission = 'restricted'").select("source", "doc_id").distinct()


@query("evidence_access", f"{EVIDENCE} SELECT doc_id, permission = 'authorized' AND n_chars > 0 AS openable, array_to_string({S.reasons_sql(restricted="permission = 'restricted'", pending="permission = 'pending'", unavailable="permission = 'unavailable'", empty='n_chars = 0', language_missing='lang IS NULL')}, ',') AS reasons FROM evidence")
def evidence_access(spark, d):
    p = F.col("permission")
    why = S.reasons(restricted=p == "restricted", pending=p == "pending", unavailable=p == "unavailable", empty=F.col("n_chars") == 0, language_missing=F.col("lang").isNull())
    return A.evidence(spark, d).select("doc_id", ((p == "authorized") & (F.col("n_chars") > 0)).alias("openable"), F.array_join(why, ",").alias("reasons"))


@query("agg_qualitative", f"""{LISTINGS}, t AS (SELECT DISTINCT district, listing_id, unnest(string_split(amenities, ' ')) AS attribute FROM listings WHERE amenities IS NOT NULL), n AS (SELECT district, count(*) AS informed FROM listings WHERE amenities IS NOT NULL GROUP BY 1)
SELECT t.district, attribute, count(*) AS announced, informed, {S.half_up_sql('count(*) * 100e0 / informed', 1)} AS prevalence, CASE WHEN informed < 5 THEN 'orientative' ELSE 'ready' END AS status, count(*) FILTER (t.listing_id % 3 = 0) AS documented FROM t JOIN n ON n.district = t.district WHERE attribute <> '' GROUP BY 1, 2, 4""")
def qualitative(spark, d):
    own = A.listings(spark, d, "district", "listing_id", "amenities").where("amenities is not null")
    tokens = own.select("district", "listing_id", F.explode(F.array_distinct(F.split("amenities", " "))).alias("attribute")).where("attribute <> ''")
    informed = own.groupBy("district").agg(F.count("*").alias("informed"))
    return tokens.groupBy("district", "attribute").agg(F.count("*").alias("announced"), F.count_if(F.col("listing_id") % 3 == 0).alias("documented")).join(informed, "district").withColumn("prevalence", S.half_up(F.col("announced") * 100.0 / F.col("informed"), 1)).withColumn("status", F.when(F.col("informed") < 5, "orientative").otherwise("ready"))


@query("opportunity_signals", f"""{LISTINGS}, a AS (SELECT district, agency, count(*) AS n FROM listings GROUP BY 1, 2), g AS (SELECT district, max(n) AS top, CAST(sum(n) AS BIGINT) AS total FROM a GROUP BY 1), i AS (SELECT district, count(*) FILTER (phase = 'F') AS immediate, avg(ppm) AS mean FROM listings GROUP BY 1)
SELECT g.district, total >= 60 AS pressure, coalesce(1500 < mean * 0.92e0, false) AS price, {S.ratio_sql('top', 'total')} >= 0.22e0 AS concentration, immediate >= 10 AS immediate FROM g JOIN i ON i.district = g.district""")
def signals(spark, d):
    own = A.listings(spark, d, "district", "agency", "phase", "ppm").groupBy("district", "agency").agg(F.count("*").alias("n"), F.count_if(F.col("phase") == "F").alias("now"), F.sum("ppm").alias("sum"), F.count("ppm").alias("priced"))
    own = own.groupBy("district").agg(F.max("n").alias("top"), F.sum("n").alias("total"), F.sum("now").alias("now"), F.try_divide(F.sum("sum"), F.sum("priced")).alias("mean"))
    price = F.coalesce(F.lit(1500) < F.col("mean") * 0.92, F.lit(False))
    return own.select("district", (F.col("total") >= 60).alias("pressure"), price.alias("price"), (S.ratio(F.col("top"), F.col("total")) >= 0.22).alias("concentration"), (F.col("now") >= 10).alias("immediate"))


@query("district_mention", "SELECT conv_id, turn, n_name FROM conversations, nation WHERE contains(lower(text), lower(n_name))")
def mention(spark, d):
    names = A.table(spark, d, "nation").agg(F.collect_list("n_name").alias("names"))  # a small, bounded table
    held = F.filter("names", lambda x: F.contains(F.lower("text"), F.lower(x)))
    return A.table(spark, d, "conversations").select("conv_id", "turn", "text").crossJoin(F.broadcast(names)).select("conv_id", "turn", F.explode(held).alias("n_name"))


_said = "CASE WHEN (conv_id + turn) % 4 = 0 THEN concat('¿Qué cambió en ', lower(n.n_name), ' y en ', c.n_name, '? ', text) ELSE text END"


@query("foreign_district_mention", f"""WITH q AS (SELECT conv_id, turn, c.n_nationkey AS home, {S.words_sql(_said)} AS asked FROM conversations JOIN nation c ON c.n_nationkey = conv_id % 25 JOIN nation n ON n.n_nationkey = (conv_id * 7 + turn) % 25 WHERE role = 'user')
SELECT conv_id, turn, n_name FROM q JOIN nation ON n_nationkey <> home AND contains(asked, {S.words_sql('n_name')})""")
def foreign_mention(spark, d):
    """Names of districts other than the scenario's own inside a question; the names, a small, bounded table, come as one array."""
    nation = A.table(spark, d, "nation")
    names = nation.agg(F.collect_list(F.struct("n_nationkey", "n_name", S.words("n_name").alias("words"))).alias("names"))
    own, other = (nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(f"name_{k}")) for k in ("home", "other"))
    asked = A.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text", (F.col("conv_id") % 25).cast("int").alias("home"), ((F.col("conv_id") * 7 + F.col("turn")) % 25).cast("int").alias("other")).join(own, "home").join(other, "other")
    said = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, F.concat(F.lit("¿Qué cambió en "), F.lower("name_other"), F.lit(" y en "), F.col("name_home"), F.lit("? "), "text")).otherwise(F.col("text"))
    held = F.filter("names", lambda x: (x["n_nationkey"] != F.col("home")) & F.contains("asked", x["words"]))
    return asked.select("conv_id", "turn", "home", S.words(said).alias("asked")).crossJoin(F.broadcast(names)).select("conv_id", "turn", F.explode(held).alias("n")).select("conv_id", "turn", "n.n_name")


@query("unique_sorted", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS tokens FROM part")
def unique_sorted(spark, d):
    return A.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.split("p_name", " "))), " ").alias("tokens"))


@query("parity_check", f"SELECT count(*) AS differing FROM ((SELECT doc_id, lang FROM documents EXCEPT ALL SELECT doc_id, 'en' FROM labels) UNION ALL (SELECT doc_id, 'en' FROM labels EXCEPT ALL SELECT doc_id, lang FROM documents))")
def parity(spark, d):
    a, b = A.table(spark, d, "documents").select("doc_id", "lang"), A.table(spark, d, "labels").select("doc_id", F.lit("en").alias("lang"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differing"))


@query("union_model", f"{FACTS} SELECT semantic_type AS kind, count(*) AS n FROM facts GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1")
def union_model(spark, d):
    return A.facts(spark, d).select(F.col("semantic_type").alias("kind")).unionByName(A.changes(spark, d).select(F.col("field").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("stable_errors", "SELECT 'duplicate' AS code, CAST(l_orderkey AS VARCHAR) AS path FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION SELECT 'no_lines', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def stable_errors(spark, d):
    lines = A.table(spark, d, "lineitem")
    twice = lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.lit("duplicate").alias("code"), F.col("l_orderkey").cast("string").alias("path"))
    none = A.table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("no_lines").alias("code"), F.col("o_orderkey").cast("string").alias("path"))
    return twice.unionByName(none).distinct()
