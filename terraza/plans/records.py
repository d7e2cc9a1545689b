"""Queries on facts and evidence records: their compatibility, validity, standing, and what they are joined to."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import checks as C
from terraza.operators import ordered as O
from terraza.registry import query
from terraza.sources import adapter as A
from terraza.sources import model as M

_same = "a.semantic_type IS NOT DISTINCT FROM b.semantic_type AND a.unit IS NOT DISTINCT FROM b.unit AND a.currency IS NOT DISTINCT FROM b.currency AND (a.semantic_type NOT IN ('price', 'price_per_m2') OR coalesce(a.price_type = b.price_type, false))"


@query("semantic_compatibility", f"{M.sql('facts')} SELECT a.fact_id AS left_id, b.fact_id AS right_id, {_same} AS compatible FROM facts a JOIN facts b ON b.observation_id = a.observation_id AND b.line = a.line + 1")
def semantic_compatibility(spark, d):
    own = M.read(spark, d, "facts").select("observation_id", "line", "fact_id", "semantic_type", "unit", "currency", "price_type")
    whole = F.struct("fact_id", "semantic_type", "unit", "currency", "price_type")
    a, b = own.select("observation_id", (F.col("line") + 1).alias("line"), whole.alias("a")), own.select("observation_id", "line", whole.alias("b"))
    return a.join(b, ["observation_id", "line"]).select(F.col("a.fact_id").alias("left_id"), F.col("b.fact_id").alias("right_id"), C.compatible("a", "b").alias("compatible"))


_ppm = "semantic_type = 'price_per_m2' AND normalized_value > 0 AND unit = 'PEN/m2' AND currency = 'PEN' AND price_type = 'from' AND denominator_area_type = 'total' AND value_kind = 'derived' AND length(trim(formula)) > 0 AND digits = 2"
PRICE_FACTS = {
    "eligible_price": f"{_ppm} AND quality_status = 'certified' AND benchmark_eligible", "orientative_price": f"{_ppm} AND quality_status = 'reviewable' AND NOT benchmark_eligible",
    "published_price": "semantic_type = 'price' AND normalized_value > 0 AND unit = 'PEN' AND currency = 'PEN' AND price_type = 'from' AND value_kind = 'observed' AND quality_status = 'certified' AND benchmark_eligible",
    "total_area": "semantic_type = 'area' AND normalized_value > 0 AND unit = 'm2' AND area_type = 'total' AND value_kind = 'observed' AND quality_status = 'certified' AND benchmark_eligible",
}


@query("valid_price_facts", f"{M.sql('facts')} SELECT fact_id, {', '.join(f'coalesce({e}, false) AS {c}' for c, e in PRICE_FACTS.items())} FROM facts")
def valid_price_facts(spark, d):
    return M.read(spark, d, "facts").select("fact_id", *(F.coalesce(F.expr(e), F.lit(False)).alias(c) for c, e in PRICE_FACTS.items()))


@query("evidence_public", f"""{M.sql('facts', 'records')}, e AS (SELECT f.observation_id, bool_and(coalesce(r.publish_permission = 'authorized' AND r.availability = 'available', false)) AS public FROM (SELECT DISTINCT observation_id, source_id FROM facts) f LEFT JOIN records r ON r.evidence_id = f.source_id GROUP BY 1)
SELECT o_orderkey AS observation_id, coalesce(public, true) AS public FROM orders LEFT JOIN e ON e.observation_id = o_orderkey""")
def evidence_public(spark, d):
    links = M.read(spark, d, "facts").select("observation_id", F.col("source_id").alias("evidence_id")).distinct()
    records = M.read(spark, d, "records").select("evidence_id", ((F.col("publish_permission") == "authorized") & (F.col("availability") == "available")).alias("open"))
    public = links.join(records, "evidence_id", "left").groupBy("observation_id").agg(F.bool_and(F.coalesce("open", F.lit(False))).alias("public"))
    return M.read(spark, d, "observations").select("observation_id").join(public, "observation_id", "left").select("observation_id", F.coalesce("public", F.lit(True)).alias("public"))


# Words of a field's name that put its fact into a row, in order of precedence.
ROWS = (("area", ("area",)), ("floor_unit", ("floor", "piso", "unit", "unidad", "department", "departamento")), ("bedrooms", ("bedroom", "dormitorio", "habitacion")), ("bathrooms", ("bathroom", "bano", "toilet")), ("model", ("model", "typology", "tipologia")))
ROW_KEYS = ("area", "floor_unit", "bedrooms", "bathrooms", "model", "other")
ROW_KEY = "CASE WHEN semantic_type = 'area' THEN 'area' " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(field_name), '{w}')''' for w in words)} THEN '{key}'" for key, words in ROWS) + " ELSE 'other' END"


@query("row_key_for_fact", f"{M.sql('facts')} SELECT fact_id, {ROW_KEY} AS row_key FROM facts")
def row_key(spark, d):
    return M.read(spark, d, "facts").select("fact_id", F.expr(ROW_KEY).alias("row_key"))


@query("agg_compatibility_rows", f"""{M.sql('facts', 'issues')}, own AS (SELECT source_id, {ROW_KEY} AS row_key, f.observation_id, f.quality_status, i.issue_id, i.benchmark_blocking, f.quality_status = 'certified' AND f.benchmark_eligible AND NOT coalesce(i.benchmark_blocking, false) AS eligible, f.quality_status AS status, CASE WHEN i.benchmark_blocking THEN i.quality_status END AS issue_status FROM facts f LEFT JOIN issues i ON i.project_id = f.project_id),
spine AS (SELECT s_suppkey AS source_id, unnest(['{"', '".join(ROW_KEYS)}']) AS row_key FROM supplier)
SELECT s.source_id, s.row_key, count(o.status) AS facts, count(DISTINCT o.observation_id) AS observations, count(DISTINCT o.issue_id) AS issues, CASE WHEN bool_or(o.status = 'conflict' OR issue_status = 'conflict') THEN 'conflict' WHEN bool_or(o.status = 'reviewable' OR issue_status = 'reviewable') THEN 'reviewable' WHEN count(o.status) = 0 THEN 'insufficient' ELSE 'certified' END AS status,
coalesce(bool_or(o.benchmark_blocking), false) AS blocking, count(*) FILTER (o.eligible) AS eligible, count(*) FILTER (NOT o.eligible) AS excluded FROM spine s LEFT JOIN own o ON o.source_id = s.source_id AND o.row_key = s.row_key GROUP BY 1, 2""")
def compatibility_rows(spark, d):
    issues = M.read(spark, d, "issues").select("project_id", "issue_id", "benchmark_blocking", F.col("quality_status").alias("issue_status"))
    own = M.read(spark, d, "facts").join(issues, "project_id", "left").withColumn("row_key", F.expr(ROW_KEY))
    blocked = F.coalesce("benchmark_blocking", F.lit(False))
    eligible = (F.col("quality_status") == "certified") & F.col("benchmark_eligible") & ~blocked
    either = lambda x: (F.col("quality_status") == x) | F.coalesce(blocked & (F.col("issue_status") == x), F.lit(False))
    status = F.when(F.bool_or(either("conflict")), "conflict").when(F.bool_or(either("reviewable")), "reviewable").otherwise("certified")
    rows = own.groupBy("source_id", "row_key").agg(
        F.count("*").alias("facts"), F.countDistinct("observation_id").alias("observations"), F.countDistinct("issue_id").alias("issues"), status.alias("status"), F.bool_or(blocked).alias("blocking"), F.count_if(eligible).alias("eligible"), F.count_if(~eligible).alias("excluded")
    )
    spine = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.explode(F.array(*map(F.lit, ROW_KEYS))).alias("row_key"))
    return spine.join(rows, ["source_id", "row_key"], "left").fillna(0, ["facts", "observations", "issues", "eligible", "excluded"]).fillna("insufficient", ["status"]).fillna(False, ["blocking"])


_reference = "CASE line % 3 WHEN 0 THEN concat('project:', project_id) WHEN 1 THEN concat('typology:', observation_id) ELSE concat('fact:', fact_id - 1) END"


@query("join_fact_to_project", f"""{M.sql('facts')}, own AS (SELECT fact_id, project_id, {_reference} AS entity_id FROM facts), typologies AS (SELECT concat('typology:', o_orderkey) AS id, concat('project:', o_custkey) AS project FROM orders WHERE o_orderkey % 5 > 0),
first AS (SELECT o.fact_id, o.entity_id, CASE WHEN o.entity_id LIKE 'project:%' THEN o.entity_id ELSE t.project END AS direct FROM own o LEFT JOIN typologies t ON t.id = o.entity_id), named AS (SELECT fact_id, min(direct) AS direct FROM first GROUP BY 1)
SELECT DISTINCT f.fact_id, f.entity_id, coalesce(f.direct, p.direct) AS project FROM first f LEFT JOIN named p ON concat('fact:', p.fact_id) = f.entity_id""")
def fact_to_project(spark, d):
    own = M.read(spark, d, "facts").select("fact_id", F.expr(_reference).alias("entity_id"))
    typologies = A.table(spark, d, "orders").where("o_orderkey % 5 > 0").select(F.concat(F.lit("typology:"), F.col("o_orderkey")).alias("entity_id"), F.concat(F.lit("project:"), F.col("o_custkey")).alias("project"))
    first = own.join(typologies, "entity_id", "left").select("fact_id", "entity_id", F.when(F.startswith("entity_id", F.lit("project:")), F.col("entity_id")).otherwise(F.col("project")).alias("direct"))
    named = first.groupBy(F.concat(F.lit("fact:"), F.col("fact_id")).alias("entity_id")).agg(F.min("direct").alias("second"))
    return first.join(named, "entity_id", "left").select("fact_id", "entity_id", F.coalesce("direct", "second").alias("project")).distinct()


@query("join_history_event", f"""WITH {A.CHANGES_SQL}, {A.EVIDENCE_SQL}, lagged AS (SELECT event_id, entity_id, field, ts, lag(event_id) OVER (PARTITION BY entity_id, field ORDER BY ts, event_id) AS previous_id FROM changes)
SELECT event_id, previous_id, s_name AS project, e.permission AS evidence, p.permission AS previous_evidence, coalesce(e.permission = 'authorized' AND p.permission = 'authorized', false) AS documented FROM lagged LEFT JOIN supplier ON s_suppkey = entity_id LEFT JOIN evidence e ON e.doc_id = event_id LEFT JOIN evidence p ON p.doc_id = previous_id WHERE previous_id IS NOT NULL""")
def history_event(spark, d):
    own = O.lagged(A.changes(spark, d).select("event_id", "entity_id", "field", "ts"), ["entity_id", "field"], ["ts", "event_id"], previous_id="event_id").where("previous_id is not null").select("event_id", "entity_id", "previous_id")
    evidence, names = A.evidence(spark, d).select("doc_id", "permission"), A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("project"))
    role = lambda id_, name: evidence.select(F.col("doc_id").alias(id_), F.col("permission").alias(name))
    own = own.join(names, "entity_id", "left").join(role("event_id", "evidence"), "event_id", "left").join(role("previous_id", "previous_evidence"), "previous_id", "left")
    documented = F.coalesce((F.col("evidence") == "authorized") & (F.col("previous_evidence") == "authorized"), F.lit(False))
    return own.select("event_id", "previous_id", "project", "evidence", "previous_evidence", documented.alias("documented"))


_why = "CASE WHEN quality_status = 'conflict' THEN 'conflicting_observations' WHEN price_type <> 'from' THEN 'price_type' WHEN currency = 'USD' THEN 'currency' WHEN denominator_area_type = 'built' OR area_type = 'built' THEN 'area_denominator' WHEN NOT benchmark_eligible THEN 'outside_method' END"
_state = f"CASE WHEN normalized_value IS NULL THEN 'missing' WHEN ({_why}) IS NULL THEN 'used' ELSE 'excluded' END"


@query("eligibility_projection", f"{M.sql('facts')} SELECT fact_id, observation_id, {_state} AS status, {_why} AS reason FROM facts")
def eligibility_projection(spark, d):
    return M.read(spark, d, "facts").selectExpr("fact_id", "observation_id", f"{_state} AS status", f"{_why} AS reason")


VALUE_CELL = "CASE WHEN fact_id IS NULL THEN 'unknown' WHEN NOT benchmark_eligible THEN 'excluded' WHEN value_kind = 'derived' THEN 'derived' WHEN value_kind = 'simulated' THEN 'simulated' WHEN semantic_type = 'attribute' THEN 'announced' ELSE 'observed' END"


@query("value_cell", f"{M.sql('facts')} SELECT p_partkey, concat_ws(':', 'fact', fact_id) AS fact, {VALUE_CELL} AS state FROM part LEFT JOIN facts ON project_id = p_partkey AND line = 2")
def value_cell(spark, d):
    facts = M.read(spark, d, "facts").where("line = 2").withColumnRenamed("project_id", "p_partkey")
    return A.table(spark, d, "part").select("p_partkey").join(facts, "p_partkey", "left").select("p_partkey", F.concat_ws(":", F.lit("fact"), F.col("fact_id").cast("string")).alias("fact"), F.expr(VALUE_CELL).alias("state"))


@query("qualitative_authorized", f"{M.sql('facts', 'records')} SELECT f.fact_id, f.project_id, f.field_name FROM facts f JOIN records r ON r.evidence_id = f.source_id WHERE f.semantic_type = 'attribute' AND f.quality_status = 'certified' AND r.publish_permission = 'authorized' AND r.availability = 'available'")
def qualitative_authorized(spark, d):
    records = M.read(spark, d, "records").where("publish_permission = 'authorized' AND availability = 'available'").select(F.col("evidence_id").alias("source_id"))
    return M.read(spark, d, "facts").where("semantic_type = 'attribute' AND quality_status = 'certified'").join(records, "source_id").select("fact_id", "project_id", "field_name")


@query("tier_evidence", f"{M.sql('facts')} SELECT source_id, fact_id, sha256(concat_ws('|', field_name, semantic_type, coalesce(unit, ''), printf('%.2f', normalized_value))) AS sha256, concat('fact:', fact_id) AS evidence_key FROM facts WHERE quality_status = 'certified'")
def tier_evidence(spark, d):
    text = F.concat_ws("|", "field_name", "semantic_type", F.coalesce("unit", F.lit("")), F.printf(F.lit("%.2f"), "normalized_value"))
    return M.read(spark, d, "facts").where("quality_status = 'certified'").select("source_id", "fact_id", F.sha2(text, 256).alias("sha256"), F.concat(F.lit("fact:"), F.col("fact_id")).alias("evidence_key"))


@query("agg_inspector_ledger", f"""{M.sql('facts')}, own AS (SELECT project_id, field_name, source_id, normalized_value, row_number() OVER (PARTITION BY project_id, field_name ORDER BY source_id, fact_id) AS nth FROM facts WHERE value_kind = 'observed')
SELECT project_id, field_name, count(*) AS observed, max(CASE WHEN nth = 1 THEN normalized_value END) AS first_value, max(CASE WHEN nth = 2 THEN normalized_value END) AS second_value, {S.half_up_sql('max(CASE WHEN nth = 2 THEN normalized_value END) - max(CASE WHEN nth = 1 THEN normalized_value END)', 2)} AS delta FROM own GROUP BY 1, 2""")
def inspector_ledger(spark, d):
    own = M.read(spark, d, "facts").where("value_kind = 'observed'")
    # The two least (source, fact) of a group, without a window over it.
    key = F.struct("source_id", "fact_id", "normalized_value")
    two = own.groupBy("project_id", "field_name").agg(F.count("*").alias("observed"), F.min(key).alias("a"))
    rest = own.join(two.select("project_id", "field_name", "a"), ["project_id", "field_name"]).where(key > F.col("a")).groupBy("project_id", "field_name").agg(F.min(key).alias("b"))
    out = two.join(rest, ["project_id", "field_name"], "left").select("project_id", "field_name", "observed", F.col("a.normalized_value").alias("first_value"), F.col("b.normalized_value").alias("second_value"))
    return out.withColumn("delta", S.half_up(F.col("second_value") - F.col("first_value"), 2))


@query("difference", f"{M.sql('facts')}, p AS (SELECT project_id, field_name, min(normalized_value) AS low, max(normalized_value) AS high FROM facts GROUP BY 1, 2), x AS (SELECT *, {S.half_up_sql('high - low', 2)} AS delta FROM p) SELECT project_id, field_name, delta, {S.half_up_sql(S.ratio_sql('delta * 100', 'low'), 2)} AS percent, CASE WHEN low = 0 THEN 'PERCENT_BASE_ZERO' END AS issue FROM x")
def difference(spark, d):
    own = M.read(spark, d, "facts").groupBy("project_id", "field_name").agg(F.min("normalized_value").alias("low"), F.max("normalized_value").alias("high")).withColumn("delta", S.half_up(F.col("high") - F.col("low"), 2))
    return own.select("project_id", "field_name", "delta", S.half_up(S.ratio(F.col("delta") * 100, F.col("low")), 2).alias("percent"), F.when(F.col("low") == 0, "PERCENT_BASE_ZERO").alias("issue"))


@query("union_fixture_records", f"{M.sql('facts')}, all_records AS (SELECT 'F' AS fixture, fact_id FROM facts WHERE value_kind = 'observed' UNION ALL SELECT 'O', fact_id FROM facts WHERE value_kind <> 'observed') SELECT fact_id, count(*) AS n, count(DISTINCT fixture) AS fixtures, count(*) > 1 AS repeated FROM all_records GROUP BY 1")
def union_fixtures(spark, d):
    own = M.read(spark, d, "facts")
    parts = [own.where(w).select(F.lit(k).alias("fixture"), "fact_id") for k, w in (("F", "value_kind = 'observed'"), ("O", "value_kind <> 'observed'"))]
    return C.union(parts).groupBy("fact_id").agg(F.count("*").alias("n"), F.countDistinct("fixture").alias("fixtures")).withColumn("repeated", F.col("n") > 1)


@query("reference_dedupe", f"{M.sql('facts')} SELECT observation_id, source_id, position FROM (SELECT observation_id, source_id, min(line) AS position FROM facts GROUP BY 1, 2)")
def reference_dedupe(spark, d):
    return M.read(spark, d, "facts").groupBy("observation_id", "source_id").agg(F.min("line").alias("position"))


# Reasons for which a value stays out, in order of precedence.
PRECEDENCE = ("restricted", "conflicting_observations", "currency", "area_denominator", "cutoff", "missing")
_each = {"conflicting_observations": "quality_status = 'conflict'", "area_denominator": "denominator_area_type = 'built'", "currency": "currency = 'USD'", "cutoff": "captured_at > TIMESTAMP '2000-01-01 00:00:00'", "zz_other": "digits = 1"}
_list = f"list_filter([{', '.join(f'''CASE WHEN {c} THEN '{k}' END''' for k, c in _each.items())}], lambda r: r IS NOT NULL)"
_ranked = "list_concat(list_filter(['" + "', '".join(PRECEDENCE) + "'], lambda r: list_contains(codes, r)), list_sort(list_filter(codes, lambda r: NOT list_contains(['" + "', '".join(PRECEDENCE) + "'], r))))"


def ordered(codes, precedence):
    """Distinct codes in order of precedence, unknown ones after them by name."""
    known = F.array(*map(F.lit, precedence))
    return F.concat(F.filter(known, lambda r: F.array_contains(codes, r)), F.array_sort(F.array_except(codes, known)))


@query("ordered_reasons", f"{M.sql('facts')}, own AS (SELECT fact_id, {_list} AS codes FROM facts) SELECT fact_id, array_to_string({_ranked}, ',') AS reasons FROM own WHERE len(codes) > 0")
def ordered_reasons(spark, d):
    codes = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in _each.items())))
    return M.read(spark, d, "facts").select("fact_id", codes.alias("codes")).where(F.size("codes") > 0).select("fact_id", F.array_join(ordered(F.col("codes"), PRECEDENCE), ",").alias("reasons"))


@query("array_ordered_subset", f"{M.sql('facts')}, own AS (SELECT observation_id, list(DISTINCT quality_status) AS codes FROM facts GROUP BY 1) SELECT observation_id, array_to_string(list_filter(['certified', 'reviewable', 'conflict'], lambda r: list_contains(codes, r)), ',') AS states FROM own")
def ordered_subset(spark, d):
    own = M.read(spark, d, "facts").groupBy("observation_id").agg(F.collect_set("quality_status").alias("codes"))  # at most three values
    return own.select("observation_id", F.array_join(F.filter(F.array(*map(F.lit, ("certified", "reviewable", "conflict"))), lambda r: F.array_contains("codes", r)), ",").alias("states"))


@query("array_unique_sorted", f"{M.sql('facts')} SELECT observation_id, array_to_string(list_sort(list(DISTINCT field_name)), ',') AS fields FROM facts GROUP BY 1")
def unique_sorted(spark, d):
    return M.read(spark, d, "facts").groupBy("observation_id").agg(F.array_join(F.array_sort(F.collect_set("field_name")), ",").alias("fields"))  # at most seven names


@query("token_extract", """WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS original, unnest(range(len(string_split(p_name, ' ')))) AS position FROM part), k AS (SELECT p_partkey, concat('attribute:', lower(original)) AS attribute_id, original, position FROM t WHERE original <> '')
SELECT p_partkey, attribute_id, arg_min(original, position) AS original, min(position) AS position FROM k GROUP BY 1, 2""")
def token_extract(spark, d):
    own = A.table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("position", "original")).where("original <> ''").withColumn("position", F.col("position").cast("long"))
    return own.groupBy("p_partkey", F.concat(F.lit("attribute:"), F.lower("original")).alias("attribute_id")).agg(F.min_by("original", "position").alias("original"), F.min("position").alias("position"))
