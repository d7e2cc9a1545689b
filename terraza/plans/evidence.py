"""Queries on evidence, references and ledgers."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import checks as K
from terraza.operators import evidence as E
from terraza.registry import query
from terraza.sources import adapter as A

WITH = f"WITH {A.EVIDENCE_SQL}"
FACTS = f"WITH {A.FACTS_SQL}"
LISTINGS = f"WITH {A.LISTINGS_SQL}"


@query("check_privacy", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS code FROM documents WHERE regexp_matches(text, '{p}')" for k, p in E.PATTERNS.items()))
def check_privacy(spark, d):
    return E.privacy(A.table(spark, d, "documents"))


@query("public_text", f"{WITH} SELECT doc_id, permission, CASE WHEN permission = 'authorized' AND NOT ({' OR '.join(f"regexp_matches(text, '{p}')" for p in E.PATTERNS.values())}) THEN sha256(text) END AS sha256 FROM evidence")
def public_text(spark, d):
    return E.public_text(A.evidence(spark, d))


@query("evidence_presentation", f"{WITH} SELECT doc_id, CASE WHEN permission = 'authorized' THEN CASE WHEN n_chars <= 300 THEN 'fragment' ELSE 'transcription' END ELSE permission END AS presentation FROM evidence")
def presentation(spark, d):
    return E.presentation(A.evidence(spark, d))


@query("evidence_assessment", f"{WITH} SELECT source, ['restricted', 'unavailable', 'pending', 'available'][min(CASE permission WHEN 'restricted' THEN 1 WHEN 'unavailable' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END)] AS assessment, count(*) AS n, bool_and(permission = 'authorized') AS public FROM evidence GROUP BY 1")
def assessment(spark, d):
    return E.assessment(A.evidence(spark, d))


@query("fingerprint_inputs", r"SELECT doc_id, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS sha256 FROM documents")
def fingerprint(spark, d):
    return E.fingerprint(A.table(spark, d, "documents"))


@query("field_coverage_by_source", "SELECT source, count(*) AS n, count(lang) AS with_lang, count(*) FILTER (n_chars > 500) AS long FROM documents GROUP BY 1")
def field_coverage(spark, d):
    return A.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count_if(F.col("n_chars") > 500).alias("long"))


@query("check_references", f"""SELECT 'orders' AS collection, o_orderkey AS id, 'NO_LINES' AS code FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'labels', doc_id, 'NO_DOCUMENT' FROM labels WHERE doc_id NOT IN (SELECT doc_id + 1 FROM documents WHERE doc_id % 3 > 0)
UNION ALL SELECT 'supplier', s_suppkey, 'ALIAS_UNRESOLVED' FROM supplier WHERE {S.words_sql("replace(s_name, 'Supplier', 'Customer')")} NOT IN (SELECT {S.words_sql('c_name')} FROM customer WHERE c_custkey % 4 > 0)""")
def check_references(spark, d):
    """Rows whose other end is missing, and names that no alias resolves."""
    orders = E.missing_references(A.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id"), "id", A.table(spark, d, "lineitem"), "l_orderkey").select(F.lit("orders").alias("collection"), "id", F.lit("NO_LINES").alias("code"))
    known = A.table(spark, d, "documents").where("doc_id % 3 > 0").select((F.col("doc_id") + 1).alias("id"))
    labels = A.table(spark, d, "labels").select(F.col("doc_id").alias("id")).join(known, "id", "left_anti").select(F.lit("labels").alias("collection"), "id", F.lit("NO_DOCUMENT").alias("code"))
    aliases = A.table(spark, d, "customer").where("c_custkey % 4 > 0").select(S.words("c_name").alias("alias"))
    names = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), S.words(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("alias"))
    return orders.unionByName(labels).unionByName(names.join(aliases, "alias", "left_anti").select(F.lit("supplier").alias("collection"), "id", F.lit("ALIAS_UNRESOLVED").alias("code")))


@query("check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_unique(spark, d):
    return A.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("dedupe_first", "SELECT l_orderkey, l_linenumber, l_partkey, copies FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS nth FROM lineitem) WHERE nth = 1")
def dedupe_first(spark, d):
    return E.dedupe_first(A.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "copies")


@query("partition_ledger", f"{LISTINGS} SELECT listing_id, CASE WHEN ppm IS NULL THEN 'missing' WHEN currency = 'PEN' THEN 'used' ELSE 'excluded' END AS bucket FROM listings")
def partition_ledger(spark, d):
    return E.ledger(A.listings(spark, d, "listing_id", "currency", "ppm"), F.col("currency") == "PEN", F.col("ppm").isNull())


@query("values_differ", f'{FACTS} SELECT listing_id, semantic_type, count(DISTINCT value) AS "values", count(*) AS n FROM facts GROUP BY 1, 2 HAVING count(DISTINCT value) > 1')
def values_differ(spark, d):
    return E.values_differ(A.facts(spark, d))


RANGES = {"SHIPPED_BEFORE_ORDER": "l_shipdate < o_orderdate", "PRICE_ABOVE_TOTAL": "l_extendedprice > o_totalprice", "DISCOUNT_ABOVE_TAX": "l_discount > 0.095 AND l_tax < 0.005"}


@query("check_ranges", f"WITH own AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax, o_orderdate, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey) {K.broken_sql('l_orderkey, l_linenumber, l_suppkey', 'own', **RANGES)}")
def check_ranges(spark, d):
    own = A.table(spark, d, "lineitem").join(A.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    codes = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(k)) for k, c in RANGES.items())))
    return own.select("l_orderkey", "l_linenumber", "l_suppkey", F.explode(codes).alias("code"))


@query("semi_join_comparable", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join(spark, d):
    return A.table(spark, d, "customer").join(A.table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("scope_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def scope_difference(spark, d):
    return A.table(spark, d, "documents").select("doc_id").join(A.table(spark, d, "labels"), "doc_id", "left_anti").distinct()


@query("intersect_scope", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def intersect_scope(spark, d):
    return A.table(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(A.table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("merge_supplemental", """SELECT coalesce(a.p_partkey, b.l_partkey) AS part_id, CASE WHEN a.p_partkey IS NULL THEN 'supplement' WHEN b.l_partkey IS NULL THEN 'base' WHEN a.p_size IS NOT DISTINCT FROM b.size THEN 'same' ELSE 'conflict' END AS state
FROM part a FULL JOIN (SELECT l_partkey, CAST(max(l_quantity) AS INTEGER) AS size FROM lineitem GROUP BY 1) b ON a.p_partkey = b.l_partkey""")
def merge_supplemental(spark, d):
    more = A.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(F.max("l_quantity").cast("int").alias("p_size"))
    return E.merge_supplement(A.table(spark, d, "part").withColumnRenamed("p_partkey", "part_id"), more, "part_id", "p_size")
