"""Queries on who is who: registry, merged projects, exact matches and what contradicts them."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import identity as I
from terraza.registry import query
from terraza.sources import adapter as A

#: Names on a domain: every supplier has two sites, some shared with the next supplier; suppliers of 20 run in pairs or chains that are one agency.
_sites = "unnest([concat('site', s_suppkey, '.pe'), CASE WHEN s_suppkey % 5 = 0 THEN concat('site', s_suppkey + 1, '.pe') WHEN s_suppkey % 7 = 0 THEN 'portal.pe' END])"
_pairs = "SELECT s_suppkey, s_suppkey + 1 AS next FROM supplier WHERE s_suppkey % 20 IN (5, 6, 10) AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)"


@query("agency_registry", f"""WITH RECURSIVE own AS (SELECT DISTINCT s_name AS source_name, {S.words_sql('s_name')} AS normalized, domain FROM (SELECT s_name, {_sites} AS domain, unnest([1, 2]) AS nth FROM supplier) WHERE nth = 1 OR domain IS NOT NULL),
pairs AS ({_pairs}), edges AS (SELECT {S.words_sql('a.s_name')} AS a, {S.words_sql('b.s_name')} AS b FROM pairs p JOIN supplier a ON a.s_suppkey = p.s_suppkey JOIN supplier b ON b.s_suppkey = p.next), linked AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b), first AS (SELECT a AS normalized, least(a, min(b)) AS agency FROM reach GROUP BY a), named AS (SELECT o.*, coalesce(agency, o.normalized) AS agency FROM own o LEFT JOIN first f ON f.normalized = o.normalized),
shared AS (SELECT domain FROM named WHERE domain IS NOT NULL GROUP BY 1 HAVING count(DISTINCT agency) > 1), review AS (SELECT DISTINCT normalized FROM named WHERE domain IN (FROM shared))
SELECT source_name, normalized, domain, CASE WHEN normalized NOT IN (FROM review) THEN concat('agency:', replace(agency, ' ', '-')) END AS agency_id, CASE WHEN normalized IN (FROM review) THEN 'manual_review' ELSE 'resolved' END AS resolution FROM named""")
def agency_registry(spark, d):
    own = A.table(spark, d, "supplier")
    shared = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("site"), F.col("s_suppkey") + 1, F.lit(".pe"))).when(F.col("s_suppkey") % 7 == 0, "portal.pe")
    names = own.select("s_name", F.explode(F.array_compact(F.array(F.concat(F.lit("site"), F.col("s_suppkey"), F.lit(".pe")), shared))).alias("domain"))
    ids = own.select("s_suppkey", F.col("s_name").alias("a"))
    pairs = ids.where("s_suppkey % 20 IN (5, 6, 10)").withColumn("next", F.col("s_suppkey") + 1).join(own.select(F.col("s_suppkey").alias("next"), F.col("s_name").alias("b")), "next").select("a", "b")
    return I.registry(names, "s_name", "domain", pairs)


_listed = ("concat('project:', p_partkey) AS project_id", "CASE WHEN p_partkey % 17 > 0 THEN concat('agency:', p_size % 9) END AS agency_id", "p_name AS name", "'listed' AS status")
_controlled = ("concat('project:', CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_partkey + 1000000 END) AS project_id", "'agency:0' AS agency_id", "concat('fixture ', l_orderkey) AS name", "'controlled' AS status", "CASE WHEN l_partkey % 3 = 0 THEN 'CT-G' ELSE 'CT-A' END AS case_id")
_merged = f"""WITH a AS (SELECT {', '.join(_listed)} FROM part), c AS (SELECT {', '.join(_controlled)} FROM lineitem WHERE l_quantity > 49), b AS (SELECT project_id, count(*) AS times, min(agency_id) AS agency_id, min(name) AS name, min(status) AS status, min(case_id) AS case_id FROM c GROUP BY 1),
m AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.agency_id, b.agency_id) AS agency_id, coalesce(a.name, b.name) AS name, CASE WHEN coalesce(case_id = 'CT-G' AND times = 1, false) THEN b.status ELSE coalesce(a.status, b.status) END AS status,
CASE WHEN times IS NULL THEN CASE WHEN a.agency_id IS NULL THEN 'unresolved' ELSE 'listed' END WHEN times > 1 THEN 'collision' WHEN a.name IS NULL THEN 'controlled' WHEN case_id = 'CT-G' THEN 'merged' ELSE 'collision' END AS origin FROM a FULL JOIN b ON b.project_id = a.project_id)"""


@query("authoritative_projects", f"{_merged} SELECT * FROM m")
def authoritative_projects(spark, d):
    return I.merged_projects(A.table(spark, d, "part").selectExpr(*_listed), A.table(spark, d, "lineitem").where("l_quantity > 49").selectExpr(*_controlled), ("CT-G",))


_matching = ("l_orderkey * 10 + l_linenumber AS match_id", "CASE WHEN l_partkey % 31 > 0 THEN l_partkey % 3 END AS agency_id", "CASE l_returnflag WHEN 'A' THEN 'match_high' WHEN 'R' THEN 'match_medium' ELSE 'none' END AS match_class", "l_partkey AS left_key", "l_orderkey AS right_key", "l_discount < 0.095 AS confirmed", "l_tax > 0.075 AS review")
_left = ("CASE WHEN p_partkey % 23 = 1 THEN p_partkey - 1 ELSE p_partkey END AS key", "p_partkey % 3 AS agency_id")
_right = ("CASE WHEN o_orderkey % 19 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS key", "o_orderkey % 3 AS agency_id")
_side = lambda n: f"(SELECT key, count(*) AS {n}_times, min(agency_id) AS {n}_agency FROM {n}_rows GROUP BY 1)"
_once = lambda n: f"coalesce({n}_times, 0) = 1"
_differs = lambda n: f"agency_id IS NOT NULL AND {_once('left')} AND {_once('right')} AND {n}_agency IS DISTINCT FROM agency_id"
_against = S.reasons_sql(
    MATCH_AGENCY_UNRESOLVED="agency_id IS NULL", MATCHED_ON_AGENCY_NOT_TRUE="NOT confirmed", LEFT_JOIN_COUNT=f"NOT ({_once('left')})", RIGHT_JOIN_COUNT=f"NOT ({_once('right')})", HIGH_REQUIRES_HUMAN_REVIEW="match_class = 'match_high' AND review", LEFT_AGENCY_MISMATCH=_differs("left"), RIGHT_AGENCY_MISMATCH=_differs("right"),
)
_judged = f"WITH m AS (SELECT * FROM (SELECT {', '.join(_matching)} FROM lineitem) WHERE match_class <> 'none'), left_rows AS (SELECT {', '.join(_left)} FROM part), right_rows AS (SELECT {', '.join(_right)} FROM orders), judged AS (SELECT m.*, {_against} AS reasons FROM m LEFT JOIN {_side('left')} a ON a.key = left_key LEFT JOIN {_side('right')} b ON b.key = right_key)"


def judged(spark, d):
    matching = A.table(spark, d, "lineitem").selectExpr(*_matching).where("match_class <> 'none'")
    return I.exact_matches(matching, A.table(spark, d, "part").selectExpr(*_left), A.table(spark, d, "orders").selectExpr(*_right))


@query("join_exact_match", f"{_judged} SELECT agency_id, match_class, left_key, right_key, min(match_id) AS match_id FROM judged WHERE len(reasons) = 0 GROUP BY ALL")
def join_exact_match(spark, d):
    """Matches of three tables in which both sides hold the key just once and name the match's own agency."""
    return I.kept_matches(judged(spark, d))


@query("exact_match_contradictions", f"{_judged} SELECT match_id, array_to_string(reasons, ',') AS reasons FROM judged WHERE match_class = 'match_high' AND len(reasons) > 0")
def exact_match_contradictions(spark, d):
    return I.contradictions(judged(spark, d))
