"""Queries on names, addresses and questions."""

from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators import text as T
from terraza.registry import query
from terraza.sources import adapter as A


@query("norm_domain", f"SELECT {T.domain_sql('url')} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def norm_domain(spark, d):
    return A.table(spark, d, "pages").groupBy(T.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query("norm_url", "SELECT page_id, lower(regexp_replace(trim(url), '/+$', '')) AS url_key FROM pages")
def norm_url(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.url_key(F.col("url")).alias("url_key"))


@query("safe_url", "SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i)https?://[^ ]+$') THEN trim(url) END AS url FROM pages")
def safe_url(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.safe_url(F.col("url")).alias("url"))


@query("norm_agency", f"SELECT s_suppkey, {S.words_sql('s_name')} AS name, {S.slug_sql('s_name')} AS slug FROM supplier")
def norm_agency(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", S.words("s_name").alias("name"), S.slug("s_name").alias("slug"))


@query("norm_clean", f"SELECT conv_id, turn, {S.clean_sql('text')} AS text FROM conversations")
def norm_clean(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", S.clean("text").alias("text"))


@query("short_text", "SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(left(text, 79), '…') ELSE text END AS short FROM documents")
def short_text(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 79), F.lit("…"))).otherwise(F.col("text")).alias("short"))


@query("hash_abbrev", "SELECT doc_id, concat(left(sha256(text), 8), '…') AS hash FROM documents")
def hash_abbrev(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.concat(F.substring(F.sha2("text", 256), 1, 8), F.lit("…")).alias("hash"))


@query("split_list", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS tokens FROM part")
def split_list(spark, d):
    return A.table(spark, d, "part").select("p_partkey", F.size(F.filter(F.split("p_name", " "), lambda x: x != "")).cast("long").alias("tokens"))


#: Questions of users: what people ask, in words of their own or those suggested, before the text of the turn.
ASKED = ("¿Cuál es la lectura principal del escenario activo?", "Dame un resumen del panorama", "¿Por qué bajó el precio?", "¿A qué precio de cierre se vendió?", "Busca en internet", "¿Qué cambió?", "Compara los proyectos", "¿Qué señal reviso primero?", "Pronóstico de demanda", "cobertura", "acabados y documentos", "")
_turns = "(conv_id * 5 + turn) % 12"
_question = f"concat(CASE {_turns} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ASKED))} END, CASE WHEN {_turns} > 5 THEN concat(' ', text) ELSE '' END)"
_explicit = "CASE WHEN conv_id % 19 = 3 THEN 'market-changes' WHEN conv_id % 19 = 4 THEN 'other' END"
_contract, _has_scenario = "conv_id % 23 > 0", "conv_id % 7 > 0"
_parts = T.classify_sql("q", "explicit")
_own = f"WITH turns AS (SELECT conv_id, turn, {_question} AS question, {_explicit} AS explicit, {_contract} AS contract, {_has_scenario} AS scenario FROM conversations WHERE role = 'user'), own AS (SELECT *, {T.normalised_sql('question')} AS q FROM turns)"


def questions(spark, d):
    """Users' questions, whole, with their normalised text and what they are found to ask for."""
    own = A.table(spark, d, "conversations").where("role = 'user'").selectExpr("conv_id", "turn", f"{_question} AS question", f"{_explicit} AS explicit", f"{_contract} AS contract", f"{_has_scenario} AS scenario")
    return own.withColumn("q", T.normalised(F.col("question"))).withColumn("found", T.classify(F.col("q"), F.col("explicit")))


@query("intent_classify", f"{_own} SELECT conv_id, turn, {', '.join(f'{e} AS {c}' for c, e in _parts.items())} FROM own")
def intent_classify(spark, d):
    return questions(spark, d).select("conv_id", "turn", "found.*")


@query("assistant_guard", f"""{_own}, c AS (SELECT *, {_parts['intent']} AS intent, {_parts['matched_by']} AS matched_by FROM own)
SELECT conv_id, turn, CASE WHEN NOT contract THEN 'contract_unavailable' WHEN q = '' OR length(question) > {T.STATUS_LIMIT} THEN 'invalid_input' WHEN matched_by = 'limitation' THEN 'refused' WHEN intent IS NULL THEN 'unknown_intent' WHEN NOT scenario THEN 'insufficient' ELSE 'ready' END AS status FROM c""")
def assistant_guard(spark, d):
    return questions(spark, d).select("conv_id", "turn", T.guard(F.col("question"), F.col("q"), F.col("found"), F.col("contract"), F.col("scenario")).alias("status"))


for _f, _name in ((S.half_up, "half_up"), (S.round_js, "round_js"), (S.round_away, "round_away")):
    _sql = getattr(S, f"{_name}_sql")
    query(_name, f"SELECT s_suppkey, {_sql('s_acctbal', 1)} AS tenth, {_sql('s_acctbal / 7e0', 2)} AS seventh FROM supplier")(
        lambda spark, d, f=_f: A.table(spark, d, "supplier").select("s_suppkey", f("s_acctbal", 1).alias("tenth"), f(F.col("s_acctbal") / 7, 2).alias("seventh"))
    )
