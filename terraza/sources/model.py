"""Records of the evidence model, read from the star-schema tables by expressions that Spark and DuckDB share.

A line item is a fact, its order the observation, its part the project, its supplier the source; a labelled document is an
evidence record, and parts of certain sizes have issues. Every column is one SQL expression, so a query and its SQL see the
same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapter import table

_price = "l_returnflag <> 'N' AND l_quantity > 3"
_derived = "l_linestatus = 'O'"
FACTS = {
    "fact_id": "l_orderkey * 10 + l_linenumber",
    "observation_id": "l_orderkey",
    "project_id": "l_partkey",
    "source_id": "l_suppkey",
    "line": "l_linenumber",
    "field_name": "CASE l_linenumber WHEN 1 THEN 'area_total' WHEN 2 THEN 'piso' WHEN 3 THEN 'numero_dormitorios' WHEN 4 THEN 'bano_visita' WHEN 5 THEN 'modelo' WHEN 6 THEN 'precio' ELSE 'zona_comun' END",
    "semantic_type": "CASE WHEN l_quantity <= 3 THEN 'attribute' WHEN l_returnflag = 'A' THEN 'price' WHEN l_returnflag = 'N' THEN 'area' ELSE 'price_per_m2' END",
    "currency": f"CASE WHEN {_price} THEN CASE WHEN l_discount >= 0.095 THEN 'USD' ELSE 'PEN' END END",
    "unit": "CASE WHEN l_quantity <= 3 THEN 'flag' WHEN l_returnflag = 'A' THEN CASE WHEN l_tax >= 0.075 THEN 'EUR' WHEN l_discount >= 0.095 THEN 'USD' ELSE 'PEN' END WHEN l_returnflag = 'N' THEN 'm2' ELSE 'PEN/m2' END",
    "price_type": f"CASE WHEN {_price} THEN CASE WHEN l_tax < 0.065 THEN 'from' ELSE 'list' END END",
    "area_type": "CASE WHEN l_returnflag = 'N' AND l_quantity > 3 THEN CASE WHEN l_suppkey % 4 = 0 THEN 'built' ELSE 'total' END END",
    "denominator_area_type": "CASE WHEN l_returnflag = 'R' AND l_quantity > 3 THEN CASE WHEN l_suppkey % 5 = 0 THEN 'built' ELSE 'total' END END",
    "value_kind": f"CASE WHEN l_quantity > 47 THEN 'simulated' WHEN {_derived} THEN 'derived' ELSE 'observed' END",
    "quality_status": "CASE WHEN l_discount < 0.055 THEN 'certified' WHEN l_discount < 0.085 THEN 'reviewable' ELSE 'conflict' END",
    "benchmark_eligible": "l_tax < 0.045",
    "exclusion_reason": "CASE WHEN l_tax >= 0.055 THEN 'outside_method' END",
    "normalized_value": "CASE WHEN l_returnflag = 'N' OR l_quantity <= 3 THEN l_quantity ELSE l_extendedprice END",
    "formula": f"CASE WHEN {_derived} THEN 'price / area' END",
    "digits": "CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 2 END",
    "captured_at": "l_shipdate",
}
OBSERVATIONS = {
    "observation_id": "o_orderkey",
    "owner_id": "o_custkey",
    "evidence_status": "CASE o_orderstatus WHEN 'F' THEN 'available' WHEN 'O' THEN 'missing' ELSE 'pending' END",
    "absence_reason": "CASE WHEN o_orderpriority <> '5-LOW' THEN 'not_published' END",
    "currency": "CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE 'PEN' END",
    "price": "o_totalprice",
    "captured_at": "o_orderdate",
}
ISSUES = {
    "issue_id": "p_partkey",
    "project_id": "p_partkey",
    "benchmark_blocking": "p_size <= 2",
    "quality_status": "CASE WHEN p_size = 1 THEN 'conflict' ELSE 'reviewable' END",
    "issue_code": "CASE WHEN p_size = 1 THEN 'CONFLICT' WHEN p_size = 2 THEN 'PERCENT_BASE_ZERO' ELSE 'EXTREME_CHANGE_REVIEW' END",
}
RECORDS = {
    "evidence_id": "doc_id",
    "document_id": "doc_id",
    "publish_permission": "CASE WHEN quality = 1 THEN 'authorized' WHEN toxic = 1 THEN 'restricted' ELSE 'pending' END",
    "availability": "CASE WHEN toxic = 1 THEN 'unavailable' ELSE 'available' END",
    "has_fragment": "quality = 1 OR doc_id % 7 = 0",
}
DOCUMENTS = {
    "document_id": "doc_id",
    "source": "source",
    "publish_permission": "CASE WHEN lang IS NULL THEN 'pending' WHEN doc_id % 11 = 0 THEN 'restricted' ELSE 'authorized' END",
    "availability": "CASE WHEN n_chars > 40 THEN 'available' ELSE 'unavailable' END",
    "has_asset": "n_chars > 60",
}
TABLES = {"facts": ("lineitem", FACTS, ""), "observations": ("orders", OBSERVATIONS, ""), "issues": ("part", ISSUES, "p_size <= 3"), "records": ("labels", RECORDS, ""), "docs": ("documents", DOCUMENTS, "")}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One collection of the model."""
    source, columns, where = TABLES[name]
    df = table(spark, sf_dir, source)
    return (df.where(where) if where else df).select(*(F.expr(e).alias(c) for c, e in columns.items()))


def sql(*names: str) -> str:
    """WITH and the common table expressions of collections."""
    parts = []
    for name in names:
        source, columns, where = TABLES[name]
        parts.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}{f' WHERE {where}' if where else ''})")
    return "WITH " + ", ".join(parts)
