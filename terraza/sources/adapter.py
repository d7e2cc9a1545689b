"""Market entities read from the star-schema tables, as DataFrames and as the same CTEs in DuckDB SQL.

An order is a published listing: its line items give area (summed quantity) and units, its customer the agency and district,
its least part the typology. Orders without line items have no area, units or typology. Events are observations of a user's
value over time; documents with their labels are evidence with a publish permission.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Listing columns and the tables beside orders that each needs.
LISTING = {
    "listing_id": "", "agency": "customer", "segment": "customer", "district_id": "customer", "district": "customer nation", "typology": "lineitem part", "amenities": "lineitem part", "price": "", "area": "lineitem", "units": "lineitem", "phase": "",
    "captured_at": "", "currency": "", "bedrooms_min": "lineitem part", "bedrooms_max": "lineitem part", "delivery_year": "lineitem", "lat": "", "lon": "", "ppm": "lineitem",
}


def listings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns asked for, or all; only the tables that they need are read and joined."""
    columns = columns or tuple(LISTING)
    needed = {t for c in columns for t in LISTING[c].split()}
    key = F.col("o_orderkey")
    out = table(spark, sf_dir, "orders").select(
        key.alias("listing_id"), F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("phase"), F.col("o_orderdate").alias("captured_at"),
        F.when(F.col("o_orderpriority") == "5-LOW", "unknown").otherwise("PEN").alias("currency"), (-12.2 + (key * 37 % 1000) / 1e4).alias("lat"), (-77.1 + (key * 91 % 1000) / 1e4).alias("lon"),
    )
    if "lineitem" in needed:
        lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("listing_id")).agg(
            F.sum("l_quantity").alias("area"), F.count("*").alias("units"), F.min("l_partkey").alias("partkey"), F.year(F.max("l_shipdate")).alias("delivery_year")
        )
        out = out.join(lines, "listing_id", "left").withColumn("ppm", F.try_divide(F.col("price"), F.col("area")))
    if "customer" in needed:
        agency = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("agency"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("district_id"))
        out = out.join(agency, "custkey", "left")
    if "nation" in needed:
        district = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("district"))
        out = out.join(district, "district_id", "left")
    if "part" in needed:
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_type").alias("typology"), F.col("p_name").alias("amenities"), (F.col("p_size") % 4).cast("int").alias("bedrooms_min"))
        out = out.join(part, "partkey", "left").withColumn("bedrooms_max", F.col("bedrooms_min") + 1)
    return out.select(*columns)


LISTINGS_SQL = """lines AS (
  SELECT l_orderkey AS listing_id, sum(l_quantity) AS area, count(*) AS units, min(l_partkey) AS partkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1
), listings AS (
  SELECT o.o_orderkey AS listing_id, c.c_name AS agency, c.c_mktsegment AS segment, c.c_nationkey AS district_id, n.n_name AS district, p.p_type AS typology, p.p_name AS amenities,
    o.o_totalprice AS price, l.area, l.units, o.o_orderstatus AS phase, o.o_orderdate AS captured_at, CASE WHEN o.o_orderpriority = '5-LOW' THEN 'unknown' ELSE 'PEN' END AS currency,
    CAST(p.p_size % 4 AS INTEGER) AS bedrooms_min, CAST(p.p_size % 4 AS INTEGER) + 1 AS bedrooms_max, CAST(year(l.last_ship) AS INTEGER) AS delivery_year,
    -12.2e0 + (o.o_orderkey * 37 % 1000) / 1e4 AS lat, -77.1e0 + (o.o_orderkey * 91 % 1000) / 1e4 AS lon, o.o_totalprice / nullif(l.area, 0) AS ppm
  FROM orders o LEFT JOIN lines l ON l.listing_id = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN part p ON p.p_partkey = l.partkey
)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, field, event_id, ts, value) observations of the events table, with their currency, evidence and resolution."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("field"), "event_id", "ts", "value", *(F.expr(e).alias(c) for c, e in STATE.items()))


#: What an observation's assessment looks at besides its value, as SQL over events.
STATE = {
    "currency": "CASE WHEN event_id % 23 = 0 THEN 'USD' ELSE 'PEN' END", "evidence_state": "CASE event_id % 29 WHEN 0 THEN 'restricted' WHEN 1 THEN 'missing' ELSE 'authorized' END",
    "semantic": "CASE WHEN event_id % 37 = 0 THEN 'area' ELSE 'price' END", "resolved": "event_id % 31 <> 0", "duplicate": "event_id % 43 = 0",
}
CHANGES_SQL = f"changes AS (SELECT user_id AS entity_id, event_type AS field, event_id, ts, value, {', '.join(f'{e} AS {c}' for c, e in STATE.items())} FROM events)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, text, n_chars, permission): toxic is restricted, no label pending, quality authorized, else unavailable."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    permission = F.when(F.col("toxic") == 1, "restricted").when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "authorized").otherwise("unavailable")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", "source", "lang", "text", "n_chars", permission.alias("permission"))


EVIDENCE_SQL = """marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1), evidence AS (
  SELECT d.doc_id, d.source, d.lang, d.text, d.n_chars, CASE WHEN m.toxic = 1 THEN 'restricted' WHEN m.quality IS NULL THEN 'pending' WHEN m.quality = 1 THEN 'authorized' ELSE 'unavailable' END AS permission
  FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed fact per line item: semantic_type by return flag, quality by line status, base value and unit."""
    x = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "list_price").when(F.col("l_returnflag") == "N", "total_area").otherwise("unit_price")
    return x.select(
        F.col("l_orderkey").alias("listing_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("source_id"), kind.alias("semantic_type"),
        F.when(F.col("l_returnflag") == "N", "m2").otherwise("PEN").alias("unit"), F.when(F.col("l_linestatus") == "F", "certified").otherwise("reviewable").alias("quality"),
        F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(F.col("l_extendedprice")).alias("value"), (F.col("l_discount") < 0.08).alias("eligible"), F.col("l_shipdate").alias("captured_at"),
    )


FACTS_SQL = """facts AS (SELECT l_orderkey AS listing_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS source_id,
  CASE l_returnflag WHEN 'A' THEN 'list_price' WHEN 'N' THEN 'total_area' ELSE 'unit_price' END AS semantic_type, CASE WHEN l_returnflag = 'N' THEN 'm2' ELSE 'PEN' END AS unit,
  CASE WHEN l_linestatus = 'F' THEN 'certified' ELSE 'reviewable' END AS quality, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE l_extendedprice END AS value, l_discount < 0.08e0 AS eligible, l_shipdate AS captured_at
  FROM lineitem)"""
