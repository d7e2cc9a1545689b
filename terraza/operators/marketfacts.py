"""Benchmark facts of projects: what each source row says, an index of it by project, and four ledgers that part the projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.operators.identity import raised
from terraza.sources.scratch import apart, written

# The indicators, and the currencies that are known.
INDICATORS = ("price_per_m2_total", "units_reported", "parking_reported", "attributes_announced")
CURRENCIES = ("PEN", "USD")
TASK = 100_000  #: projects whose entries one task counts apart: some 100 MB


def read(rows: DataFrame, blocked: DataFrame, cutoff: str) -> DataFrame:
    """One row of each project with its values made sound; a project with two source rows is an error.

    rows: project_id, captured_at, currency, price, area, units, parking, attributes; blocked: project_id. Prices and areas count above 0, units and
    parking from 0 on; a currency that isn't known is unknown. A row without a date is after the cutoff.
    """
    twice = rows.groupBy("project_id").count().where("count > 1")
    raised(twice, "projects with several source rows")
    at = F.to_timestamp_ntz(F.lit(cutoff), F.lit("yyyy-MM-dd HH:mm:ss"))
    own = rows.join(apart(blocked.select("project_id").distinct().withColumn("blocked", F.lit(True))), "project_id", "left")
    positive, counted = (lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))), (lambda c: F.when(F.col(c) >= 0, F.col(c).cast("double")))
    return own.select(
        "project_id", "captured_at", F.coalesce(F.col("captured_at").cast("timestamp_ntz") > at, F.lit(True)).alias("late"), F.coalesce("blocked", F.lit(False)).alias("blocked"), F.when(F.col("currency").isin(*CURRENCIES), F.col("currency")).otherwise("unknown").alias("currency"),
        positive("price").alias("price"), positive("area").alias("area"), counted("units").alias("units"), counted("parking").alias("parking"), "attributes",
    )


def tokens(own: DataFrame, catalog: DataFrame) -> DataFrame:
    """(project_id, token, attribute_id, known): every token of each project's attributes, ignored ones left out; unknown ones have no attribute_id.

    catalog: term, attribute_id; a term without attribute_id is ignored. Of several tokens for one attribute the first counts.
    """
    each = own.select("project_id", F.posexplode(F.split("attributes", " ")).alias("nth", "token")).where("token <> ''").withColumn("term", F.lower("token"))
    found = each.join(catalog.select("term", "attribute_id", F.lit(True).alias("known")), "term", "left").where("known is null or attribute_id is not null")
    named = found.where("known").groupBy("project_id", "attribute_id").agg(F.min_by("token", "nth").alias("token")).withColumn("known", F.lit(True))
    return named.select("project_id", "token", "attribute_id", "known").unionByName(found.where("known is null").select("project_id", "token", "attribute_id", F.lit(False).alias("known")))


def facts(own: DataFrame, attributes: DataFrame) -> DataFrame:
    """(fact_id, project_id, field_name, semantic_type, unit, value, text, value_kind, eligible, exclusion_reason): one row each.

    The price of a square metre follows from price and area where both are known in PEN and nothing is against them, and is never
    eligible, as they need not be of one home. Reasons are in order: a blocking issue, the cutoff, the currency.
    """
    local = F.col("currency") == "PEN"
    both = F.col("price").isNotNull() & F.col("area").isNotNull() & local & ~F.col("late") & ~F.col("blocked")
    why = {  # what is against a field's fact; null if nothing is
        "price": F.when(F.col("blocked"), "blocking_issue").when(F.col("late"), "cutoff").when(~local, "currency"), "area": F.when(F.col("blocked"), "blocking_issue").when(F.col("late"), "cutoff"), "count": F.when(F.col("late"), "cutoff"),
    }
    row = lambda name, kind, unit, value, against, how="observed": F.when(value.isNotNull(), F.struct(F.lit(name).alias("field_name"), F.lit(kind).alias("semantic_type"), unit.alias("unit"), value.alias("value"), F.lit(None).cast("string").alias("text"), F.lit(how).alias("value_kind"), against.alias("exclusion_reason")))
    rows = [
        row("published_price_from", "price", F.col("currency"), F.col("price"), why["price"]), row("total_area_min", "area", F.lit("m2"), F.col("area"), why["area"]),
        row("price_per_total_m2_orientative", "price_per_m2", F.lit("PEN/m2"), F.when(both, S.half_up(S.ratio(F.col("price"), F.col("area")), 2)), F.lit("price_area_link_unresolved"), "derived"),
        row("reported_unit_count", "count", F.lit("count"), F.col("units"), why["count"]), row("parking_count", "count", F.lit("count"), F.col("parking"), why["count"]),
    ]
    plain = own.select("project_id", F.inline(F.array_compact(F.array(*rows))))
    late = own.select("project_id", "late")
    named = attributes.where("known").join(apart(late), "project_id").select("project_id", F.concat(F.lit("attribute_"), F.replace(F.substring_index("attribute_id", ":", -1), F.lit("-"), F.lit("_"))).alias("field_name"), F.lit("attribute").alias("semantic_type"), F.lit("text").alias("unit"), F.lit(None).cast("double").alias("value"), F.col("token").alias("text"), F.lit("observed").alias("value_kind"), F.when(F.col("late"), "cutoff").alias("exclusion_reason"))
    every = plain.unionByName(named)
    return every.select(F.concat(F.lit("fact:"), F.col("project_id").cast("string"), F.lit(":"), "field_name").alias("fact_id"), "*", F.col("exclusion_reason").isNull().alias("eligible"))


def index(own: DataFrame, made: DataFrame) -> DataFrame:
    """Each project's facts by what they are of, its attributes' number, and how its price and area are paired; blocked ones show neither."""
    fact = lambda name: F.max(F.when(F.col("field_name") == name, F.col("fact_id")))
    ids = made.groupBy("project_id").agg(*(fact(n).alias(k) for k, n in (("price_fact", "published_price_from"), ("area_fact", "total_area_min"), ("ppm_fact", "price_per_total_m2_orientative"), ("unit_fact", "reported_unit_count"), ("parking_fact", "parking_count"))), F.count_if(F.col("semantic_type") == "attribute").alias("attributes"))
    out = own.select("project_id", "blocked", "currency").join(apart(ids), "project_id", "left")
    paired = F.col("price_fact").isNotNull() & F.col("area_fact").isNotNull() & (F.col("currency") != "unknown")
    status = F.when(F.col("blocked"), "conflicting").when(paired, "project_minima_pair_unresolved").otherwise("missing")
    open_ = lambda c: F.when(~F.col("blocked"), F.col(c)).alias(c)
    return out.select("project_id", "price_fact", open_("area_fact"), open_("ppm_fact"), "unit_fact", "parking_fact", F.coalesce("attributes", F.lit(0)).alias("attributes"), status.alias("pairing_status"))


def ledgers(own: DataFrame, made: DataFrame) -> DataFrame:
    """(indicator, project_id, state, reason): each project once in each ledger, as used, missing or excluded with its first reason."""
    named = made.where("semantic_type = 'attribute'").select("project_id").distinct().withColumn("named", F.lit(True))
    late = F.col("late")
    none = F.lit(None).cast("string")
    entry = lambda state, reason=none: F.struct(F.lit(state).alias("state"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    unknown = F.col("price").isNull() | F.col("area").isNull() | (F.col("currency") == "unknown")
    of = {
        "price_per_m2_total": F.when(F.col("blocked"), entry("excluded", "blocking_issue")).when(late, entry("excluded", "cutoff")).when(F.col("price").isNotNull() & (F.col("currency") == "USD"), entry("excluded", "currency")).when(unknown, entry("missing")).otherwise(entry("excluded", "price_area_link_unresolved")),
        **{k: F.when(late, entry("excluded", "cutoff")).when(there, entry("used")).otherwise(entry("missing")) for k, there in (("units_reported", F.col("units").isNotNull()), ("parking_reported", F.col("parking").isNotNull()), ("attributes_announced", F.coalesce("named", F.lit(False))))},
    }
    rows = F.inline(F.array(*(F.struct(F.lit(k).alias("indicator"), v.alias("entry")) for k, v in of.items())))
    return own.join(apart(named), "project_id", "left").select("project_id", rows).select("indicator", "project_id", "entry.state", "entry.reason")


def coverage(entries: DataFrame, projects: DataFrame) -> DataFrame:
    """Of each indicator: projects, used, missing and excluded, and whether every project is in its ledger just once."""
    is_ = lambda s: F.count_if(F.col("state") == s).alias(s)
    tasks = 1 + projects.count() // TASK  # adaptive execution joins partitions by compressed bytes, and ids compress well
    entries = entries.select("indicator", "project_id", "state").repartition(tasks, "project_id")
    own = entries.groupBy("indicator").agg(F.count("*").alias("entries"), F.countDistinct("project_id").alias("distinct_projects"), is_("used"), is_("missing"), is_("excluded"), F.count_if(F.col("state").isin("used", "missing", "excluded")).alias("_placed"))
    n = projects.agg(F.count("*").alias("projects"))
    return own.crossJoin(F.broadcast(n)).select("indicator", "projects", "used", "missing", "excluded", ((F.col("entries") == F.col("projects")) & (F.col("distinct_projects") == F.col("projects")) & (F.col("_placed") == F.col("projects"))).alias("parted"))


def materialized(rows: DataFrame, blocked: DataFrame, catalog: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sound rows, the attribute tokens and the facts, each written once for all that follows."""
    own = written(read(rows, blocked, cutoff), "projects")
    found = written(tokens(own, catalog), "tokens")
    return own, found, written(facts(own, found), "facts")
