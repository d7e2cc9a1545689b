"""Queries on answers: what users' questions are told of their district, by intent, or by the words of the older assistant."""

from pyspark.sql import functions as F

from terraza.operators import answers as N
from terraza.operators import timeline as L
from terraza.operators.answers import Item
from terraza.plans import text as PT
from terraza.plans import timeline as PL
from terraza.registry import query
from terraza.sources import adapter as A

ITEMS = (
    Item("scenario-summary", "answer", "answer:scenario", "comparable"), Item("scenario-summary", "data", "metric:comparable-projects", "comparable"), Item("scenario-summary", "data", "metric:price-references", "priced"), Item("scenario-summary", "data", "metric:agencies", "agencies"),
    Item("scenario-summary", "interpretation", "interpretation:price-position", "mean_ppm", "priced >= 3"), Item("scenario-summary", "interpretation", "interpretation:visible-offer-only", "priced", "coalesce(priced, 0) < 3"),
    Item("scenario-summary", "limitations", "limitation:no-comparables", "0", "coalesce(comparable, 0) = 0"), Item("scenario-summary", "limitations", "limitation:orientative-price", "priced", "priced < 3"), Item("scenario-summary", "next_step", "action:open-benchmark", "district_name"),
    Item("market-changes", "answer", "answer:changes", "coalesce(shown_events, 0)"), Item("market-changes", "data", "metric:certified-changes", "certified", "events > 0"), Item("market-changes", "data", "metric:reviewable-changes", "reviewable", "events > 0"), Item("market-changes", "interpretation", "interpretation:changes-without-cause", "shown_events", "shown_events > 0"),
    Item("market-changes", "limitations", "limitation:no-history", "0", "coalesce(shown_events, 0) = 0"), Item("market-changes", "references", "reference:history-events", "agenda", "shown_events > 0"), Item("market-changes", "next_step", "action:open-activity", "district_name"),
    Item("signal-priority", "answer", "answer:first-signal", "agenda", "shown_events > 0"), Item("signal-priority", "answer", "answer:no-signal", "agenda", "coalesce(shown_events, 0) = 0"), Item("signal-priority", "data", "metric:certified-changes", "coalesce(certified, 0)"), Item("signal-priority", "next_step", "action:agenda", "coalesce(action, 'expand_or_review_scope')"),
    Item("coverage-quality", "answer", "answer:coverage", "comparable"), Item("coverage-quality", "data", "metric:with-price-per-m2", "priced"), Item("coverage-quality", "data", "metric:described", "described"), Item("coverage-quality", "data", "metric:history-excluded", "integrity_excluded", "integrity_excluded > 0"),
    Item("coverage-quality", "limitations", "limitation:missing-price-per-m2", "comparable - priced", "comparable > priced"), Item("coverage-quality", "next_step", "action:open-coverage", "district_name"),
    Item("qualitative-evidence", "answer", "answer:attributes", "described", "described > 0"), Item("qualitative-evidence", "limitations", "limitation:no-authorized-evidence", "0", "coalesce(described, 0) = 0"), Item("qualitative-evidence", "next_step", "action:open-evidence", "district_name"),
    Item("project-comparison", "answer", "answer:comparison", "comparable"), Item("project-comparison", "references", "reference:cheapest-project", "cheapest", "comparable > 0"), Item("project-comparison", "next_step", "action:open-comparator", "district_name"),
    Item("limitations", "answer", "answer:limitation", "topic"), Item("limitations", "limitations", "limitation:refused-topic", "topic", "topic IS NOT NULL"), Item("limitations", "next_step", "action:ask-otherwise", "district_name"),
)
#: The older assistant answers by the first of its words that a question holds, of the whole district.
ROUTES = {"price": ("precio", "valor"), "competition": ("compet", "inmobiliaria", "compar"), "stock": ("stock", "unidades"), "delivery": ("entrega",)}
LEGACY = (
    Item("price", "answer", "legacy:mean-price", "mean_ppm"), Item("price", "limitations", "legacy:few-references", "priced", "priced < 3"), Item("competition", "answer", "legacy:agencies", "agencies"), Item("competition", "data", "legacy:projects", "comparable"), Item("stock", "answer", "legacy:units", "units"),
    Item("delivery", "answer", "legacy:latest-delivery", "latest"), Item("overview", "answer", "legacy:overview", "comparable"), Item("overview", "next_step", "legacy:ask-more", "district_name"),
)


def contexts(spark, d):
    """What is known of each district: its listings and its price history."""
    own = A.listings(spark, d, "listing_id", "district_id", "district", "agency", "ppm", "currency", "amenities", "price", "units", "delivery_year")
    priced = F.coalesce((F.col("ppm") > 0) & (F.col("currency") == "PEN"), F.lit(False))
    counts = own.where("district_id is not null").groupBy("district_id").agg(
        F.max("district").alias("district_name"), F.count("*").alias("comparable"), F.count_if(priced).alias("priced"), F.countDistinct("agency").alias("agencies"), F.count("amenities").alias("described"), F.floor(F.avg(F.when(priced, F.col("ppm")))).alias("mean_ppm"),
        F.min_by("listing_id", F.struct("price", "listing_id")).alias("cheapest"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.max("delivery_year").alias("latest"),
    )
    history = L.counters(PL.timeline(spark, d)).select(F.col("district_id").alias("_of"), "events", "shown_events", "integrity_excluded", "certified", "reviewable", "agenda", "action")
    return counts.join(history, F.col("district_id") == F.col("_of"), "left").drop("_of")


_priced = "coalesce(ppm > 0 AND currency = 'PEN', false)"
_base = f"""{PL.COUNTERS}, {A.LISTINGS_SQL}, turns AS {PT._own[PT._own.index('(', PT._own.index('turns AS')):].replace('), own AS (', '), asked AS (', 1)},
contexts AS MATERIALIZED (SELECT g.*, h.events, h.shown_events, h.integrity_excluded, h.certified, h.reviewable, h.agenda, h.action FROM (SELECT district_id, max(district) AS district_name, count(*) AS comparable, count(*) FILTER ({_priced}) AS priced, count(DISTINCT agency) AS agencies, count(amenities) AS described,
CAST(floor(avg(CASE WHEN {_priced} THEN ppm END)) AS BIGINT) AS mean_ppm, arg_min(listing_id, (price, listing_id)) AS cheapest, CAST(coalesce(sum(units), 0) AS BIGINT) AS units, max(delivery_year) AS latest FROM listings WHERE district_id IS NOT NULL GROUP BY 1) g LEFT JOIN counters h ON h.district_id = g.district_id)"""


@query("assistant_answers", f"""{_base}, found AS MATERIALIZED (SELECT conv_id, turn, CAST(conv_id % 25 AS INTEGER) AS district_id, {PT._parts['intent']} AS intent, {PT._parts['topic']} AS topic FROM asked),
{N.answered_sql('found', 'contexts', 'district_id', ITEMS)} SELECT conv_id, turn, intent, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY nth) - 1 AS INTEGER) AS position, block, item, value FROM answers""")
def assistant_answers(spark, d):
    """The items of every understood question's answer, from its district's context."""
    asked = PT.questions(spark, d).select("conv_id", "turn", (F.col("conv_id") % 25).cast("int").alias("district_id"), "found.intent", F.col("found.topic").alias("topic"))
    return N.answered(asked, contexts(spark, d), "district_id", ITEMS).select("conv_id", "turn", "intent", "position", "block", "item", "value")


_route = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(q, '{w}')" for w in words)} THEN '{k}'" for k, words in ROUTES.items()) + " ELSE 'overview' END"


@query("legacy_assistant", f"""{_base}, found AS MATERIALIZED (SELECT conv_id, turn, CAST(conv_id % 25 AS INTEGER) AS district_id, {_route} AS intent FROM asked WHERE q <> ''),
{N.answered_sql('found', 'contexts', 'district_id', LEGACY)} SELECT conv_id, turn, intent AS route, block, item, value FROM answers""")
def legacy_assistant(spark, d):
    own = PT.questions(spark, d).where("q <> ''").select("conv_id", "turn", (F.col("conv_id") % 25).cast("int").alias("district_id"), F.expr(_route).alias("intent"))
    return N.answered(own, contexts(spark, d), "district_id", LEGACY).select("conv_id", "turn", F.col("intent").alias("route"), "block", "item", "value")
