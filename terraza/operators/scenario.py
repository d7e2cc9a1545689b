"""Scenario answers: which listings are in scope, which are comparable, and what their prices say."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.functions.quantiles import exact
from terraza.operators import geo, scoring
from terraza.sources.scratch import written


@dataclass(frozen=True)
class Scenario:
    district: str
    target: scoring.Target
    mode: str = "district"  #: or radius


def territorial(df: DataFrame, s: Scenario) -> DataFrame:
    """Each listing's place in the scope: inside, outside, or why it cannot be placed."""
    valid = S.valid_coordinate(F.col("lat"), F.col("lon"))
    metres = S.haversine(F.lit(s.target.lat), F.lit(s.target.lon), F.col("lat"), F.col("lon"))
    inside = F.col("district") == s.district if s.mode == "district" else metres <= s.target.radius
    state = F.when(~valid, "coordinate_invalid").when(F.coalesce(inside, F.lit(False)), "inside").otherwise("outside")
    return df.select("listing_id", state.alias("scope"), F.when(valid, S.half_up(metres, 1)).alias("metres"))


def comparability(df: DataFrame, s: Scenario, least: int = 3) -> DataFrame:
    """One row: listings in scope, those that are comparable and priced, and where the target stands among them."""
    scope = territorial(df, s).where("scope = 'inside'").select("listing_id")
    own = df.join(scope, "listing_id", "left_semi")
    scores = scoring.score(own, s.target).select("listing_id", "score", "weight", "label")
    joined = own.select("listing_id", "ppm", "currency").join(scores, "listing_id")
    comparable = F.coalesce(F.col("label").isin("Alta", "Media"), F.lit(False))
    reference = comparable & F.coalesce((F.col("ppm") > 0) & (F.col("currency") == "PEN"), F.lit(False))
    joined = written(joined.select("score", "ppm", comparable.alias("comparable"), reference.alias("reference"), F.lit(1).alias("one")), "scope")
    out = joined.groupBy().agg(F.count("*").alias("in_scope"), F.count_if("comparable").alias("comparable"), F.count_if("reference").alias("references"), S.half_up(F.avg("score"), 1).alias("mean_score")).withColumn("one", F.lit(1))
    out = out.join(exact(joined.where("reference"), ["one"], "ppm", 0.5).select("one", F.col("q")[0].alias("median")), "one", "left")
    share = S.ratio(F.lit(s.target.ppm) - F.col("median"), F.col("median"))
    where = F.when(F.col("references") < least, "insufficient").when(share < -0.08, "Entrada").when(share > 0.08, "Premium").otherwise("Alineado")
    return out.select("in_scope", "comparable", "references", S.half_up("median", 2).alias("median"), "mean_score", where.alias("position"))


def composed(df: DataFrame, target: scoring.Target, past: DataFrame, least: int = 3) -> DataFrame:
    """Each district's scenario in one row: its scope, what is comparable with the target, where the target stands, its history, and its state.

    past is (district_id, candidates, events, shown_events, agenda, action). Listings of no district are the district -1, as is their
    past; a district without comparable prices is insufficient and has the median 0, one without a past has no events.
    """
    scores = scoring.score(df, target).select("listing_id", "score", "label")
    comparable = F.coalesce(F.col("label").isin("Alta", "Media"), F.lit(False))
    reference = comparable & F.coalesce((F.col("ppm") > 0) & (F.col("currency") == "PEN"), F.lit(False))
    valid = S.valid_coordinate(F.col("lat"), F.col("lon"))
    own = df.select("listing_id", F.coalesce("district_id", F.lit(-1)).alias("district_id"), "ppm", "currency", valid.alias("valid")).join(scores, "listing_id")
    own = written(own.select("district_id", "valid", "ppm", "score", comparable.alias("comparable"), reference.alias("reference")), "scope")
    counts = own.groupBy("district_id").agg(
        F.count("*").alias("in_scope"), F.count_if("valid").alias("placed"), F.count_if("comparable").alias("comparable"), F.count_if("reference").alias("references"), S.half_up(F.avg("score"), 1).alias("mean_score")
    )
    out = counts.join(exact(own.where("reference"), ["district_id"], "ppm", 0.5).select("district_id", F.col("q")[0].alias("median")), "district_id", "left")
    past = past.select(F.coalesce("district_id", F.lit(-1)).alias("district_id"), "candidates", "events", "shown_events", "agenda", "action")
    out = out.join(past, "district_id", "left").fillna(0, ["candidates", "events", "shown_events"]).fillna("", ["agenda", "action"])
    share = S.ratio(F.lit(target.ppm) - F.col("median"), F.col("median"))
    position = F.when(F.col("references") < least, "insufficient").when(share < -0.08, "Entrada").when(share > 0.08, "Premium").otherwise("Alineado")
    state = F.when(F.col("references") < least, "insufficient").when(F.col("shown_events") == 0, "without_history").when(F.col("placed") < F.col("in_scope"), "partial").otherwise("ready")
    names = ("district_id", "in_scope", "placed", "comparable", "references", F.coalesce(S.half_up("median", 2), F.lit(0.0)).alias("median"), "mean_score", position.alias("position"), "candidates", "events", "shown_events", "agenda", "action", state.alias("state"))
    return out.select(*names)


def quantitative(df: DataFrame) -> DataFrame:
    """Each district's price series with its ledger: used, missing and excluded add up to the input."""
    used, missing = (F.col("ppm") > 0) & (F.col("currency") == "PEN"), F.col("ppm").isNull()
    used = F.coalesce(used, F.lit(False))
    df = written(df, "listings")
    own = df.groupBy("district").agg(F.count("*").alias("input"), F.count_if(used).alias("used"), F.count_if(missing).alias("missing"), F.count_if(~used & ~missing).alias("excluded"))
    own = own.join(exact(df.where(used), ["district"], "ppm", 0.25, 0.5, 0.75).withColumnRenamed("district", "of"), F.col("district").eqNullSafe(F.col("of")), "left")
    return own.select("district", "input", "used", "missing", "excluded", *(S.half_up(F.col("q")[i], 2).alias(k) for i, k in enumerate(("p25", "median", "p75"))))


# What listings are compared on.
COMPARED = ("district", "typology", "phase", "price", "area", "ppm", "units", "bedrooms_min", "delivery_year", "currency")


def comparison(df: DataFrame, by: str) -> DataFrame:
    """A few listings of each group in long form: each attribute's value and whether the group's listings differ on it."""
    text = lambda c: S.half_up(c, 2).cast("decimal(18,2)").cast("string") if c in ("price", "area", "ppm") else F.col(c).cast("string")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(text(c), F.lit("unknown")).alias("value")) for c in COMPARED)))
    own = df.select("listing_id", by, each.alias("e")).select("listing_id", by, "e.field", "e.value")
    w = W.partitionBy(by, "field")
    return own.withColumn("differs", F.min("value").over(w) != F.max("value").over(w))


#: Findings of a comparison in order of importance: the code, the column, and whether the least value is the one to name.
FINDINGS = (("lowest_ppm", "ppm", True), ("largest_area", "area", False), ("earliest_delivery", "delivery_year", True))


def findings(df: DataFrame, by: str, most: int = 3) -> DataFrame:
    """(by, nth, code, listing_id): at most so many findings on the few listings of each group; a column of one value or none says nothing.

    Listings in several currencies are the first finding, of no one listing (-1). Of equal values the smallest id is named.
    """
    differs = lambda c: F.count_distinct(c) > 1
    named = lambda c, least: F.min_by("listing_id", F.when(F.col(c).isNotNull(), F.struct(F.col(c) if least else -F.col(c), F.col("listing_id"))))
    found = lambda code, who: F.struct(F.lit(code).alias("code"), who.cast("long").alias("listing_id"))
    rows = [F.when(differs("currency"), found("currencies_differ", F.lit(-1))), *(F.when(differs(c), found(code, named(c, least))) for code, c, least in FINDINGS)]
    own = df.groupBy(by).agg(F.slice(F.array_compact(F.array(*rows)), 1, most).alias("f"))
    return own.select(by, F.posexplode("f")).select(by, (F.col("pos") + 1).alias("nth"), "col.code", "col.listing_id")


def market_summary(df: DataFrame) -> DataFrame:
    """The median price and level of every quadrant of the districts with most listings."""
    top = geo.high_load(df).select("district_id", "rank")
    names = df.select("district_id", "district").distinct().join(top, "district_id")
    return geo.quadrant_reading(df.join(F.broadcast(top.select("district_id")), "district_id", "left_semi")).join(names.select("district", "rank"), "district")
