"""Operators on listings: projections, filters, aggregates, rankings and limits. Each takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.functions.quantiles import exact
from terraza.sources.scratch import written


def positive(x: str) -> Column:
    return F.when(F.col(x) > 0, F.col(x))


def project_listing(df: DataFrame) -> DataFrame:
    """Typed projection with fallbacks: a price or area of zero is missing, and the published price per m2 follows from both."""
    price, area = positive("price"), positive("area")
    placed = S.valid_coordinate(F.col("lat"), F.col("lon"))
    more = [
        S.clean("district").alias("district"), S.clean("typology").alias("typology"), S.clean("segment").alias("segment"), S.clean("amenities").alias("amenities"), "phase", F.when(F.col("currency").isin("PEN", "USD"), F.col("currency")).otherwise("unknown").alias("currency"), "captured_at",
        F.coalesce("bedrooms_min", F.lit(0)).alias("bedrooms_min"), F.coalesce("bedrooms_max", F.lit(0)).alias("bedrooms_max"), F.coalesce("delivery_year", F.lit(0)).alias("delivery_year"), F.when(placed, F.col("lat")).alias("lat"), F.when(placed, F.col("lon")).alias("lon"),
        S.half_up(F.col("units") * F.col("price"), 2).alias("income"), S.half_up(F.col("units") * F.col("area"), 2).alias("total_m2"), F.concat(F.lit("project:feed-"), F.col("listing_id")).alias("project_id"), F.concat(F.lit("agency:"), S.slug("agency")).alias("agency_id"),
    ]
    return df.select("listing_id", S.clean("agency").alias("agency"), S.words("district").alias("district_key"), S.slug("typology").alias("typology_key"), price.alias("price"), area.alias("area"), S.half_up(S.ratio(price, area), 2).alias("price_m2"), F.coalesce("units", F.lit(0)).alias("units"), *more)


def derive_income(df: DataFrame) -> DataFrame:
    """Income and total area where they follow from units."""
    return df.select("listing_id", S.half_up(F.col("units") * F.col("price"), 2).alias("income"), S.half_up(F.col("units") * F.col("area"), 2).alias("total_m2"))


def certified(facts: DataFrame) -> DataFrame:
    """Eligible, certified, finite facts."""
    return facts.where(F.col("eligible") & (F.col("quality") == "certified") & F.col("value").isNotNull() & ~F.isnan("value"))


def filter_catalog(df: DataFrame, district: str = "Todos", typology: str = "Todos", phase: str = "Todos", query: str = "") -> DataFrame:
    """Equality filters with a wildcard, and a search that ignores case and marks over five columns."""
    for column, wanted in (("district", district), ("typology", typology), ("phase", phase)):
        if wanted != "Todos":
            df = df.where(F.col(column) == wanted)
    if query.strip():
        text = F.concat_ws(" ", *(F.lower(S.unaccent(c)) for c in ("agency", "district", "typology", "phase", "segment")))
        df = df.where(F.contains(text, F.lower(S.unaccent(F.lit(query.strip())))))
    return df


def price_reasons(df: DataFrame, cutoff: str, tolerance: float = 0.005) -> DataFrame:
    """The reasons for which a listing's price is not eligible, in order of precedence."""
    at = F.to_timestamp_ntz(F.lit(cutoff), F.lit("yyyy-MM-dd HH:mm:ss"))
    calc = S.ratio(F.col("price"), F.col("area"))
    why = S.reasons(
        currency_unknown=F.col("currency") != "PEN", price_missing=~F.coalesce(F.col("price") > 0, F.lit(False)), area_missing=~F.coalesce(F.col("area") > 0, F.lit(False)),
        ppm_missing=F.col("ppm").isNull(), captured_at_missing=F.col("captured_at").isNull(), after_cutoff=F.col("captured_at").cast("timestamp_ntz") > at, ppm_mismatch=F.abs(F.col("ppm") - calc) / calc > tolerance,
    )
    return df.select("listing_id", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("eligible"))


def product_reasons(df: DataFrame, typology: str, bedrooms: int, delivery_year: int) -> DataFrame:
    """Mismatches with the product asked for; a value that is unknown never excludes."""
    why = S.reasons(typology_mismatch=F.col("typology") != typology, bedrooms_mismatch=~F.lit(bedrooms).between(F.col("bedrooms_min"), F.col("bedrooms_max")), delivery_mismatch=F.col("delivery_year") != delivery_year)
    return df.select("listing_id", F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("eligible"))


def aggregate_certified(facts: DataFrame) -> DataFrame:
    """Count, mean, least and largest of certified facts, by semantic signature."""
    own = certified(facts).groupBy("semantic_type", "unit", "quality")
    return own.agg(F.count("*").alias("n"), S.half_up(F.avg("value"), 2).alias("mean"), F.min("value").alias("least"), F.max("value").alias("largest"))


def certified_mean(facts: DataFrame, by: str) -> DataFrame:
    """One mean a group that fails closed: insufficient if a value is missing, incompatible if signatures differ."""
    own = facts.groupBy(by).agg(F.count_if(F.col("value").isNull()).alias("missing"), F.countDistinct("semantic_type", "unit", "quality").alias("signatures"), F.avg("value").alias("mean"))
    status = F.when(F.col("missing") > 0, "insufficient").when(F.col("signatures") > 1, "incompatible").otherwise("available")
    return own.select(by, status.alias("status"), F.when(status == "available", S.half_up("mean", 2)).alias("mean"))


def executive(df: DataFrame) -> DataFrame:
    """The market in one row; money only over listings in the local currency."""
    money = F.col("currency") == "PEN"
    return df.agg(
        F.countDistinct("agency", "listing_id", "district").alias("projects"), F.sum("units").alias("units"), S.half_up(F.sum(F.when(money, F.col("units") * F.col("price"))), 0).alias("income"),
        S.half_up(F.avg(F.when(money, F.col("price"))), 2).alias("mean_price"), S.half_up(F.avg(F.when(money, F.col("ppm"))), 2).alias("mean_ppm"), F.countDistinct("district").alias("districts"), F.countDistinct("agency").alias("agencies"),
    )


def rankings(df: DataFrame, dimension: str, n: int) -> DataFrame:
    """Projects, units, income and mean price of the n largest values of a dimension; a missing value is Sin dato."""
    own = df.groupBy(F.coalesce(dimension, F.lit("Sin dato")).alias("name")).agg(
        F.countDistinct("listing_id").alias("projects"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"), S.half_up(F.sum(F.col("units") * F.col("price")), 0).alias("income"), S.half_up(F.avg("price"), 2).alias("mean_price")
    )
    return own.orderBy(F.desc("projects"), "name").limit(n)


def district_benchmark(df: DataFrame) -> DataFrame:
    """Count, units, quartiles of price per m2 and agencies of each district, over positive values."""
    own = df.withColumn("ppm", positive("ppm")).withColumn("price", positive("price"))
    own = written(own, "listings")
    out = own.groupBy("district").agg(F.count("*").alias("projects"), F.sum("units").alias("units"), F.avg("ppm").alias("m"), F.countDistinct("agency").alias("agencies"))
    for name, x, ps in (("q", "ppm", (0.25, 0.5, 0.75)), ("p", "price", (0.5,))):
        found = exact(own, ["district"], x, *ps).select(F.col("district").alias("of"), F.col("q").alias(name))
        out = out.join(found, F.col("district").eqNullSafe(F.col("of")), "left").drop("of")
    return out.select("district", "projects", "units", S.half_up("m", 2).alias("mean_ppm"), *(S.half_up(F.col("q")[i], 2).alias(k) for i, k in enumerate(("p25_ppm", "median_ppm", "p75_ppm"))), S.half_up(F.col("p")[0], 2).alias("median_price"), "agencies")


def price_diagnosis(df: DataFrame, target: float, least: int = 3, band: float = 0.08) -> DataFrame:
    """Where a target price per m2 stands against each district's references."""
    own = written(df.where(F.col("ppm") > 0).select("district", "ppm"), "listings")
    middle = exact(own, ["district"], "ppm", 0.5).select(F.col("district").alias("of"), F.col("q")[0].alias("median"))
    own = own.groupBy("district").agg(F.count("*").alias("n")).join(middle, F.col("district").eqNullSafe(F.col("of")), "left").drop("of")
    off = F.lit(float(target)) - F.col("median")
    share = S.ratio(off, F.col("median"))
    where = F.when(F.col("n") < least, "insufficient").when(share < -band, "Entrada").when(share > band, "Premium").otherwise("Alineado")
    return own.select("district", "n", where.alias("position"), S.round_away(off, 2).alias("difference"), S.round_away(share * 100, 1).alias("percent"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Sin dato")).alias("name")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """Counts of every value of several columns, unpivoted so that one pass and one shuffle count them all."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("Sin dato")).alias("name")) for c in columns)))
    return df.select(each.alias("e")).groupBy("e.dimension", "e.name").agg(F.count("*").alias("n"))


def completeness(df: DataFrame, *columns: str) -> DataFrame:
    """Share of rows with a value, in per cent, by column."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().cast("int").alias("there")) for c in columns)))
    return df.select(each.alias("e")).groupBy("e.field").agg(S.half_up(F.avg("e.there") * 100, 1).alias("percent"))


def funnel(df: DataFrame, cutoff_price: float) -> DataFrame:
    """Rows left after each stage, every stage within the one before, in a single pass."""
    stages = (("source", F.lit(True)), ("priced", F.col("price") > 0), ("measured", F.col("area") > 0), ("local", F.col("currency") == "PEN"), ("plausible", F.col("price") < cutoff_price))
    sums, kept = [], F.lit(True)
    for name, condition in stages:
        kept = kept & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(kept).alias(name))
    return df.agg(*sums)


def stock(df: DataFrame) -> DataFrame:
    own = df.where(F.col("typology").isNotNull()).groupBy("typology", "district")
    return own.agg(F.sum("units").alias("units"), F.count("*").alias("projects"), S.half_up(F.avg("ppm"), 2).alias("mean_ppm"))


def share_of_top_agency(df: DataFrame) -> DataFrame:
    """The largest agency's share of each district's listings."""
    own = df.groupBy("district", "agency").agg(F.count("*").alias("n")).groupBy("district").agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    share = S.ratio(F.col("top"), F.col("total"))
    return own.select("district", "top", "total", S.half_up(share, 4).alias("share"), (share >= 0.22).alias("concentrated"))


def rank_within(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def first_last_seen(df: DataFrame) -> DataFrame:
    return df.groupBy("agency").agg(F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"), F.count("*").alias("n"))


def competition_level(df: DataFrame) -> DataFrame:
    own = df.groupBy("district").agg(F.count("*").alias("projects"), F.countDistinct("agency").alias("agencies"))
    level = F.when((F.col("projects") >= 60) | (F.col("agencies") >= 28), "Alta").when((F.col("projects") >= 20) | (F.col("agencies") >= 10), "Media").otherwise("Baja")
    return own.withColumn("level", level)


def duplicate_groups(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
