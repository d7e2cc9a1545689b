"""Districts with polygons: where listings lie, what speaks against counting them, and each district's quadrants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.functions.quantiles import exact
from terraza.operators import cells
from terraza.sources.scratch import apart, written

# The stages at which a listing leaves, each with its reasons, in order, and the quadrants.
STAGES = {"scope": ("not_high_load",), "geography": ("invalid_coordinates", "outside_district_polygon"), "reconciliation": ("not_reconciled",)}
QUADRANTS = ("NW", "NE", "SW", "SE")


def assignments(listings: DataFrame, polygons: DataFrame, width: float, high_load: int = 7) -> DataFrame:
    """Every listing with where it lies and why it doesn't count: one row each, so assigned and excluded ones add up to the input.

    listings: listing_id, district_id (declared), lat, lon, reconciled; polygons: polygon, parts. The high_load districts with
    most listings at valid coordinates are in scope. A listing is assigned if its point lies in its own district's polygon,
    in others besides or not; found is how many polygons hold it. The stage and reason are those of the first rule that it breaks; both are null
    if it is assigned and reconciled. The quadrant is told by the medians of the district's assigned points, reconciled or not.
    """
    own = written(listings.withColumn("coordinate_valid", S.valid_coordinate(F.col("lat"), F.col("lon"))), "listings")
    valid = own.where("coordinate_valid")
    top = valid.where("district_id is not null").groupBy("district_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "district_id").limit(high_load).select("district_id", F.lit(True).alias("high_load"))
    points = valid.select(F.col("listing_id").alias("point"), F.col("lon").alias("x"), F.col("lat").alias("y"), "district_id")
    found = cells.within(points, polygons, "polygon", width)
    found = found.groupBy(F.col("point").alias("listing_id")).agg(F.count("*").alias("found"), F.max(F.col("polygon").eqNullSafe(F.col("district_id"))).alias("polygon_valid"))
    placed = own.join(F.broadcast(top), "district_id", "left").join(apart(found), "listing_id", "left")
    placed = placed.withColumns({"high_load": F.coalesce("high_load", F.lit(False)), "found": F.coalesce("found", F.lit(0).cast("long")), "polygon_valid": F.coalesce("polygon_valid", F.lit(False))})
    placed = written(placed, "placed")
    counted = placed.where("high_load and polygon_valid")
    lat, lon = (exact(counted, ["district_id"], c, 0.5).select("district_id", F.col("q")[0].alias(f"mid_{c}")) for c in ("lat", "lon"))
    out = placed.join(F.broadcast(lat.join(lon, "district_id")), "district_id", "left")  # high_load rows
    side = F.concat(F.when(F.col("lat") >= F.col("mid_lat"), "N").otherwise("S"), F.when(F.col("lon") < F.col("mid_lon"), "W").otherwise("E"))
    broken = {"not_high_load": ~F.col("high_load"), "invalid_coordinates": ~F.col("coordinate_valid"), "outside_district_polygon": ~F.col("polygon_valid"), "not_reconciled": ~F.col("reconciled")}
    reason = F.coalesce(*(F.when(c, k) for k, c in broken.items()))
    stage = F.coalesce(*(F.when(reason.isin(*reasons), s) for s, reasons in STAGES.items()))
    return out.withColumns({"quadrant": F.when(F.col("high_load") & F.col("polygon_valid"), side), "reason": reason, "stage": stage})


def model(assigned: DataFrame) -> DataFrame:
    """Each high-load district's counts at every stage, its medians and its quadrants; observed is the sum of counted and excluded."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    own = assigned.where("high_load").groupBy("district_id")
    return own.agg(
        F.count("*").alias("observed"), F.count_if("coordinate_valid").alias("coordinate_valid"), F.count_if("polygon_valid").alias("polygon_valid"), F.count_if(F.col("polygon_valid") & (F.col("found") > 1)).alias("shared"),
        F.count_if("reconciled").alias("reconciled"), count(F.col("reason").isNull()).alias("counted"), S.half_up(F.max("mid_lat"), 6).alias("mid_lat"), S.half_up(F.max("mid_lon"), 6).alias("mid_lon"),
        *(count(F.col("reason") == r).alias(r) for s, reasons in STAGES.items() if s != "scope" for r in reasons), *(count(F.col("quadrant") == q).alias(q.lower()) for q in QUADRANTS), *(count((F.col("quadrant") == q) & F.col("reconciled")).alias(f"{q.lower()}_reconciled") for q in QUADRANTS),
    )


def exclusions(assigned: DataFrame) -> DataFrame:
    """(stage, reason, listings) of all listings, those that count under the stage counted: the counts add up to the input."""
    return assigned.groupBy(F.coalesce("stage", F.lit("counted")).alias("stage"), F.coalesce("reason", F.lit("counted")).alias("reason")).agg(F.count("*").alias("listings"))
