"""Measures of a listing: derived prices, areas, differences, positions and plot models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.functions.quantiles import exact
from terraza.operators import ordered
from terraza.sources.scratch import written

SMALL = 10_000  #: rows of medians that are broadcast


def price_per_m2(price: Column, area: Column, currency: Column) -> tuple[Column, Column]:
    """Status and value of the typed division; the first failure names the status."""
    status = F.when(currency != "PEN", "currency_unknown").when(price.isNull(), "price_missing").when(area.isNull(), "area_missing").when(area <= 0, "area_not_positive").when(price <= 0, "price_not_positive").otherwise("available")
    return status, F.when(status == "available", S.half_up(S.ratio(price, area), 2))


def free_area(total: Column, built: Column) -> Column:
    """Total minus built where both are known and the difference is not negative."""
    return F.when(total >= built, S.half_up(total - built, 2))


def difference(previous: Column, current: Column, base: Column) -> tuple[Column, Column, Column]:
    """Delta, the rounded delta's per cent of a base, and the reason why there is none."""
    delta = S.half_up(current - previous, 2)
    percent = S.half_up(S.ratio(delta * 100, base), 2)
    return delta, percent, F.when(base == 0, "PERCENT_BASE_ZERO").when(base.isNull() | delta.isNull(), "UNAVAILABLE")


def position(value: Column, median: Column, band: float = 0.08) -> Column:
    share = S.ratio(value - median, median)
    return F.when(share.isNull(), "Sin dato").when(share < -band, "Entrada").when(share > band, "Premium").otherwise("Alineado")


def competitive_reading(ppm: Column, median: Column, area: Column, median_area: Column) -> Column:
    """Cheaper, dearer or in line with the market, and whether the area sets it apart."""
    price = F.when(ppm < median * 0.95, "cheaper").when(ppm > median * 1.08, "dearer").otherwise("in line")
    return F.when(ppm.isNull() | area.isNull(), "unknown").otherwise(F.concat(price, F.when(F.abs(area - median_area) / median_area > 0.12, ", other area").otherwise("")))


def against_district(df: DataFrame) -> DataFrame:
    """Every listing beside its district's medians."""
    df = written(df, "listings")
    ppm, area = (exact(df, ["district"], c, 0.5).select("district", F.col("q")[0].alias(f"median_{c}")) for c in ("ppm", "area"))
    middle = written(df.select("district").distinct().join(ppm, "district", "left").join(area, "district", "left"), "medians")
    return df.join(F.broadcast(middle) if middle.count() <= SMALL else middle, "district")


def scatter(df: DataFrame) -> DataFrame:
    """Points of the area-price plot by side of their district's median price; districts of under three points have none."""
    own = df.where((F.col("area") > 0) & (F.col("ppm") > 0))
    own = against_district(own).groupBy("district").agg(F.count("*").alias("n"), F.count_if(F.col("ppm") < F.col("median_ppm")).alias("below"), F.count_if(F.col("ppm") >= F.col("median_ppm")).alias("above"))
    return own.where("n >= 3")


def plot_domain(df: DataFrame) -> DataFrame:
    """Axis limits padded by 8 per cent of the span, of the points that can be plotted, and how many cannot."""
    fits = F.coalesce((F.col("area") > 0) & (F.col("ppm") > 0), F.lit(False))
    pick = lambda f, c: f(F.when(fits, F.col(c)))
    own = df.groupBy("district").agg(F.count_if(fits).alias("plotted"), F.count_if(~fits).alias("omitted"), *(pick(f, c).alias(f"{k}_{c}") for c in ("area", "ppm") for f, k in ((F.min, "min"), (F.max, "max"))))
    span = lambda c: (F.col(f"max_{c}") - F.col(f"min_{c}")) * 0.08
    return own.select("district", "plotted", "omitted", *(S.half_up(F.col(f"{k}_{c}") + s * span(c), 2).alias(f"{k}_{c}") for c in ("area", "ppm") for k, s in (("min", -1), ("max", 1))))


def gauge(df: DataFrame, target: float) -> DataFrame:
    """Places of the ends, the median and a target on each district's price band, padded by 18 per cent, in per cent, held to 0 to 100."""
    own = written(df.where("ppm > 0").select("district", "ppm"), "listings")
    middle = exact(own, ["district"], "ppm", 0.5).select("district", F.col("q")[0].alias("median"))
    own = own.groupBy("district").agg(F.min("ppm").alias("low"), F.max("ppm").alias("high")).join(middle, "district")
    least, most = F.greatest(F.lit(1.0), F.col("low") * 0.82), F.col("high") * 1.18
    place = lambda x: S.half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), S.ratio((x - least) * 100, most - least))), 1)
    return own.select("district", place(F.col("low")).alias("low_at"), place(F.col("high")).alias("high_at"), place(F.col("median")).alias("median_at"), place(F.lit(float(target))).alias("target_at"))


def nice_step(span: Column, ticks: int = 5) -> Column:
    """The least of 1, 2 or 5 times a power of ten that parts a span into at most so many steps."""
    raw = span / ticks
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)).cast("double"))
    return F.when(raw <= unit, unit).when(raw <= unit * 2, unit * 2).when(raw <= unit * 5, unit * 5).otherwise(unit * 10)


def series(df: DataFrame, by: str, value: str) -> DataFrame:
    """Number, quartiles and whether a sample is ready (3 or more), orientative or insufficient."""
    df = written(df.select(by, value), "series")
    own = df.groupBy(by).agg(F.count(value).alias("n")).join(exact(df, [by], value, 0.25, 0.5, 0.75).withColumnRenamed(by, "of"), F.col(by).eqNullSafe(F.col("of")), "left")
    status = F.when(F.col("n") == 0, "insufficient").when(F.col("n") < 3, "orientative").otherwise("ready")
    return own.select(by, "n", status.alias("status"), *(S.half_up(F.col("q")[i], 6).alias(k) for i, k in enumerate(("p25", "median", "p75"))))


def price_delta(df: DataFrame) -> DataFrame:
    """Each listing's price against the agency's listing before it in time."""
    own = ordered.lagged(df.select("listing_id", "agency", "price", "captured_at"), ["agency"], ["captured_at", "listing_id"], before="price")
    delta, percent, why = difference(F.col("before"), F.col("price"), F.col("before"))
    return own.select("listing_id", delta.alias("delta"), percent.alias("percent"), why.alias("reason"))


def segment_distance(px: Column, py: Column, ax: float, ay: float, bx: float, by: float) -> Column:
    """Distance of a point to a segment, in the units of the coordinates."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
    return F.sqrt(F.pow(px - (ax + t * (bx - ax)), 2) + F.pow(py - (ay + t * (by - ay)), 2))
