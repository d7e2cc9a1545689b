"""Exact quantiles of groups of any size.

Values are counted, range-partitioned by (group, value), and ranked by a running sum inside each range plus what earlier
ranges hold, so no task and no aggregation buffer holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.sources.scratch import written


def exact(df: DataFrame, by: list[str], value: Column | str, *ps: float) -> DataFrame:
    """(by, q) for the groups with a value: linear interpolation between order statistics, over what is not null."""
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(*by, v.cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    ranges = written(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    # A row of each group and range: as many as there are ranges and groups together.
    slices = ranges.groupBy(*by, "_part").agg(F.sum("_n").alias("_own"))
    group = W.partitionBy(*by).orderBy("_part")
    slices = slices.select(*by, "_part", (F.sum("_own").over(group) - F.col("_own")).alias("_start"), F.sum("_own").over(W.partitionBy(*by)).alias("_total"))
    inner = W.partitionBy(*by, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    null_safe = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    ranked = ranges.withColumn("_last", F.sum("_n").over(inner)).alias("r").join(slices.alias("s"), [*null_safe, F.col("r._part") == F.col("s._part")])
    last = F.col("_start") + F.col("_last") - 1
    first = last - F.col("_n") + 1
    holds = lambda at: F.max(F.when((first <= at) & (at <= last), F.col("_v")))
    places = [(F.col("_total") - 1) * F.lit(p) for p in ps]
    ends = [x for k, p in enumerate(places) for x in (holds(F.floor(p)).alias(f"_low{k}"), holds(F.ceil(p)).alias(f"_high{k}"))]
    out = ranked.groupBy(*(F.col(f"r.{c}").alias(c) for c in by)).agg(F.max("_total").alias("_total"), *ends)
    return out.select(*by, F.array(*(F.col(f"_low{k}") + (p - F.floor(p)) * (F.col(f"_high{k}") - F.col(f"_low{k}")) for k, p in enumerate(places))).alias("q"))
