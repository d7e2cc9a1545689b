"""Order over whole tables without a window that holds a group: range partitions, and what each carries to the next.

Rows are range-partitioned by their group and order, so a group of any size lies in neighbouring ranges. Inside a range a window does the
work; one row for each range, its last, or its count, is then carried to the ranges after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.sources.scratch import written

MARKS = ("_part", "_first", "_last", "_seen")


def _ranged(df: DataFrame, columns: list[str]) -> DataFrame:
    """df as a written table, range-partitioned by columns, with the number of each row's range."""
    return written(df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()), "ranges")


def lagged(df: DataFrame, by: list[str], order: list[str], **columns: str) -> DataFrame:
    """df with each named column's value in the row before, in rising order within its group; null in a group's first row.

    Nulls come first, in groups as in orders; rows that tie on all order columns may follow each other either way. Extra columns are
    kept. An empty table stays empty.
    """
    ranges = _ranged(df, [*by, *order])
    window = W.partitionBy("_part", *by).orderBy(*order)
    inner = ranges.withColumns({"_seen": F.row_number().over(window), **{name: F.lag(c).over(window) for name, c in columns.items()}})
    # The last row of each range, and of those the last before each range: as many rows as there are ranges.
    last = ranges.groupBy("_part").agg(F.max(F.struct(*(F.col(c) for c in [*by, *order]), *(F.col(c).alias(f"_of_{name}") for name, c in columns.items()))).alias("_last"))
    before = last.select("_part", F.lag("_last").over(W.orderBy("_part")).alias("_first"))
    same = F.col("_first").isNotNull()
    for c in by:
        same = same & F.col(f"_first.{c}").eqNullSafe(F.col(c))
    carried = (F.col("_seen") == 1) & same
    out = inner.join(F.broadcast(before), "_part")
    return out.withColumns({name: F.when(carried, F.col(f"_first._of_{name}")).otherwise(F.col(name)) for name in columns}).drop(*MARKS)


def ranked(df: DataFrame, order: dict[str, str], by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """df with each row's place in the whole order of its group, from 1: no task sorts or counts more than a range.

    order gives sort columns as SQL expressions, each with "asc" or "desc"; nulls come last either way. Rows that tie on all of them have
    different places in no certain order, so the last column is usually an id. Without by, the table is one group; null groups are groups.
    """
    keys = {f"_k{i}": (F.expr(c), way) for i, (c, way) in enumerate(order.items())}
    sort = [F.asc_nulls_last(k) if way == "asc" else F.desc_nulls_last(k) for k, (_, way) in keys.items()]
    ranges = _ranged(df.withColumns({k: c for k, (c, _) in keys.items()}), [*by, *sort])
    counts = ranges.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_of"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), (F.sum("_n").over(W.partitionBy(*by).orderBy("_part")) - F.col("_n")).alias("_first"))  # a row for each range and group in it
    inner = ranges.withColumn("_seen", F.row_number().over(W.partitionBy("_part", *by).orderBy(*sort)))
    same = [F.col("_part") == F.col("_of"), *(F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by))]
    out = inner.join(before, same).withColumn(name, F.col("_first") + F.col("_seen"))
    return out.drop(*MARKS, *keys, "_of", *(f"_by{i}" for i in range(len(by))))


def out_of_order(df: DataFrame, by: list[str], position: str, key: str) -> DataFrame:
    """The rows whose key is below the one at the position before, with `before`, wherever in the collection they stand.

    Keys at one position count as falling, so that a position that is used twice is a break.
    """
    own = df.withColumn("_down", F.lit(0) - F.col(key)) if dict(df.dtypes)[key] not in ("string",) else df.withColumn("_down", F.col(key))
    return lagged(own, by, [position, "_down"], before=key).where(F.col("before") > F.col(key)).drop("_down")


def last_known(df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """(by, order, known): the last value of column that isn't null, up to and with each row, in rising order within its group."""
    ranges = _ranged(df.select(*by, *order, column), [*by, *order])
    window = W.partitionBy("_part", *by).orderBy(*order)
    inner = ranges.withColumn("_seen", F.last(column, True).over(window))
    place = F.struct(*(F.col(c) for c in order))
    own = ranges.where(F.col(column).isNotNull()).groupBy("_part", *by).agg(F.max_by(column, place).alias("_last"))  # a row for each range and group in it
    every = ranges.select("_part", *by).distinct().join(own, ["_part", *by], "left")
    before = every.select("_part", *by, F.last("_last", True).over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_first"))
    return inner.join(before, ["_part", *by]).select(*by, *order, F.coalesce("_seen", "_first").alias("known"))
