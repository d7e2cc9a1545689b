"""Checks of records against each other: each gives the rows that break a rule, with the rule's code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of quality that never enter a benchmark.
BAD_QUALITY = ("conflict", "insufficient", "restricted")


def broken(df: DataFrame, key: str, **rules: str) -> DataFrame:
    """(key, code) of every rule, a condition in SQL, that a row breaks; one pass for all rules."""
    codes = F.array_compact(F.array(*(F.when(F.expr(condition), F.lit(code)) for code, condition in rules.items())))
    return df.select(key, F.explode(codes).alias("code"))


def broken_sql(key: str, source: str, **rules: str) -> str:
    """The same rows as SQL over a table or common table expression."""
    return " UNION ALL ".join(f"SELECT {key}, '{code}' AS code FROM {source} WHERE {condition}" for code, condition in rules.items())


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str, collection: str) -> DataFrame:
    """(collection, field, id, n) of references of child that no row of parent has; the keys alone are shuffled, counted first."""
    own = child.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("id")).agg(F.count("*").alias("n"))
    missing = own.join(parent.select(F.col(key).cast("long").alias("id")), "id", "left_anti")
    return missing.select(F.lit(collection).alias("collection"), F.lit(column).alias("field"), "id", "n")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def compatible(a: str, b: str) -> Column:
    """Whether two facts, structs named a and b, may be compared: type, unit and currency agree, nulls with nulls, and priced ones have one price type."""
    same = F.col(f"{a}.semantic_type").eqNullSafe(F.col(f"{b}.semantic_type")) & F.col(f"{a}.unit").eqNullSafe(F.col(f"{b}.unit")) & F.col(f"{a}.currency").eqNullSafe(F.col(f"{b}.currency"))
    priced = F.col(f"{a}.semantic_type").isin("price", "price_per_m2")
    return same & (~priced | F.coalesce(F.col(f"{a}.price_type") == F.col(f"{b}.price_type"), F.lit(False)))


def rollup(statuses: Column) -> Column:
    """The worst of an array of states of quality: conflict, restricted, reviewable, insufficient, else certified."""
    return F.when(F.array_contains(statuses, "conflict"), "conflict").when(F.array_contains(statuses, "restricted"), "restricted").when(F.array_contains(statuses, "reviewable"), "reviewable").when(F.size(statuses) == 0, "insufficient").otherwise("certified")
