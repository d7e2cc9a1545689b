"""Sets compared by fingerprints that don't depend on order: no set is collected, sorted or joined with another.

A set's fingerprint is its size, the sum of one hash of its members and the exclusive or of another. Equal sets have equal fingerprints; sets that
differ in one member never do, and others only if a sum of 28 bits and 60 further bits agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashes(member: Column) -> tuple[Column, Column]:
    digest = F.md5(member.cast("string").cast("binary"))
    part = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("long")
    return part(1, 7), part(8, 15)


def hashes_sql(member: str) -> tuple[str, str]:
    part = lambda at, n: f"CAST(concat('0x', substr(md5(CAST({member} AS VARCHAR)), {at}, {n})) AS BIGINT)"
    return part(1, 7), part(8, 15)


def fingerprints(sets: DataFrame, by: list[str], member: str) -> DataFrame:
    """(by, members, hash_sum, hash_xor) of each set; a member counts as often as it is there, a null one not at all."""
    first, second = hashes(F.col(member))
    return sets.where(F.col(member).isNotNull()).groupBy(*by).agg(F.count("*").alias("members"), F.sum(first).alias("hash_sum"), F.bit_xor(second).alias("hash_xor"))


def fingerprints_sql(source: str, by: str, member: str) -> str:
    first, second = hashes_sql(member)
    return f"SELECT {by}, count(*) AS members, CAST(sum({first}) AS BIGINT) AS hash_sum, bit_xor({second}) AS hash_xor FROM {source} WHERE {member} IS NOT NULL GROUP BY ALL"


def agreement(prints: DataFrame, by: list[str], consumer: str, consumers: tuple[str, ...]) -> DataFrame:
    """(by, distinct, missing, agree): whether all consumers have the same set in each group; one without a row has the empty set."""
    own = F.struct("members", "hash_sum", "hash_xor")
    out = prints.groupBy(*by).agg(F.countDistinct(own).alias("distinct_sets"), (F.lit(len(consumers)) - F.countDistinct(consumer)).cast("long").alias("missing"))
    return out.withColumn("agree", (F.col("distinct_sets") == 1) & (F.col("missing") == 0))
