"""Coverage reports: how many records of each collection have each value of the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, collection: str, *sections: str) -> DataFrame:
    """(collection, section, key, n): one scan for all sections, counted before the shuffle; a null is the key none, and section total counts all rows.

    An empty collection has no rows. Two columns may share values: sections are kept apart.
    """
    rows = [F.struct(F.lit("total").alias("section"), F.lit("all").alias("key")), *(F.struct(F.lit(c).alias("section"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("key")) for c in sections)]
    own = df.select(F.inline(F.array(*rows))).groupBy("section", "key").agg(F.count("*").alias("n"))
    return own.select(F.lit(collection).alias("collection"), "section", "key", "n")


def counts_sql(source: str, *sections: str) -> str:
    each = [f"SELECT '{source}' AS collection, 'total' AS section, 'all' AS key, count(*) AS n FROM {source} HAVING count(*) > 0"]
    return " UNION ALL ".join(each + [f"SELECT '{source}', '{c}', coalesce(CAST({c} AS VARCHAR), 'none'), count(*) FROM {source} GROUP BY 3" for c in sections])
