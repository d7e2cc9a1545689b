"""Answers made of a district's context: fixed blocks, each with the items that the question's intent calls for."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The blocks of an answer, in order.
BLOCKS = ("answer", "data", "interpretation", "limitations", "references", "next_step")


class Item(NamedTuple):
    """An item of an answer to intent: it is there if when holds, and says value; both are SQL over a context's columns."""

    intent: str
    block: str
    item: str
    value: str
    when: str = "true"


def answered(questions: DataFrame, contexts: DataFrame, key: str, items: tuple[Item, ...]) -> DataFrame:
    """(questions' columns, position, block, item, value): the items of each question's intent, from its context, in the order of the blocks.

    A question whose context isn't there has the items whose condition doesn't need one; contexts are one row each, so many questions of one
    context meet one row. Items are few: they are an array in the row until they are exploded. A null value is empty text.
    """
    joined = questions.join(contexts.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    rank = {b: i for i, b in enumerate(BLOCKS)}
    ordered = sorted(items, key=lambda x: rank[x.block])
    made = F.array_compact(F.array(*(F.when((F.col("intent") == x.intent) & F.expr(f"coalesce({x.when}, false)"), F.struct(F.lit(x.block).alias("block"), F.lit(x.item).alias("item"), F.expr(f"coalesce(CAST({x.value} AS STRING), '')").alias("value"))) for x in ordered)))
    return joined.select(*questions.columns, F.posexplode(made).alias("position", "entry")).select(*questions.columns, "position", "entry.block", "entry.item", "entry.value")


def answered_sql(questions: str, contexts: str, key: str, items: tuple[Item, ...]) -> str:
    rank = {b: i for i, b in enumerate(BLOCKS)}
    ordered = sorted(items, key=lambda x: rank[x.block])
    rows = " UNION ALL ".join(f"SELECT q.*, {n} AS nth, '{x.block}' AS block, '{x.item}' AS item, coalesce(CAST({x.value} AS VARCHAR), '') AS value FROM {questions} q LEFT JOIN {contexts} c ON c.{key} = q.{key} WHERE intent = '{x.intent}' AND coalesce({x.when}, false)" for n, x in enumerate(ordered))
    return f"answers AS ({rows})"
