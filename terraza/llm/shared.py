"""Tables that outlive the executor that wrote them, and the rules by which labelled rows are drawn."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.sources.scratch import folder, written  # noqa: F401  the operators take them from here


def release() -> None:
    """Gives back to the system what Arrow keeps of tables that the driver no longer needs."""
    pa.default_memory_pool().release_unused()


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most per_class labelled documents of each class outside the held-out fold.

    Ids are taken in the order of a hash, so the draw is the same on every cluster. A document with several label rows
    has the largest; rows without an id or a label don't count.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", folds) != held_out))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])


def bounded(rows: DataFrame, lists: str, most: int) -> DataFrame:
    """The rows (doc_id, ...) of a bounded sample whose lists come to at most so many elements, in the order of a hash of the id."""
    sizes = rows.select("doc_id", F.size(lists).alias("size"), F.xxhash64("doc_id").alias("h"))
    kept = sizes.withColumn("sum", F.sum("size").over(W.orderBy("h", "doc_id"))).where(F.col("sum") <= most).select("doc_id")
    return rows.join(F.broadcast(kept), "doc_id", "left_semi")
