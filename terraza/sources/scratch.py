"""Tables in the shared folder that the cluster names, which outlive the executor that wrote them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all tasks run on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(spark.sparkContext, "_terraza_folder", None)
        if not found:
            found = spark.sparkContext._terraza_folder = tempfile.mkdtemp(prefix="spark-terraza-")
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and it is computed once."""
    to = path(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join by shuffles. Spark takes a Parquet table for as large as its compressed columns, so millions of ids may count as small and be broadcast through the driver."""
    return df.hint("merge")
