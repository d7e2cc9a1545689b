"""Files: strict CSV and JSON scans, GeoJSON features, digests of binary files, and stable sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_csv(spark: SparkSession, path: str, columns: list[str], required: bool = False) -> DataFrame:
    """Text columns of a CSV with a header; quotes may hold line ends, and a ragged row or an open quote is an error."""
    if len(set(columns)) < len(columns):
        raise ValueError("a header names a column twice")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)
    if required and df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of JSON documents, arrays or objects; a document that doesn't fit is an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def webp_size(content: Column) -> Column:
    """Struct of width and height from the head of a lossy WebP image; null for any other content."""
    byte = lambda i: F.conv(F.hex(F.substring(content, i + 1, 1)), 16, 10).cast("int")
    length = byte(4) + byte(5) * 256 + byte(6) * 65536 + byte(7) * 16777216 + 8
    sound = (F.octet_length(content) >= 30) & (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 8)) == "5745425056503820") & (length == F.octet_length(content)) & (F.hex(F.substring(content, 24, 3)) == "9D012A")
    size = lambda i: (byte(i) + byte(i + 1) * 256).bitwiseAND(0x3FFF)
    return F.when(sound, F.struct(size(26).alias("width"), size(28).alias("height")))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(files: DataFrame, expected: DataFrame) -> DataFrame:
    """valid, missing or hash_mismatch for each expected (name, sha256)."""
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("is"))
    status = F.when(F.col("is").isNull(), "missing").when(F.col("is") == F.col("sha256"), "valid").otherwise("hash_mismatch")
    return expected.join(found, "name", "left").select("name", status.alias("status"))


def payload(df: DataFrame, *order: str) -> Column:
    """A row as JSON with its keys in alphabetical order."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def sink_json(df: DataFrame, path: str, *order: str, inputs: tuple[str, ...] = ()) -> None:
    """Lines of stable JSON, range-ordered over the files; the output may not be an input."""
    if path.rstrip("/") in {p.rstrip("/") for p in inputs}:
        raise ValueError("the output would overwrite an input")
    df.orderBy(*order).select(payload(df).alias("value")).write.mode("overwrite").text(path)
