"""GeoJSON collections of any size: read by many tasks from one file, and written as the same bytes every time.

A collection is one JSON document, so a task that begins in the middle of it knows neither whether it is inside a string nor how deep. Spark's text
reader cuts a file into pieces at closing braces and its own byte ranges. A first pass over every range counts its quotes and brackets, for either
case; composed in order, a row a range, they tell where each range begins. A second pass then cuts the features out: those that lie in one range
as they are, those that ranges share as fragments, which are put together by the range that their feature begins in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraza.operators import ordered
from terraza.sources.scratch import written

FEATURE = "properties struct<relation: string, name: string>, type string, geometry struct<type: string, coordinates: string>"
DEPTH = 2  #: of the array that features stand in: the document is the first, the array the second


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte is a quote that opens or closes a string, and what it does to the depth if it stands outside one."""
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != 0x5C, at, -1))  # the last byte up to each that is no backslash
    before = np.concatenate([[-1], plain[:-1]])
    quote = (data == 0x22) & ((at - 1 - before) % 2 == 0)
    step = np.isin(data, (0x7B, 0x5B)).astype(np.int64) - np.isin(data, (0x7D, 0x5D))
    return quote, step


def _pieces(batch: pa.RecordBatch):
    """(row, file, start, bytes) of each run of pieces of one range, with the brace that the reader cut at put back behind each."""
    files, starts = batch.column("file").to_pylist(), batch.column("start").to_numpy()
    text, i = batch.column("value").to_pylist(), 0
    while i < len(text):
        j = i
        while j < len(text) and files[j] == files[i] and starts[j] == starts[i]:
            j += 1
        yield i, files[i], int(starts[i]), np.frombuffer(("}".join(text[i:j]) + "}").encode(), np.uint8)
        i = j


def _ranges(batches):
    """Of each range: whether its quotes are odd, and how much deeper it ends if it begins outside a string, and if inside one."""
    held: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for _, file, start, data in _pieces(batch):
            own = held.setdefault((file, start), [0, 0, 0])
            quote, step = _marks(data)
            inside = (np.cumsum(quote) - quote) % 2 == 1  # before each byte, if the run begins outside
            out, other = int(step[~inside].sum()), int(step[inside].sum())
            if own[0]:  # the range's quotes are odd so far, so the two cases have changed places
                out, other = other, out
            own[1] += out
            own[2] += other
            own[0] = (own[0] + int(quote.sum())) % 2
    if held:
        columns = [[k[0] for k in held], [k[1] for k in held], *zip(*held.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["file", "start", "odd", "outside", "inside"])


def _cut(batches):
    """(file, start, nth, whole, opens, text): features that lie in a range, and the fragments of those that don't."""
    state: dict[tuple[str, int], list] = {}
    for batch in batches:
        inside0, depth0 = batch.column("in_string").to_numpy(), batch.column("depth").to_numpy()
        rows = []
        for at, file, start, data in _pieces(batch):
            if (file, start) not in state:
                state[(file, start)] = [int(inside0[at]), int(depth0[at]), 0, b"", False]
            own = state[(file, start)]
            quote, step = _marks(data)
            inside = (np.cumsum(quote) - quote + own[0]) % 2 == 1
            depth = own[1] + np.cumsum(np.where(inside, 0, step))
            opened = np.flatnonzero(~inside & (data == 0x7B) & (depth == DEPTH + 1)).tolist()
            closed = np.flatnonzero(~inside & (data == 0x7D) & (depth == DEPTH)).tolist()
            raw, i = data.tobytes(), 0
            if own[1] > DEPTH:  # the run begins within a feature
                end = closed[0] + 1 if closed else len(raw)
                own[3] += raw[:end]
                if closed:
                    rows.append((file, start, own[2], own[4], own[4], own[3]))
                    own[2], own[3], i = own[2] + 1, b"", 1
            for a in opened:
                if i < len(closed):
                    rows.append((file, start, own[2], True, True, raw[a : closed[i] + 1]))
                    own[2], i = own[2] + 1, i + 1
                else:
                    own[3] = raw[a:]
                own[4] = True
            own[0], own[1] = (own[0] + int(quote.sum())) % 2, int(depth[-1])
        yield _rows(rows)
    yield _rows([(file, start, n, False, opens, text) for (file, start), (_, _, n, text, opens) in state.items() if text])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "start": pa.int64(), "nth": pa.int64(), "whole": pa.bool_(), "opens": pa.bool_(), "text": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def features(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature as JSON) of every feature of the collections at path, wherever the reader's byte ranges cut them.

    A feature has any size up to what a row may have. What else stands at a feature's depth comes along: the caller tells by its type.
    """
    text = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ranges = written(text.mapInArrow(_ranges, "file string, start long, odd long, outside long, inside long"), "ranges")
    # A row for each range, composed in order: first the strings, then the depths that follow from them.
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    told = ranges.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    told = told.withColumn("gain", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    told = told.select("file", "start", "in_string", F.coalesce(F.sum("gain").over(before), F.lit(0)).alias("depth"))
    # The pieces must stay in order, so what is told is always sent to all tasks: a row for each range of 128 MB, 800,000 rows for 100 TB.
    cut = written(text.join(F.broadcast(told), ["file", "start"]).mapInArrow(_cut, "file string, start long, nth long, whole boolean, opens boolean, text binary"), "features")
    parts = cut.where("not whole")
    heads = ordered.last_known(parts.select("file", "start", "nth", F.when(F.col("opens") & (F.col("nth") >= 0), F.col("start")).alias("head")), ["file"], ["start", "nth"], "head")
    joined = parts.join(heads.withColumnRenamed("known", "begins"), ["file", "start", "nth"])
    whole = joined.groupBy("file", "begins").agg(F.array_sort(F.collect_list(F.struct("start", "nth", "text"))).alias("p")).select("file", F.concat_ws("", F.transform("p", lambda p: F.decode(p["text"], "UTF-8"))).alias("feature"))
    return cut.where("whole").select("file", F.decode("text", "UTF-8").alias("feature")).unionByName(whole)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(relation, name, kind, coordinates as JSON) of polygon features, one row each; a relation that occurs twice is an error."""
    own = features(spark, path).select(F.from_json("feature", FEATURE).alias("f")).where("f.type = 'Feature'")
    own = written(own.select("f.properties.relation", "f.properties.name", F.col("f.geometry.type").alias("kind"), "f.geometry.coordinates").where(F.col("kind").isin("Polygon", "MultiPolygon")), "polygons")
    twice = own.where("relation is not null").groupBy("relation").count().where("count > 1").first()
    if twice:
        raise ValueError(f"relation {twice['relation']} occurs {twice['count']} times")
    return own


HEAD, FOOT = '{"features":[', '],"type":"FeatureCollection"}'


def _in_order(rows: DataFrame, feature: str, key: str) -> DataFrame:
    padded = F.lpad(F.col(key).cast("string"), 20, "0")
    return ordered.ranked(rows.select(padded.alias("key"), F.col(feature).alias("feature")), {"key": "asc", "feature": "asc"})


def sink(rows: DataFrame, path: str, feature: str = "feature", key: str = "relation") -> None:
    """One collection, over the files of a folder: their bytes in the files' order are the same for the same rows, whatever the partitions.

    feature is JSON text with its keys in order; features stand in the order of the padded key, numbers as numbers, rows with one key in that of their text.
    """
    lines = _in_order(rows, feature, key).select("rank", F.concat(F.when(F.col("rank") == 1, "").otherwise(","), "feature").alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, HEAD), (1 << 62, FOOT)], "rank long, value string")
    lines.unionByName(ends).orderBy("rank").select("value").write.text(path)


def sink_many(rows: DataFrame, path: str, each: int = 1_000_000, feature: str = "feature", key: str = "relation") -> None:
    """Collections of that many features, one file each, in the order of sink; every file is a document of its own."""
    own = _in_order(rows, feature, key).withColumn("nth", F.floor((F.col("rank") - 1) / each))
    place = W.partitionBy("nth")
    first, last = F.col("rank") % each == F.lit(1 % each), F.col("rank") == F.max("rank").over(place)
    value = F.concat(F.when(first, HEAD).otherwise(","), "feature", F.when(last, FOOT).otherwise(""))
    own.select("nth", "rank", value.alias("value")).repartition("nth").sortWithinPartitions("nth", "rank").select("nth", "value").write.partitionBy("nth").text(path)
