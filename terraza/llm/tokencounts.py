"""Token counts of flat token files that hold documents end to end, each closed by a separator id, with no index.

A file is read as blocks of bytes. In a block, separators are found with one vectorised search; what a block cannot know, the
length of the document that is open at its start and how many documents came before, follows from a prefix scan over the
blocks' summaries: the running count of ids and of separators, and the last separator so far.
"""

from __future__ import annotations

from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import written
from .tokens import Encoder

BLOCK = 1 << 18  #: bytes of a block; a multiple of an id's
SPAN = 64 << 20  #: bytes of a long file that a task reads at a time
WHOLE = (1 << 31) - 1  #: bytes that Spark can read as one value
SEPARATOR = 50256  #: closes a document; never inside one, as texts are encoded with special tokens spelt out
KIND = "<u2"


def _opened(path: str):
    """A file under Spark's name for it, whose characters are not escaped."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, own = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(own)


def read_files(spark: SparkSession, path: str, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(file, block, data) of flat files under path, of any size.

    Tasks read ranges of about span bytes of a long file, so many share it: of those over span in mounted folders and over 2 GB elsewhere,
    where pyarrow must know the store. Others are read whole by Spark.
    """
    files, step = spark.read.format("binaryFile").load(path), max(1, span // block) * block
    any_file = files.select("path").first()
    longest = span if any_file and any_file["path"].startswith("file:") else WHOLE
    ranges = files.where(F.col("length") > longest).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("start"))

    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                whole = content.as_buffer()
                for i in range(0, max(1, whole.size), block):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // block], pa.int64()), pa.array([whole[i : i + block].to_pybytes()])], ["file", "block", "data"])

    def ranged(batches):
        for batch in batches:
            for name, length, start in zip(*(batch.column(x).to_pylist() for x in ("path", "length", "start")), strict=True):
                with _opened(name) as file:
                    file.seek(start)
                    for i in range(start, min(start + step, length), block):
                        data = file.read(min(block, length - i))
                        if len(data) != min(block, length - i):
                            raise OSError(f"{name} has become shorter than {length} bytes")
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // block], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    kind = "file string, block long, data binary"
    short = files.where(F.col("length") <= longest).select("path", "content").mapInArrow(cut, kind)
    return short.unionByName(ranges.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(ranged, kind))


def token_files(docs: DataFrame, tokenizer: str, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """(file, block, data, doc_ids): each task's documents as one flat file, cut into blocks wherever they fill.

    doc_ids, on a file's last block alone or where many have gathered, lists the documents in the file's order so that counts can be named; counting
    doesn't read it.
    """

    def packed(batches):
        encoder, name, n, held, size, names = Encoder.of(tokenizer, spelt=True), f"part-{TaskContext.get().partitionId():06d}", 0, [], 0, []

        def cut(whole: bool):
            nonlocal n, size
            data = np.concatenate(held).tobytes() if held else b""
            stop = len(data) if whole else len(data) // block * block
            held[:] = [np.frombuffer(data[stop:], KIND)]
            size = len(data) - stop
            pieces = [data[i : min(i + block, stop)] for i in range(0, stop, block)]
            if pieces:
                lists = [[] for _ in pieces]
                lists[-1] = names[:]
                names.clear()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pieces)), pa.array(range(n, n + len(pieces)), pa.int64()), pa.array(pieces, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["file", "block", "data", "doc_ids"])
                n += len(pieces)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for c in tk.chunks(batch.column("text")):
                flat, offs = encoder.ids(c)
                held.append(np.insert(flat, offs[1:], separator).astype(KIND))
                size += held[-1].nbytes
                names += ids[c.row : c.row + len(c)]
                if size >= block:
                    yield from cut(False)
        yield from cut(True)

    return docs.select("doc_id", "text").mapInArrow(packed, "file string, block long, data binary, doc_ids array<long>")


def count(blocks: DataFrame, separator: int = SEPARATOR, kind: str = KIND) -> DataFrame:
    """(file, nth, n_tokens): the ids of each document before its separator, in the file's order from 0.

    Ids after a file's last separator are an unclosed document of their own; an empty file has none.
    """

    def summed(batches):
        for batch in batches:
            rows = []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer(), kind) if data.is_valid and data.as_buffer().size else np.zeros(0, kind)
                ends = np.flatnonzero(ids == separator)
                rows.append((len(ids), len(ends), int(ends[0]) if len(ends) else None, int(ends[-1]) if len(ends) else None, (np.diff(ends) - 1).tolist()))
            columns = list(zip(*rows, strict=True))
            kinds = (*[pa.int64()] * 4, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["file", "block", "n", "ends", "first", "last", "inner"])

    parts = blocks.select("file", "block", "data").mapInArrow(summed, "file string, block long, n long, ends long, first long, last long, inner array<long>")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("nth", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    parts = parts.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last")).over(before), F.lit(-1)))
    closed = parts.where("ends > 0").select("file", F.col("nth").alias("start"), F.concat(F.array(F.col("base") + F.col("first") - F.col("open") - 1), "inner").alias("sizes"))
    closed = closed.select("file", "start", F.posexplode("sizes").alias("i", "n_tokens")).select("file", (F.col("start") + F.col("i")).alias("nth"), "n_tokens")
    rest = parts.groupBy("file").agg(F.sum("ends").alias("nth"), (F.sum("n") - 1 - F.coalesce(F.max(F.col("base") + F.col("last")), F.lit(-1))).alias("n_tokens"))
    return closed.unionByName(rest.where("n_tokens > 0"))


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, file, nth of every row of docs, counted in the flat files that its documents are written to.

    A null text is an empty one and counts 0. Repeated ids keep a row each. An empty table gives no rows.
    """
    import public_tokenizers

    files = written(token_files(docs, public_tokenizers.path("byte_bpe_50k.json")), "tokens")
    names = files.where(F.size("doc_ids") > 0).select("file", "block", "doc_ids")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    names = names.withColumn("start", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)))
    names = names.select("file", "start", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("start") + F.col("i")).alias("nth"), "doc_id")
    return names.join(count(files), ["file", "nth"]).select("doc_id", "n_tokens", "file", "nth")
