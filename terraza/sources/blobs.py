"""Files with any content, one for each row: a data source that writes them, and the scan that holds them against a manifest.

Each task writes its rows' files under a name of its own and renames them, so a task that is run again, or lost, leaves no half file. The store is any
that Arrow's file systems know, by its address. Tasks list folders and read the files that rows name, so the driver holds no list of files,
and files are dealt to tasks by rows: Spark's own reader takes a task for every 32 small files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from terraza.sources.scratch import apart, written

NAME = "[A-Za-z0-9_-][A-Za-z0-9._-]*"  #: of a file or folder: no hidden ones, no steps up
SOUND_PATH = f"^{NAME}(/{NAME})*$"
WAVES = 4  #: tasks for each core: small tables of many files are few partitions
BATCH = 16 << 20  #: bytes from which files that were read are passed on


def _store(address: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)
    return store, root.rstrip("/")


def _tasks(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism * WAVES


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class BlobWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        files, size, made = 0, 0, set()
        for row in iterator:
            to = f"{root}/{row['path']}"
            folder = to.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(bytes(row["content"]))
            store.move(draft, to)
            files, size = files + 1, size + len(row["content"])
        return Written(files, size)

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(b"")

    def abort(self, messages: list) -> None:
        """Whole files may stay; without _SUCCESS the folder is not complete."""


class Blobs(DataSource):
    """(path, content): content goes to the file at path, below the folder that is saved to."""

    @classmethod
    def name(cls) -> str:
        return "terraza_blobs"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options["path"])


def write(rows: DataFrame, path: str) -> None:
    """Each row's content as a file; a path that is not plain, or that occurs twice, is an error, and nothing is written then."""
    own = rows.select("path", "content")
    bad = own.where(F.col("path").isNull() | ~F.rlike("path", F.lit(SOUND_PATH))).select("path").first()
    twice = own.groupBy("path").count().where("count > 1").first()
    if bad or twice:
        raise ValueError(f"no file can be written at {bad['path']}" if bad else f"{twice['path']} occurs {twice['count']} times")
    rows.sparkSession.dataSource.register(Blobs)
    own.select("path", F.coalesce("content", F.lit(b"")).alias("content")).repartition(_tasks(rows.sparkSession), "path").write.format("terraza_blobs").mode("append").save(path)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every file below root, from there; those with a name that begins with a dot or an underscore, and what is in such folders, left out.

    Tasks list folders, level by level; the names in one folder are held by one task.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [x for x in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))) if x.base_name[0] not in "._"]
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{x.base_name}".lstrip("/") for x in some], "folder": [x.type == fs.FileType.Directory for x in some]})

    folders, out = spark.createDataFrame([("",)], "path string"), None
    while not folders.isEmpty():
        found = written(folders.repartition(_tasks(spark), "path").mapInArrow(listed, "path string, folder boolean"), "listing")
        files, folders = found.where("not folder").select("path"), found.where("folder").select("path")
        out = files if out is None else out.unionByName(files)
    return out


def contents(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) of the files at paths below root, each once; those that are not there, and empty ones, have no row. Whoever names them sees to it that they lead nowhere else."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            names = batch.column(0).to_pylist()
            held, size = [], 0
            for name, info in zip(names, store.get_file_info([f"{base}/{x}" for x in names]) if names else (), strict=True):
                if info.type != fs.FileType.File or not info.size:
                    continue
                with store.open_input_stream(info.path) as file:
                    held.append((name, file.read()))
                size += info.size
                if size >= BATCH:
                    yield pa.RecordBatch.from_pydict({"path": pa.array([x[0] for x in held], pa.string()), "content": pa.array([x[1] for x in held], pa.binary())})
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pydict({"path": pa.array([x[0] for x in held], pa.string()), "content": pa.array([x[1] for x in held], pa.binary())})

    own = paths.select("path").repartition(_tasks(paths.sparkSession), "path").distinct()
    return own.mapInArrow(read, "path string, content binary")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(document, path, sha256, format, path_ok, repeated) of every asset that the manifests at path list: JSON lines, each with an array `assets`.

    path_ok: the path is a plain one below assets/; repeated: another entry, of any document, has the same one. Entries are counted by path before
    they are joined, so a path that a third of them share is one row there.
    """
    entry = "struct<path: string, sha256: string, format: string>"
    own = spark.read.schema(f"document string, assets array<{entry}>").json(path, mode="FAILFAST").select("document", F.inline("assets"))
    copies = own.groupBy(F.col("path").alias("_of")).agg((F.count("*") > 1).alias("repeated"))
    ok = F.rlike("path", F.lit(SOUND_PATH)) & F.startswith("path", F.lit("assets/"))
    return own.join(apart(copies), F.col("path").eqNullSafe(F.col("_of"))).select("document", "path", "sha256", "format", F.coalesce(ok, F.lit(False)).alias("path_ok"), "repeated")


def plain(content: Column) -> Column:
    """Content as it is hashed: one line end at the close of a text doesn't count."""
    return F.when(F.hex(F.substring(content, -1, 1)) == "0A", F.substring(content, 1, F.octet_length(content) - 1)).otherwise(content)


def checked(entries: DataFrame, spark: SparkSession, root: str, webp_size) -> DataFrame:
    """entries with bytes, width, height and status of the file that each names below root.

    bad_path: not a plain path, nothing is read for it; missing: no such file; hash_mismatch: other bytes than those expected (of a text, without
    the closing line end); not_utf8: a text or JSON that is no UTF-8; parse_error: JSON that can't be parsed, or an image without a sound head;
    contract: JSON without a list of features; else valid. Empty files are missing. Each file is read once, however many entries name it, and entries join its digest, not its content.
    """
    held = contents(entries.where("path_ok"), root).withColumn("bytes", F.octet_length("content").cast("long"))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    parsed = F.try_parse_json(text)
    facts = held.select(
        "path", "bytes", F.sha2("content", 256).alias("as_is"), F.sha2(plain(F.col("content")), 256).alias("as_text"), text.isNotNull().alias("utf8"), parsed.isNotNull().alias("json"),
        F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(parsed, "$.features", "variant")), F.lit("ARRAY")), F.lit(False)).alias("contract"), webp_size(F.col("content")).alias("size"),
    )
    found = entries.join(apart(facts), "path", "left")
    image, is_json = F.col("format") == "webp", F.col("format") == "json"
    same = F.col("sha256") == F.when(image | is_json, F.col("as_is")).otherwise(F.col("as_text"))
    status = F.when(~F.col("path_ok"), "bad_path").when(F.col("bytes").isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "hash_mismatch").when(~image & ~F.col("utf8"), "not_utf8")
    status = status.when((is_json & ~F.col("json")) | (image & F.col("size").isNull()), "parse_error").when(is_json & ~F.col("contract"), "contract").otherwise("valid")
    there = F.when(F.col("path_ok"), F.col("bytes"))
    return found.select(*entries.columns, there.alias("bytes"), F.when(image & F.col("path_ok"), F.col("size.width")).alias("width"), F.when(image & F.col("path_ok"), F.col("size.height")).alias("height"), status.alias("status"))
