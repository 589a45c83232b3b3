"""A sink of one file for each row, with a manifest.

`df.write.format("thread_files").mode("append").save(folder)` takes rows of path (inside the
folder) and body. A file is written beside its place and then moved there, so none is ever
half written; what a task has written it lists in a part of the manifest, and the commit
writes down which parts there are. A failed write leaves the manifest as it was.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from postloom.shipping import ship

MANIFEST = "_manifest"


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def put(fs: pafs.FileSystem, root: str, path: str, body: bytes) -> None:
    """A whole file or none: written under another name, then moved."""
    target, beside = posixpath.join(root, path), posixpath.join(root, "_writing", uuid.uuid4().hex)
    fs.create_dir(posixpath.dirname(beside), recursive=True)
    fs.create_dir(posixpath.dirname(target), recursive=True)
    try:
        with fs.open_output_stream(beside) as out:
            out.write(body)
        fs.move(beside, target)
    except BaseException:
        if fs.get_file_info(beside).type != pafs.FileType.NotFound:
            fs.delete_file(beside)
        raise


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: the part of the manifest that lists it, how many files and bytes, and a digest of the list."""

    name: str
    files: int
    size: int
    digest: str


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "thread_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Part:
        fs, root = place(self.folder)
        listed, size = [], 0
        for row in rows:
            path = posixpath.normpath(row["path"])
            if path.startswith(("/", "..", "_")):
                raise ValueError(f"not a path inside the folder: {row['path']}")
            body = (row["body"] or "").encode()
            put(fs, root, path, body)
            size += len(body)
            listed.append(json.dumps({"path": path, "size": len(body), "sha256": hashlib.sha256(body).hexdigest()}, ensure_ascii=False))
        lines = "".join(f"{x}\n" for x in sorted(listed)).encode()
        name = f"part_{TaskContext.get().partitionId():06d}.jsonl"
        put(fs, root, f"{MANIFEST}/{name}", lines)
        return Part(name, len(listed), size, hashlib.sha256(lines).hexdigest())

    def commit(self, messages: list[Part]) -> None:
        parts = sorted((m for m in messages if m and m.files), key=lambda m: m.name)
        self._put("manifest.json", {"files": sum(m.files for m in parts), "size": sum(m.size for m in parts), "parts": [vars(m) for m in parts]})

    def abort(self, messages: list[Part]) -> None:
        """Files that are there are whole; the manifest still tells of the last write that was committed."""

    def _put(self, name: str, value: dict) -> None:
        fs, root = place(self.folder)
        put(fs, root, name, json.dumps(value, ensure_ascii=False, indent=1).encode())
        beside = posixpath.join(root, "_writing")
        if fs.get_file_info(beside).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(beside)):
            fs.delete_dir(beside)


def write_files(files: DataFrame, folder: str) -> None:
    """files: path, body. They are sorted by path, so that a rerun on the same rows gives the same manifest."""
    ship(files.sparkSession)
    files.sparkSession.dataSource.register(FileSink)
    files.select("path", "body").repartitionByRange("path").sortWithinPartitions("path").write.format("thread_files").mode("append").save(folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of the files of the last committed write."""
    fs, root = place(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as held:
        parts = [p["name"] for p in json.loads(held.read())["parts"]]
    schema = "path string, size long, sha256 string"
    return spark.read.schema(schema).json([f"{folder}/{MANIFEST}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def post_files(html: DataFrame) -> DataFrame:
    """(path, body): a file for each floor."""
    return html.select(F.format_string("post_%d.html", F.col("lou")).alias("path"), F.col("html").alias("body"))
