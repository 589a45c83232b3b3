"""A folder of cached pages that fills itself: pages that are missing, unreadable or wanted anew are fetched and replaced in one commit.

`pages_cache` is a Spark sink of (page, body) rows. Tasks write their pages beside the
cache; the commit moves them in, one file after another, each of them whole at any time. An
aborted or failed write leaves the cache as it was.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from postloom.operators.calls import Limits, called
from postloom.shipping import ship
from postloom.sources.pages import read_pages
from postloom.tables import keep, shared_folder

#: Answers after which a page is asked for again.
AGAIN = (429, 500, 502, 503, 504)


def asked_again(error: Exception) -> bool:
    return error.code in AGAIN if isinstance(error, urllib.error.HTTPError) else not isinstance(error, RuntimeError)


@dataclass
class Staged(WriterCommitMessage):
    """The pages that a task has written, as (name, staged name)."""

    files: list[tuple[str, str]]


class PageSink(DataSource):
    """`df.write.format("pages_cache").mode("append").save(folder)`: rows of page and body become files page_N.json."""

    @classmethod
    def name(cls) -> str:
        return "pages_cache"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PageWriter(self.options["path"], uuid.uuid4().hex)


class _PageWriter(DataSourceWriter):
    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder if "://" in folder else f"file://{folder}", job

    def _place(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.folder)

    def write(self, rows: Iterator) -> Staged:
        fs, root = self._place()
        stage = f"{root}/_staged/{self.job}/{uuid.uuid4().hex}"  # a folder of its own for every attempt
        fs.create_dir(stage, recursive=True)
        files = []
        for row in rows:
            name = f"page_{int(row['page'])}.json"
            with fs.open_output_stream(f"{stage}/{name}") as out:
                out.write(row["body"].encode())
            files.append((name, f"{stage}/{name}"))
        return Staged(files)

    def commit(self, messages: list[Staged]) -> None:
        fs, root = self._place()
        for message in messages:
            for name, staged in message.files if message else ():
                fs.move(staged, f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Staged]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = self._place()
        for folder in (f"{root}/_staged/{self.job}", f"{root}/_staged"):
            if fs.get_file_info(folder).type == pafs.FileType.Directory and (folder.endswith(self.job) or not fs.get_file_info(pafs.FileSelector(folder))):
                fs.delete_dir(folder)


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the cache; none where there is no folder or no page yet."""
    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    there = fs.get_file_info(root).type == pafs.FileType.Directory and any(f.is_file and f.base_name.startswith("page_") for f in fs.get_file_info(pafs.FileSelector(root)))
    pages = read_pages(spark, f"{folder}/page_*.json") if there else None
    return pages if pages is not None else spark.createDataFrame([], "code int, msg string, totalPage int, _corrupt string, page int")


def usable() -> Column:
    return F.col("_corrupt").isNull() & F.coalesce(F.col("code") == 0, F.lit(False))


def fetch(url: str, form: dict[str, str], seconds: float):
    """A call that gives the body of a page; what the service refuses is an error that is not tried again."""

    def page(number: int) -> str:
        sent = urllib.parse.urlencode(form | {"page": int(number)}).encode()
        with urllib.request.urlopen(url, sent, timeout=seconds) as reply:
            body = reply.read().decode()
        answer = json.loads(body)
        if answer.get("code") != 0:
            raise RuntimeError(f"{answer.get('msg')}")
        return body

    return page


def refreshed(spark: SparkSession, folder: str, url: str, form: dict[str, str], pages: DataFrame, force: bool = False, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages of the cache, warnings) after those of `pages` (page) that it lacks or cannot read, or all with `force`, have been fetched.

    A page that cannot be fetched leaves a warning (lou is the page, message) and what the cache had.
    """
    ship(spark)
    spark.dataSource.register(PageSink)
    limits = limits or Limits(at_once=10, seconds=60, retries=5, again=asked_again)
    wanted = pages.select("page").distinct()
    if not force:
        wanted = wanted.join(cached(spark, folder).where(usable()).select("page"), "page", "left_anti")
    found = keep(called(wanted, "page", fetch(url, form, limits.seconds), limits, "body"), f"{shared_folder(spark)}/fetched")
    found.where("body is not null").select("page", "body").write.format("pages_cache").mode("append").save(folder)
    failed = found.where("body is null").select(F.col("page").cast("long").alias("lou"), F.concat(F.lit("页面无法获取: "), "error").alias("message"))
    return cached(spark, folder).join(pages.select("page").distinct(), "page", "left_semi"), failed
