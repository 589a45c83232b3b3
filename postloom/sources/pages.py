"""Thread pages: from a folder of cached pages, or page by page from a paged HTTP service."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from postloom.functions.scalars import PAGE_POSTS, to_int
from postloom.operators.packs import author_key
from postloom.shipping import ship

POST = "lou string, pid string, postdate string, author struct<uid:string,username:string>, content string, attches array<struct<type:string,attachurl:string,url_utf8_org_name:string>>"
PAGE = f"code int, msg string, totalPage int, result array<struct<{POST.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>>, _corrupt string"


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Cached pages, one JSON document a file, with the page number from the file name; unreadable ones keep their text in _corrupt."""
    pages = spark.read.schema(PAGE).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(folder)
    return pages.withColumn("page", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).try_cast("int"))


def page_warnings(pages: DataFrame) -> DataFrame:
    bad = F.col("_corrupt").isNotNull() | F.coalesce(F.col("code") != 0, F.lit(False))
    return pages.where(bad).select(F.col("page").cast("long").alias("lou"), F.concat(F.lit("页面无法使用: "), F.coalesce("msg", F.lit("JSON"))).alias("message"))


def in_floors(pages: DataFrame, first: int, last: int | None) -> DataFrame:
    """Pages that can hold floors first..last; a filter on `page`, so a partitioned folder is pruned."""
    page = lambda lou: lou // PAGE_POSTS + 1
    out = pages.where(F.col("page") >= page(first))
    return out if last is None else out.where(F.col("page") <= max(page(first), page(last)))


def posts_of(pages: DataFrame) -> DataFrame:
    """One row for each post: ord, lou, pid, uid, username, postdate, content, attachments, author_key."""
    rows = pages.select("page", F.posexplode("result").alias("pos", "p")).where("p is not null")
    rows = rows.select(
        (F.col("page").cast("long") * 1000 + F.col("pos")).alias("ord"),
        to_int(F.col("p.lou")).alias("lou"),
        to_int(F.col("p.pid")).alias("pid"),
        to_int(F.col("p.author.uid")).alias("uid"),
        F.col("p.author.username").alias("username"),
        F.col("p.postdate").alias("postdate"),
        F.col("p.content").alias("content"),
        F.transform(F.coalesce("p.attches", F.array().cast("array<struct<type:string,attachurl:string,url_utf8_org_name:string>>")), lambda a: F.struct(a["type"].alias("type"), a["attachurl"].alias("attachurl"), a["url_utf8_org_name"].alias("name"))).alias("attachments"),
    )
    return rows.withColumn("author_key", author_key())


def rule_post(posts: DataFrame, lou: int) -> DataFrame:
    """The first post of that floor; fails where there is none."""
    found = posts.where(F.col("lou") == lou).orderBy("ord").limit(1)
    if found.isEmpty():
        raise LookupError(f"no post on floor {lou}")
    return found


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Threads in order: ord, thread_name, tid, aid, description; none where there is no such file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "ord int, thread_name string, tid long, aid long, description string")
    rows = spark.read.schema("ThreadList array<struct<thread_name:string,tid:long,aid:long,description:string>>").json(path, multiLine=True)
    return rows.select(F.posexplode("ThreadList").alias("ord", "t")).select("ord", "t.*")


def thread_of(catalog: DataFrame, name: str) -> tuple[int | None, int | None]:
    """(tid, aid) of the first thread of that name; fails where there is none."""
    found = catalog.where(F.col("thread_name") == name).orderBy("ord").head()
    if found is None:
        raise LookupError(f"no thread is called {name}")
    return found.tid, found.aid


def new_threads(catalog: DataFrame, more: DataFrame) -> DataFrame:
    """Catalog with the threads that are not in it yet, told by tid and aid (null equals null)."""
    same = (F.col("m.tid") == F.col("c.tid")) & F.col("m.aid").eqNullSafe(F.col("c.aid"))
    return catalog.unionByName(more.alias("m").join(catalog.alias("c"), same, "left_anti").select("m.*"), allowMissingColumns=True)


def images(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "length")


def html_parts(spark: SparkSession, folder: str) -> DataFrame:
    """HTML files of single floors; the floor is in the file name."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).try_cast("long").alias("lou"), F.col("value").alias("html"))
    return files.where("lou is not null")


class PageSource(DataSource):
    """`spark.read.format("forum_pages")` with options url, tid, authorid, first, last: one partition for each page.

    A filter on `page` decides which pages are asked for, as first and last do; all are clamped
    to the pages that the thread has. Such filters are pushed down where
    spark.sql.python.filterPushdown.enabled is on.
    """

    @classmethod
    def name(cls) -> str:
        return "forum_pages"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and its workers, and lets filters reach it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.first, self.last, self.only = max(1, int(options.get("first", 1))), int(options["last"]) if options.get("last") else None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("page",) or not self._take(f):
                yield f  # left to Spark

    def _take(self, f: Filter) -> bool:
        least = {GreaterThan: 1, GreaterThanOrEqual: 0}.get(type(f))
        most = {LessThan: 1, LessThanOrEqual: 0}.get(type(f))
        if least is not None:
            self.first = max(self.first, f.value + least)
        elif most is not None:
            self.last = min(x for x in (self.last, f.value - most) if x is not None)
        elif isinstance(f, (EqualTo, In)):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only = wanted if self.only is None else self.only & wanted
        else:
            return isinstance(f, IsNotNull)
        return True

    def _page(self, page: int) -> str:
        if page < 1:
            raise ValueError(f"page {page}: pages begin at 1")
        form = {"page": page, "tid": self.options["tid"]} | ({"authorid": self.options["authorid"]} if self.options.get("authorid") else {})
        with urllib.request.urlopen(self.options["url"], urllib.parse.urlencode(form).encode(), timeout=60) as reply:
            body = reply.read().decode()
        if json.loads(body).get("code") != 0:
            raise RuntimeError(f"page {page}: {json.loads(body).get('msg')}")
        return body

    def partitions(self) -> list[InputPartition]:
        if self.last is not None and self.last < self.first or self.only == set():
            return []
        total = int(json.loads(self._page(1)).get("totalPage") or 1)
        last = total if self.last is None else min(self.last, total)
        return [InputPartition(k) for k in range(self.first, last + 1) if self.only is None or k in self.only]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        yield partition.value, self._page(partition.value)


def parsed(pages: DataFrame, body: Column | None = None) -> DataFrame:
    """Pages as read_pages gives them, from (page, body)."""
    schema = PAGE.replace(", _corrupt string", "")
    return pages.select("page", F.from_json(F.col("body") if body is None else body, schema).alias("p")).select("p.*", "page", F.lit(None).cast("string").alias("_corrupt"))
