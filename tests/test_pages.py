"""Pages from a service and from a cache that fills itself; calls inside tasks."""

from __future__ import annotations

import http.server
import json
import threading
import time
import urllib.parse

import pytest
from pyspark.sql import functions as F

from postloom.operators.calls import Limits, called, calls
from postloom.plans import archive, tally, views
from postloom.sources import cache, files, pages, sinks


@pytest.fixture
def service():
    """Seven pages of one post each. Page 4 fails twice before it answers, page 6 always, page 7 is refused; asked: what was asked for."""
    asked: list[int] = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            page = int(form["page"][0])
            asked.append(page)
            down = page == 6 or page == 4 and asked.count(4) < 3
            self.send_response(503 if down else 200)
            self.end_headers()
            answer = {"code": 5 if page == 7 else 0, "msg": "no" if page == 7 else "", "totalPage": 7, "result": [{"lou": str(page * 20), "pid": str(page), "postdate": "2026-01-01 10:00", "author": {"uid": "1", "username": "u"}, "content": f"{form['tid'][0]} page {page}", "attches": []}]}
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()


def test_filters_decide_what_is_asked_for(spark, service):
    url, asked = service
    pages.register(spark)
    read = spark.read.format("forum_pages").options(url=url, tid="7").load()
    for condition, wanted in (("page = 3", [3]), ("page in (2, 5, 99)", [2, 5]), ("page > 1 and page <= 3", [2, 3]), ("page >= 2 and page < 3 and page is not null", [2]), ("page = 2 and page = 3", []), ("page between -4 and 1", [1])):
        asked.clear()
        got = sorted(r.page for r in read.where(condition).collect())
        assert got == wanted, condition
        # the first page says how many there are
        assert set(asked) <= {1, *wanted} and all(p in asked for p in wanted)
    asked.clear()
    assert [r.page for r in pages.in_floors(read, 45, 59).collect()] == [3]
    assert set(asked) == {1, 3}
    limited = spark.read.format("forum_pages").options(url=url, tid="7", first="2", last="3").load()
    assert sorted(r.page for r in limited.where("page % 2 = 1").collect()) == [3]


def test_cache_fills_itself(spark, service, tmp_path):
    url, asked = service
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "page_1.json").write_text(json.dumps({"code": 0, "msg": "", "totalPage": 7, "result": [{"lou": "20", "content": "old"}]}))
    (folder / "page_2.json").write_text("{broken")
    (folder / "page_5.json").write_text(json.dumps({"code": 9, "msg": "locked"}))
    wanted = spark.createDataFrame([(p,) for p in (1, 2, 3, 4, 5, 6, 7, 3)], "page int")
    limits = Limits(at_once=4, seconds=20, retries=3, backoff=0.01, again=cache.asked_again)
    found, failed = cache.refreshed(spark, str(folder), url, {"tid": "7"}, wanted, limits=limits)
    posts = {r.lou: r.content for r in pages.posts_of(found).collect()}
    assert posts == {20: "old", **{p * 20: f"7 page {p}" for p in (2, 3, 4, 5)}}
    assert {(r.lou, r.message.split(":")[0]) for r in failed.collect()} == {(6, "页面无法获取"), (7, "页面无法获取")}
    assert asked.count(1) == 0 and asked.count(3) == 1 and asked.count(4) == 3 and asked.count(6) == 4 and asked.count(7) == 1
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == [f"page_{n}.json" for n in range(1, 6)]
    asked.clear()
    again, failed = cache.refreshed(spark, str(folder), url, {"tid": "8"}, wanted.where("page < 3"), force=True, limits=limits)
    assert sorted(asked) == [1, 2]
    assert {r.content for r in pages.posts_of(again).collect()} == {"8 page 1", "8 page 2"}
    asked.clear()
    cache.refreshed(spark, str(folder), url, {"tid": "9"}, wanted.where("page < 6"), limits=limits)
    assert asked == []
    empty, _ = cache.refreshed(spark, str(tmp_path / "none"), url, {"tid": "9"}, wanted.where("page = 2"), limits=limits)
    assert [r.page for r in empty.collect()] == [2]


def test_failed_write_leaves_the_cache(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "page_1.json").write_text("one")
    spark.dataSource.register(cache.PageSink)
    rows = spark.range(1, 40, numPartitions=4).select(F.col("id").cast("int").alias("page"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise("two").alias("body"))
    with pytest.raises(Exception, match="stop"):
        rows.write.format("pages_cache").mode("append").save(str(folder))
    assert [(p.name, p.read_text()) for p in folder.iterdir()] == [("page_1.json", "one")]


def test_catalog_by_name(spark, tmp_path):
    missing = pages.read_catalog(spark, str(tmp_path / "none.json"))
    assert missing.count() == 0
    (tmp_path / "threads.json").write_text(json.dumps({"ThreadList": [{"thread_name": "t", "tid": 1, "aid": 5}, {"thread_name": "t", "tid": 2}, {"thread_name": "u", "tid": 3, "aid": None}]}))
    catalog = pages.read_catalog(spark, str(tmp_path / "threads.json"))
    assert pages.thread_of(catalog, "t") == (1, 5) and pages.thread_of(catalog, "u") == (3, None)
    with pytest.raises(LookupError):
        pages.thread_of(catalog, "v")


def test_calls():
    """Results in order, as many at a time as allowed, failures and late answers held to their own item."""
    running, most, lock = [0], [0], threading.Lock()

    def call(n):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep({3: 0.3, 5: 30}.get(n, 0.02))
        with lock:
            running[0] -= 1
        if n == 4:
            raise ValueError("four")
        return n * n

    began = time.monotonic()
    got = list(calls(range(40), call, Limits(at_once=8, seconds=1.0)))
    assert time.monotonic() - began < 3
    assert [r for r, _ in got] == [n * n if n not in (4, 5) else None for n in range(40)]
    assert got[4][1] == "ValueError: four" and got[5][1] == "no answer within 1 s"
    assert 4 <= most[0] <= 8
    assert list(calls([], call, Limits())) == []


def test_time_falls_with_calls_at_once():
    took = {}
    for at_once in (1, 10):
        began = time.monotonic()
        list(calls(range(20), lambda _: time.sleep(0.03), Limits(at_once=at_once)))
        took[at_once] = time.monotonic() - began
    assert took[10] < took[1] / 3


def test_retries():
    tries: dict[int, int] = {}

    def call(n):
        tries[n] = tries.get(n, 0) + 1
        if tries[n] <= n:
            raise OSError("later") if n < 9 else RuntimeError("never")
        return "ok"

    got = list(calls([0, 1, 2, 3, 9], call, Limits(retries=2, backoff=0.001, again=lambda e: isinstance(e, OSError))))
    assert got == [("ok", None), ("ok", None), ("ok", None), (None, "OSError: later"), (None, "RuntimeError: never")]
    assert tries == {0: 1, 1: 2, 2: 3, 3: 3, 9: 1}


def test_called(spark):
    def call(n):
        if n == 13:
            raise RuntimeError("thirteen")
        return f"<{n}>"

    rows = called(spark.range(50, numPartitions=3), "id", call, Limits(at_once=4)).collect()
    assert [(r.id, r.result, r.error) for r in rows] == [(n, None if n == 13 else f"<{n}>", "RuntimeError: thirteen" if n == 13 else None) for n in range(50)]


def test_slow_packs(spark):
    """One pack's answer that does not come in time fails that pack alone; packs are asked side by side."""

    def classifier(prompt):
        time.sleep(60 if '"a7"' in prompt else 0.2)
        return "{}"

    packs = spark.createDataFrame([(f"a{k}", [], []) for k in range(24)], "author_key string, posts array<string>, context_posts array<string>").coalesce(1)
    began = time.monotonic()
    got = {r.author_key: r.reply for r in tally.classified(packs, classifier, limits=Limits(at_once=12, seconds=2)).collect()}
    assert got == {f"a{k}": None if k == 7 else "{}" for k in range(24)}
    assert time.monotonic() - began < 15


def test_folders_written_and_read(spark, tmp_path):
    """Page dumps, a failed run's envelope, single HTML files and images, search over rows."""
    pages_ = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "page int, code int, msg string").withColumn("_corrupt", F.lit(None).cast("string"))
    sinks.write_pages(pages_, str(tmp_path / "dump"))
    assert {(r.page, r.msg) for r in spark.read.json(str(tmp_path / "dump")).collect()} == {(1, "a"), (2, "b")}
    sinks.write_failure(spark, "no pages", ["w"], str(tmp_path / "failed"))
    row = spark.read.json(str(tmp_path / "failed" / "meta")).first()
    assert (row.schema_version, row.status, row.message, row.warnings) == (4, "failed", "no pages", ["w"])
    files.write_files(files.post_files(spark.createDataFrame([(3, "<p>x"), (12, "y")], "lou long, html string")), str(tmp_path / "html"))
    assert {(r.lou, r.html) for r in pages.html_parts(spark, str(tmp_path / "html" / "post_*.html")).collect()} == {(3, "<p>x"), (12, "y")}
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.gif").write_bytes(b"GIF89a\5\0\6\0")
    (tmp_path / "images" / "b.gif").write_bytes(b"GIF89a\5\0\6\0")
    sized = archive.image_files(pages.images(spark, str(tmp_path / "images")))
    assert {(r.filename, r.canonical, r.width, r.height) for r in sized.collect()} == {("a.gif", "a.gif", 5, 6), ("b.gif", "a.gif", 5, 6)}
    rows = spark.createDataFrame([(1, "t", "some thing"), (2, "u", "thing")], "n long, topic_id string, search string")
    assert [r.n for r in views.searched(rows, " THING ").collect()] == [1, 2]
    assert [r.n for r in views.searched(rows, "", "u").collect()] == [2]
