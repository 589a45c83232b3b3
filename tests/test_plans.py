"""Pages to results, through files."""

import json

from pyspark.sql import functions as F

from postloom.operators import gaps, numbering
from postloom.plans import archive, legacy, tally, views
from postloom.rules import Rule
from postloom.sources import pages, sinks
from postloom.streaming.pages import hourly_counts, post_stream


def write_pages(folder):
    def post(lou, uid, text, pid=None):
        return {"lou": str(lou), "pid": str(pid or 1000 + lou), "postdate": f"2026-01-01 {lou % 24:02d}:00", "author": {"uid": str(uid) if uid else None, "username": f"u{uid}"}, "content": text, "attches": []}

    reply = "[quote][pid=1002,1,1]Reply[/pid] <b>Post by [uid=2]u2[/uid]:</b><br/>old[/quote]加权"
    first = [post(0, 9, "rule"), post(1, 1, "旅行 A"), post(2, 2, "旅行 B"), post(3, 1, "旅行 C"), None, post(5, 3, reply), post(6, 4, "")]
    for n, rows in ((1, first), (2, [post(21, 5, "x<br>y"), post(25, 1, "late")])):
        (folder / f"page_{n}.json").write_text(json.dumps({"code": 0, "msg": "", "totalPage": 2, "result": rows}))
    (folder / "page_3.json").write_text("{broken")


def stand_in():
    """Nested, so that it goes to workers by value."""

    def classifier(prompt):
        pack = json.loads(prompt)
        if "uid:5" in pack["author_key"]:
            raise RuntimeError("down")
        items = [{"topic_id": "旅行", "normalized_anchor_text": p["content"], "source_lous": [str(p["lou"])], "chosen_lou": str(p["lou"])} for p in pack["posts"] if p["content"] != "加权"]
        refused = [{"lou": str(p["lou"]), "ignore_reason": "weight"} for p in pack["posts"] if p["content"] == "加权"]
        return "answer: " + json.dumps({"items": items, "ignored_posts": refused, "warnings": ["w"]})

    return classifier


def test_tally(spark, tmp_path):
    write_pages(tmp_path)
    read = pages.read_pages(spark, str(tmp_path))
    assert pages.page_warnings(read).count() == 1
    assert [r.page for r in pages.in_floors(read, 20, 39).collect()] == [2]
    posts = pages.posts_of(read)
    assert posts.count() == 8
    assert pages.rule_post(posts, 0).first()["content"] == "rule"
    rule = Rule(start_lou=0, end_lou=24)
    plain = tally.tally(spark, posts, rule)
    assert [(r.entry_id, r.chosen_lou) for r in plain.entries.orderBy("entry_id").collect()] == [(1, 1), (2, 2), (3, 3), (4, 5), (5, 21)]
    assert {r.lou: r.ignore_reason for r in plain.ignored.collect()} == {0: "楼层 0 小于等于起始楼层 0", 6: "清洗后内容为空", 25: "楼层 25 大于结束楼层 24"}
    out = tally.tally(spark, posts, rule, stand_in())
    found = {(r.author_key, r.topic_id, r.chosen_lou, r.normalized_anchor_text) for r in out.entries.collect()}
    assert found == {("uid:1", "theme1_travel", 3, "旅行 C"), ("uid:2", "theme1_travel", 2, "旅行 B"), ("uid:3", "theme1_travel", 5, "加权：旅行 B"), ("uid:5", "unclassified", 21, "x\ny")}
    assert {(r.lou, r.stage) for r in out.ignored.collect()} == {(0, "deterministic"), (6, "deterministic"), (25, "deterministic"), (1, "superseded")}
    assert [(r.start, r.end) for r in out.missing.orderBy("start").collect()] == [(4, 4), (7, 20), (22, 24)]
    assert out.anchors.count() == 4
    sinks.write_tables(out.tables(), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "entries")).count() == 4
    rows, refused = legacy.legacy_tally(posts, Rule(0, keyword="旅行"))
    assert {r.lou: r.author_number for r in rows.collect()} == {1: 1, 2: 2, 3: 1}
    assert legacy.reconciliation(posts, rows, refused).first()["adds_up"] is False
    html = archive.post_html(posts)
    assert html.where("html = '<p><em>本楼层内容缺失。</em></p>'").select("lou").orderBy("lou").first()["lou"] == 4


def test_stream(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    write_pages(folder)
    q = hourly_counts(post_stream(spark, str(folder))).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(posts) from hours").first()[0] == 8


def test_gaps(spark):
    present = spark.createDataFrame([(x,) for x in (1, 2, 5, 6, 9)], "lou long")
    for cell in (2, 1 << 20):
        found = gaps.missing_ranges(present, 0, 10, cell).orderBy("start").collect()
        assert [tuple(r) for r in found] == [(0, 0, 1), (3, 4, 2), (7, 8, 2), (10, 10, 1)]


def test_dense_numbers(spark):
    rows = [(k % 3, (k * 7919) % 1000, k, "ab"[k % 2]) for k in range(500)] + [(None, None, None, None), (1, None, -1, None), (1, 5, None, "a"), (1, 5, None, "a")]
    df = spark.createDataFrame(rows, "a int, b long, k long, w string").repartition(5)
    order = lambda r: tuple((x is not None, x or 0) for x in (r.a, r.b, r.k))
    got = numbering.dense_number(df, "n", F.col("a"), F.col("b"), ["k"]).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, len(rows) + 1))
    assert [order(r) for r in got] == sorted(order(r) for r in got)
    groups = numbering.dense_number(df, "n", F.col("a"), F.col("b"), ["k"], within=["w"]).orderBy("w", "n").collect()
    for w in (None, "a", "b"):
        mine = [r for r in groups if r.w == w]
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert [order(r) for r in mine] == sorted(order(r) for r in mine)
    assert numbering.dense_number(df.where("false"), "n", F.col("a"), F.col("b"), ["k"]).count() == 0


def test_one_number_in_many_tasks(spark, tmp_path):
    """Rows of one floor, and rows that are equal in everything, are sorted in as many tasks as any others."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for k, column in enumerate((F.col("id"), F.lit(0))):
            rows = spark.range(400_000, numPartitions=8).select(F.lit(7).alias("lou"), column.alias("ord"))
            sizes = [r["count"] for r in numbering.in_order(rows, ["lou", "ord"], str(tmp_path / str(k))).groupBy("_part").count().collect()]
            assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
            numbered = numbering.dense_number(rows, "n", F.lit(0), F.col("lou"), ["ord"])
            assert numbered.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (400_000, 1, 400_000)
            assert k or numbered.where("n <> ord + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_titles(spark):
    titles = spark.createDataFrame([("a" * 40, 1), ("a" * 40, 2), ("b", 3)], "title string, ord int")
    assert [r.sheet for r in numbering.unique_titles(titles).orderBy("ord").collect()] == ["a" * 31, "a" * 29 + "_2", "b"]


def test_catalog(spark, tmp_path):
    (tmp_path / "threads.json").write_text(json.dumps({"ThreadList": [{"thread_name": "t", "tid": 1, "aid": None}]}))
    catalog = pages.read_catalog(spark, str(tmp_path / "threads.json"))
    more = spark.createDataFrame([("t", 1, None), ("u", 2, None)], "thread_name string, tid long, aid long")
    assert {r.tid for r in pages.new_threads(catalog, more).collect()} == {1, 2}
    assert pages.new_threads(catalog, more).count() == 2


def test_names(spark):
    rows = [("a", "theme4_carriage_name", 5, [4, 5], "甲、乙", {"n": "甲"}, None, False, "", 1), ("a", "qa", 6, [6], "甲、乙", {}, None, False, "", 2)]
    proposals = spark.createDataFrame(rows, "author_key string, topic_id string, chosen_lou long, source_lous array<long>, normalized_anchor_text string, fields map<string,string>, confidence double, needs_manual_review boolean, note string, ord long")
    posts = spark.createDataFrame([("a", 4, "马车名字：丙，甲"), ("a", 5, "再来一个：丁")], "author_key string, lou long, content string")
    assert [r.normalized_anchor_text for r in tally.named(proposals, posts).orderBy("ord").collect()] == ["甲、乙、丙、丁", "甲、乙"]


def test_labels(spark):
    rows = spark.createDataFrame([(None, "3", "a"), (2, "10", "b"), (2, "9", "c")], "lou long, pid string, stage string")
    assert [r.stage for r in views.ordered_refusals(rows).collect()] == ["c", "b", "a"]
    times = spark.createDataFrame([("2026-05-04T23:00:01",), ("soon",)], "t string")
    assert [r[0] for r in times.select(views.generated_label(F.col("t"))).collect()] == ["2026-05-04 23:00:01", "soon"]
    e = spark.createDataFrame([(0.5, [3], 7, "n", "p")], "confidence double, superseded_lous array<long>, chosen_lou long, note string, proxy string")
    assert views.entry_notes(e).first()["notes"] == "n\np\n覆盖楼层 #3\n置信度 50%"


def test_paged_service(spark, tmp_path):
    import http.server
    import threading
    import urllib.parse

    write_pages(tmp_path)

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            form = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())
            body = (tmp_path / f"page_{form['page'][0]}.json").read_bytes()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    pages.register(spark)
    read = spark.read.format("forum_pages").options(url=f"http://127.0.0.1:{server.server_port}/", tid="7").load()
    posts = pages.posts_of(pages.parsed(read))
    assert sorted(r.lou for r in posts.collect()) == [0, 1, 2, 3, 5, 6, 21, 25]
    server.shutdown()


def test_replies_are_asked_for_until_they_parse(spark):
    assert [tally.holds_object(x) for x in ('{"a": 1}', 'so: {"a": 1}.', "{broken", "[1]", None, "```json\n{}\n```")] == [True, True, False, False, False, True]

    def classifier(prompt):
        return '{"items": []}' if prompt.endswith("。") else "{broken"

    packs = spark.createDataFrame([("a", [], [])], "author_key string, posts array<string>, context_posts array<string>")
    assert tally.classified(packs, classifier).first()["reply"] == '{"items": []}'


def test_items_are_told_apart(spark):
    """More than a hundred items of one post, and posts whose numbers are a hundredfold of others'."""
    def classifier(prompt):
        post = json.loads(prompt)["posts"][0]
        return json.dumps({"items": [{"topic_id": "qa", "normalized_anchor_text": f"{post['lou']}-{k}", "source_lous": [str(post["lou"])]} for k in range(130)]})

    rows = [(n, n, n, n, f"u{n}", "2026-01-01 10:00", "提问", f"uid:{n}") for n in (1, 2, 100, 101)]
    posts = spark.createDataFrame(rows, "ord long, lou long, pid long, uid long, username string, postdate string, content string, author_key string")
    out = tally.tally(spark, posts, Rule(start_lou=0), classifier)
    entries = out.entries.orderBy("entry_id").collect()
    assert [(r.chosen_lou, r.normalized_anchor_text) for r in entries] == [(n, f"{n}-{k}") for n in (1, 2, 100, 101) for k in range(130)]
    assert [r.entry_id for r in entries] == list(range(1, 521))
