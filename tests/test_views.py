"""What readers see, against plain versions."""

from __future__ import annotations

import csv
import hashlib
import html
import io
import json
import random
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from postloom.functions.entities import unescaped, unescaped_twice
from postloom.functions.order import natural_key
from postloom.operators import anchors
from postloom.plans import archive, payload, views, workbook
from postloom.queries_views import sheet_entries
from postloom.rules import Topic
from postloom.sources import files


def plain_key(s):
    parts = [(t.casefold(), int(d) if d else -1) for t, d in re.findall("([^0-9]*)([0-9]*)", s)]
    forms = [(t.swapcase(), int(d) if d else -1) for t, d in re.findall("([^0-9]*)([0-9]*)", s)]
    return parts, forms, s


def test_natural_order(spark):
    pick = random.Random(2)
    texts = ["".join(pick.choice(["a", "A", "b", "B", "1", "2", "0", "10", "007", "z"]) for _ in range(pick.randrange(8))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").repartition(3)
    got = [r.s for r in rows.orderBy(natural_key(F.col("s"))).collect()]
    assert got == sorted(texts, key=plain_key)
    few = [None, "", "7", "007", "啊", "吧", "第2楼", "第10楼", "第" + "9" * 40 + "楼", "a9", "A9", "a10", "é2", "é10"]
    mixed = spark.createDataFrame([(t,) for t in reversed(few)], "s string").orderBy(natural_key(F.col("s"))).collect()
    order = [r.s for r in mixed]
    assert order[:2] == [None, ""]
    for a, b in (("第2楼", "第10楼"), ("第10楼", "第" + "9" * 40 + "楼"), ("a9", "a10"), ("A9", "a10"), ("é2", "é10"), ("啊", "吧"), ("007", "啊")):
        assert order.index(a) < order.index(b)


def test_filters_and_export(spark):
    e = spark.createDataFrame([(1, "qa", [1], 1, "x", True, False), (2, "t", [2], 2, "y", False, True), (3, "t", [], 3, None, None, None)], "entry_id long, topic_id string, source_lous array<long>, chosen_lou long, text string, has_duplicate boolean, needs_manual_review boolean")
    i = spark.createDataFrame([(5, "楼层 5 小于等于起始楼层 9"), (6, "作者 uid=3 在忽略名单中；late"), (7, None)], "lou long, ignore_reason string")
    assert {r.lou for r in views.visible_refusals(i).collect()} == {6, 7}
    assert {r.entry_id for r in views.to_review(e).collect()} == {1, 2}
    parts = lambda **how: {r.topic_id: r.body for r in views.text_export(e, i, **how).collect()}
    assert parts() == {"qa": "[b]#1[/b] x", "t": "[b]#2[/b] y\n[b]#3[/b] ", "ignored": "[s]#6[/s] late"}
    assert parts(tab="duplicates") == {"qa": "[b]#1[/b] x"}
    assert parts(topic="t") == {"t": "[b]#2[/b] y\n[b]#3[/b] "}
    topics = anchors.topic_table(spark, (Topic("z", "Z", "z"), Topic("t", "T", "")))
    assert [r.topic_id for r in views.topics_in_order(topics, e).orderBy("place").collect()] == ["z", "t", "qa"]
    more = e.unionByName(e.withColumns({"topic_id": F.lit("aa"), "entry_id": F.lit(9).cast("long")}))
    assert [r.topic_id for r in views.topics_in_order(topics, more, by_first=True).orderBy("place").collect()] == ["z", "t", "qa", "aa"]


def test_workbook(spark, sf_dir, tmp_path):
    """Every sheet as a file: headings, rows in order, cells with breaks and quotes, widths; a listed topic without entries."""
    e = sheet_entries(spark, sf_dir).withColumn("content", F.concat("content", F.lit('\nand "more", twice')))
    topics = anchors.topic_table(spark, (Topic("click", "Click: all/any", ""), Topic("qa", "Questions", "Q&A")))
    book = workbook.workbook(e, topics)
    files.write_files(book, str(tmp_path / "book"))
    cells = {(r.topic_id, r.row_no): r.cells for r in views.sheet_cells(e, views.field_headers(e)).collect()}
    names = {p.parent.name for p in (tmp_path / "book").glob("*/layout.json")}
    others = sorted({t for t, _ in cells} - {"click"})
    assert names == {"01_Click_ all_any", "02_Q&A", *(f"{n:02d}_{t}" for n, t in enumerate(others, 3))}
    for t in ("click", others[0]):
        folder = tmp_path / "book" / next(n for n in names if n.endswith(t) or n.startswith("01_") and t == "click")
        rows = list(csv.reader(io.StringIO((folder / "rows_00000.csv").read_text(newline=""))))
        assert rows == [cells[k] for k in sorted(k for k in cells if k[0] == t)]
        layout = json.loads((folder / "layout.json").read_text())
        assert layout["freeze"] == "A2" and layout["filter"] and layout["bold_headings"]
        assert layout["widths"] == [min(60, max(10, max(len(r[c]) for r in rows[:200]) + 2)) for c in range(len(rows[0]))]
    empty = list(csv.reader((tmp_path / "book" / "02_Q&A" / "rows_00000.csv").open()))
    assert empty == [[*views.HEADINGS_BEFORE, "问题", *views.HEADINGS_AFTER]]


def test_files_and_manifest(spark, tmp_path):
    """A rerun gives the same manifest; a failed task leaves no half file and the manifest of before."""
    folder = tmp_path / "out"
    html_ = spark.range(200, numPartitions=4).select(F.col("id").alias("lou"), F.concat(F.lit("<p>é "), F.col("id").cast("string")).alias("html"))
    files.write_files(files.post_files(archive.local_links(html_)), str(folder))
    want = {f"post_{k}.html": f"<p>é {k}" for k in range(200)}
    assert {p.name: p.read_text() for p in folder.glob("post_*")} == want
    listed = {r.path: (r.size, r.sha256) for r in files.manifest(spark, str(folder)).collect()}
    assert listed == {n: (len(b.encode()), hashlib.sha256(b.encode()).hexdigest()) for n, b in want.items()}
    before = (folder / "manifest.json").read_text()
    files.write_files(files.post_files(html_), str(folder))
    assert (folder / "manifest.json").read_text() == before
    bad = html_.select(F.format_string("post_%d.html", "lou").alias("path"), F.when(F.col("lou") == 150, F.raise_error(F.lit("stop"))).otherwise(F.lit("new")).alias("body"))
    with pytest.raises(Exception, match="stop"):
        files.write_files(bad, str(folder))
    assert (folder / "manifest.json").read_text() == before
    assert {p.read_text() for p in folder.glob("post_*")} <= {"new", *want.values()}
    assert not [p for p in folder.rglob("*") if "_writing" in str(p) and p.is_file()]
    with pytest.raises(Exception, match="not a path"):
        files.write_files(spark.createDataFrame([("../x", "y")], "path string, body string"), str(folder))


def test_references(spark):
    """Every named reference, with and without its semicolon, numbers of all kinds, and random texts: as the standard library has it, once and twice."""
    rows = [f"x&{n}y" for n in html5] + [f"&{n.rstrip(';')}" for n in html5] + ["&notit;", "&ampamp;", "&unknown;", "&" + "a" * 40 + ";"]
    rows += [f"&#{n};" for n in (*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFFFE, 0x10FFFF, 0x110000, 0x1F437, 10**30, 9_999_999_999)]
    rows += [f"&#x{n:x}" for n in (0, 13, 128, 0x1F437, 0xD800, 2**70)] + ["&#0000000000000000065;", "&", "&&amp;&", "a & b", "&amp;amp;lt;", "&;", "&#;", "&#x;", "\n&lt\t", None, ""]
    pick = random.Random(1)
    rows += ["".join(pick.choice(["&", "amp", "lt", ";", "#", "x", "4", "1", "not", "it", "é", "\U0001f437", " ", "\n", "copy", "&amp;", "&quot;"]) for _ in range(12)) for _ in range(1500)]
    df = spark.createDataFrame([(r,) for r in rows], "s string").select("s", unescaped(F.col("s")).alias("once"), unescaped_twice(F.col("s")).alias("twice"))
    for r in df.collect():
        assert r.once == (None if r.s is None else html.unescape(r.s)), r.s
        assert r.twice == (None if r.s is None else html.unescape(html.unescape(r.s))), r.s


def test_payloads(spark, tmp_path):
    entries = spark.createDataFrame([(1, "qa", {"k\"\\": '["a",1]', "p": "plain", "n": "2.5"}, None), (2, "t", {}, 0.5), (3, None, None, 1.0)], "entry_id long, topic_id string, fields map<string,string>, confidence double")
    held = [json.loads(r.json) for r in payload.entry_json(entries).orderBy("entry_id").collect()]
    assert held == [
        {"entry_id": 1, "topic_id": "qa", "confidence": None, "fields": {'k"\\': ["a", 1], "p": ["plain"], "n": 2.5}},
        {"entry_id": 2, "topic_id": "t", "confidence": 0.5, "fields": {}},
        {"entry_id": 3, "topic_id": None, "confidence": 1.0, "fields": {}},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"parsed_rule": {"topics": [{"id": "x", "name": "X"}, 5]}, "anchors": [{"entries": [{"id": 7, "topic_id": "x", "lou": "3"}]}, {"author": {"uid": 4}, "has_duplicate": True, "posts": [{"lou": 9, "pid": 5}]}, {"posts": "none"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"topics": [{"id": "y"}], "entries": [], "anchors": [{"posts": [{"lou": 1}]}]}))
    (tmp_path / "c.json").write_text("{broken")
    read = payload.read_payloads(spark, str(tmp_path))
    assert {(r.path[-6:], r.topic_id, r.topic_name) for r in payload.topics_of(read, "path").collect()} == {("a.json", "x", "X"), ("b.json", "y", None)}
    got = [(r.path[-6:], r.place, r.entry_id, r.topic_id, r.lou, r.url, r.uid, r.has_duplicate) for r in payload.entries_of(read, "path").orderBy("path", "place").collect()]
    assert got == [("a.json", 0, 7, "x", 3, None, None, False), ("a.json", 1, 2, "unclassified", 9, "https://ngabbs.com/read.php?pid=5&opt=128", "4", True)]
    posts = spark.createDataFrame([(2, 5, 12, "a", 1, "u", "d", "late", []), (1, 5, 11, "a", 1, "u", "d", "first", []), (3, 5, 13, "b", 2, "v", "d", "other", [])], "ord long, lou long, pid long, author_key string, uid long, username string, postdate string, content string, attachments array<struct<type:string>>")
    e = spark.createDataFrame([(1, "a", [5, 6])], "entry_id long, author_key string, source_lous array<long>")
    (only,) = payload.with_sources(e, posts).first()["source_posts"]
    assert (only.content, only.pid, only.url, only.author.username) == ("first", 11, "https://ngabbs.com/read.php?pid=11&opt=128", "u")
