"""Replies whose values have types, and why replies that add weight find no target."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from postloom.functions.markup import reply_context
from postloom.operators import targets
from postloom.operators.packs import author_packs
from postloom.plans import tally
from postloom.rules import Rule

POST = "ord long, lou long, pid long, uid long, username string, postdate string, content string, author_key string"


def posts(spark, *rows):
    return spark.createDataFrame([(n, lou, 100 + n, uid, f"u{uid}", "2026-01-01 10:00", text, f"uid:{uid}") for n, (lou, uid, text) in enumerate(rows)], POST)


def answering(*replies):
    """A classifier that gives each author's reply; nested, so that it goes to workers by value."""
    held = dict(replies)

    def classifier(prompt):
        return json.dumps(held[json.loads(prompt)["author_key"]], ensure_ascii=False)

    return classifier


def test_typed_reply(spark):
    """List fields give all their names, whole floats are floors, "12.0" and true are none, what is no list or object is left out."""
    rows = posts(spark, (102, 1, "马车"), (13, 1, "旅行"), (20, 2, "x"), (30, 3, "y"))
    one = {
        "items": [
            {"topic_id": "theme4", "fields": {"名字": ["乙名", "丙名", 7], "数": 5}, "normalized_anchor_text": "甲号", "source_lous": [102.0], "confidence": "0.5", "needs_manual_review": False},
            {"topic": "", "topic_name": "travel", "content": "旅行 A", "source_lous": "13", "chosen_lou": 13.0, "note": 5},
            "no object",
        ]
    }
    two = {"items": {"0": {}}, "ignored_posts": [{"lou": 20.0, "ignore_reason": 5}], "warnings": ["w", 3, None, " "]}
    three = {"items": [{"topic_id": "qa2", "source_lous": ["12.0", True], "needs_manual_review": "no"}], "ignored_posts": "none"}
    out = tally.tally(spark, rows, Rule(start_lou=0), answering(("uid:1", one), ("uid:2", two), ("uid:3", three)))
    got = {(r.chosen_lou, r.topic_id): (r.normalized_anchor_text, r.confidence, r.needs_manual_review, r.fields) for r in out.entries.collect()}
    assert got == {
        (102, "theme4_carriage_name"): ("乙名、丙名、甲号", 0.5, False, {"名字": '["乙名","丙名",7]', "数": "5"}),
        (13, "theme1_travel"): ("旅行 A", None, False, {}),
        (30, "qa2"): ("y", None, True, {}),
    }
    assert {(r.lou, r.ignore_reason) for r in out.ignored.collect()} == {(20, "模型判定不是有效安价")}
    said = {r.message for r in out.warnings.where("type = 'runtime_warning'").collect()}
    assert said == {"w", "3", "uid:2 的模型返回 items 不是数组，已忽略该字段", "uid:3 的模型返回 ignored_posts 不是数组，已忽略该字段"}


def test_posts_of_one_floor(spark):
    """A page read twice, and another author's post with the floor's number: the author's own first post is the submission's."""
    rows = posts(spark, (5, 1, "加权 甲"), (5, 1, "second"), (5, 2, "other"))
    for _ in range(2):
        out = tally.tally(spark, rows, Rule(start_lou=0))
        assert {(r.author_key, r.hint) for r in out.entries.collect()} == {("uid:1", "甲"), ("uid:2", None)}


def test_reasons_of_replies(spark):
    askers = spark.createDataFrame([(1, 10, None), (2, 10, "aaaa"), (3, 10, "zzzz"), (4, 10, "bb"), (5, 99, "aaaa"), (6, None, "aaaa"), (7, 20, "zzzz")], "lou long, reply_to_pid long, hint string")
    offers = [(k, "t", [10], [], text, False) for k, text in enumerate(("aaaa one", "bbb one", "bbb two"))] + [(9, "t", [20], [], "alone", False), (8, "t", [99], [], "aaaa", True)]
    offers = spark.createDataFrame(offers, "proposal_id long, topic_id string, source_pids array<long>, fields array<string>, normalized_anchor_text string, is_weight boolean")
    found = {(r.lou, r.target) for r in targets.reply_targets(askers.where("reply_to_pid is not null"), offers).collect()}
    assert found == {(1, 0), (1, 1), (1, 2), (2, 0), (7, 9)}
    why = {r.lou: r.reason for r in targets.reply_failures(askers, offers).collect()}
    assert why == {3: "reply pid=10 对应 3 个候选，且引用内容不足以区分", 4: "reply pid=10 存在 2 个同分候选", 5: "reply pid=99 没有对应候选条目", 6: "Reply 引用里没有 pid"}


def test_warnings_of_replies_without_a_target(spark):
    quote = "[quote][pid=%d,1,1]Reply[/pid] <b>Post by [uid=2]u2[/uid]:</b><br/>old[/quote]加权"
    rows = posts(spark, (1, 1, quote % 555), (2, 2, quote % 556), (3, 3, "加权"))
    one = {"items": [{"topic_id": "qa2", "source_lous": [1]}]}
    refuse = lambda lou: {"ignored_posts": [{"lou": lou, "ignore_reason": "chat"}]}
    out = tally.tally(spark, rows, Rule(start_lou=0), answering(("uid:1", one), ("uid:2", refuse(2)), ("uid:3", refuse(3))))
    said = {(r.lou, r.message) for r in out.warnings.where("type = 'runtime_warning'").collect()}
    assert said == {
        (1, "楼层 1 的 Reply 加权未能从模型条目规范化：reply pid=555 没有对应候选条目"),
        (2, "楼层 2 的 Reply 加权未能恢复：reply pid=556 没有对应候选条目"),
        (3, "楼层 3 的 Reply 加权未能恢复：Reply 引用里没有 pid"),
    }
    assert out.counts.first()["warning_count"] == 3


def test_packs_show_replies(spark):
    """Packs show when posts were written and what they quote."""
    quote = "[quote][pid=100,1,1]Reply[/pid] <b>Post by [uid=2]u2[/uid]:</b><br/>old[/quote]加权"
    shown = posts(spark, (1, 1, "target"), (2, 2, quote)).withColumn("reply", reply_context(F.col("content")))
    seen = {r.author_key: r.posts[0] for r in author_packs(shown).collect()}
    assert seen["uid:2"].reply_context.asDict() == {"has_reply_quote": True, "reply_quote_count": 1, "reply_to_author": "u2", "reply_to_pid": 100, "quoted_preview": "old"}
    assert seen["uid:1"].postdate == "2026-01-01 10:00" and not seen["uid:1"].reply_context.has_reply_quote
