"""What the tally makes of a classifier's replies."""

import json

from pyspark.sql import functions as F

from postloom.functions.matching import scoped_reasons
from postloom.functions.scalars import lou_list
from postloom.operators.packs import author_packs, reply_context_posts
from postloom.operators.targets import reply_targets
from postloom.plans import tally
from postloom.rules import TOPICS, Rule

POSTS = "ord long, lou long, pid long, uid long, username string, postdate string, content string, author_key string"


def posts(spark, *rows):
    return spark.createDataFrame([(lou, lou, 1000 + lou, uid, f"u{uid}", "2026-01-01 10:00", text, f"uid:{uid}") for lou, uid, text in rows], POSTS)


def quoting(lou, text):
    return f"[quote][pid={1000 + lou},1,1]Reply[/pid] <b>Post by [uid=2]u[/uid]:</b><br/>old[/quote]{text}"


def replying(answers):
    """Nested, so that it goes to workers by value."""

    def classifier(prompt):
        return json.dumps(answers[json.loads(prompt)["author_key"]])

    return classifier


def entries(out):
    return {(r.author_key, r.topic_id, r.chosen_lou, r.normalized_anchor_text) for r in out.entries.collect()}


def test_lists_or_single_floors(spark):
    rows = spark.createDataFrame([("[3, 1, 3]",), ('["2", "x"]',), ("12",), (" 7 ",), ("",), (None,), ("[]",), ("[broken",)], "c string")
    assert [r[0] for r in rows.select(lou_list(F.col("c"))).collect()] == [[1, 3], [2], [12], [7], [], [], [], []]


def test_reasons_name_their_topic(spark):
    rows = spark.createDataFrame([("聊天", "qa"), ("Q&A：聊天", "qa"), ("主题一：旧", "theme1_travel"), ("仅忽略旅行，旧", "theme1_travel"), ("旧", "other"), ("旧", None), ("", "qa")], "r string, t string")
    got = [r[0] for r in rows.select(scoped_reasons(F.col("r"), F.col("t"), TOPICS)).collect()]
    qa = "仅忽略特别环节：诡秘小祥一周年 Q&A，"
    assert got == [qa + "聊天", qa + "聊天", "仅忽略主题1：旅行，旧", "仅忽略旅行，旧", "仅忽略other，旧", "旧", qa + "模型判定该主题无效"]


def test_odd_replies(spark):
    answers = {
        "uid:1": {"items": [{"topic_id": "旅行", "lou": 1, "source_lous": "2"}, {"topic_id": "qa", "source_lous": 3, "content": "提问 c"}], "ignored_posts": [{"lou": 99, "ignore_reason": "elsewhere", "topic_id": "qa"}, {"ignore_reason": " "}]},
        "uid:2": {"items": [], "ignored_posts": [{"source_lous": 4, "superseded_by_lou": "5"}], "warnings": ["w"]},
    }
    out = tally.tally(spark, posts(spark, (1, 1, "a"), (2, 1, "b"), (3, 1, "提问 c"), (4, 2, "d"), (5, 2, "问答：请输入文本")), Rule(start_lou=0), replying(answers))
    rows = {r.normalized_anchor_text: r for r in out.entries.collect()}
    assert set(rows) == {"a", "提问 c"}
    assert (rows["a"].chosen_lou, list(rows["a"].source_lous), rows["提问 c"].chosen_lou) == (1, [1, 2], 3)
    refused = {(r.author_key, r.lou, r.ignore_reason, r.stage) for r in out.ignored.collect()}
    qa = "仅忽略特别环节：诡秘小祥一周年 Q&A，"
    assert refused == {
        ("uid:1", 99, qa + "elsewhere", "llm_author_pack"),
        ("uid:1", None, "模型判定不是有效安价", "llm_author_pack"),
        ("uid:2", 4, "模型判定不是有效安价", "llm_author_pack"),
        ("uid:2", 5, qa + "无有效安价内容，仅为占位符", "placeholder_topic_filter"),
        ("uid:2", 5, "模型未将该楼归入任何有效条目", "llm_author_pack"),
    }
    counts = out.counts.first()
    assert counts.asDict() == {"candidate_count": 5, "entry_count": 2, "author_count": 1, "ignored_count": 5, "superseded_count": 1, "warning_count": 1, "manual_review_required": True}


def test_weights_among_submissions_are_rewritten(spark):
    rows = posts(spark, (1, 1, "旅行 A"), (2, 1, "马车名字：甲"), (3, 2, quoting(1, "加权")), (4, 3, quoting(2, "加权 乙")))
    answers = {
        "uid:1": {"items": [{"topic_id": "旅行", "source_lous": [1], "content": "旅行 A"}, {"topic_id": "qa", "source_lous": [1], "content": "提问 B"}, {"topic_id": "马车名字", "source_lous": [2], "content": "甲", "fields": {"名字": "甲"}}]},
        "uid:2": {"items": [{"topic_id": "订婚", "source_lous": [3], "content": "加权", "confidence": 0.5}]},
        "uid:3": {"items": [], "ignored_posts": [{"lou": 4, "ignore_reason": "weight"}]},
    }
    out = tally.tally(spark, rows, Rule(start_lou=0), replying(answers))
    assert entries(out) == {
        ("uid:1", "theme1_travel", 1, "旅行 A"),
        ("uid:1", "qa", 1, "提问 B"),
        ("uid:1", "theme4_carriage_name", 2, "甲"),
        ("uid:2", "theme1_travel", 3, "加权：旅行 A"),
        ("uid:2", "qa", 3, "加权：提问 B"),
        ("uid:3", "theme4_carriage_name", 4, "加权：甲"),
    }
    assert out.ignored.count() == 0
    assert {r.confidence for r in out.entries.where("author_key = 'uid:2'").collect()} == {0.5}


def test_targets_by_hint_or_quoted_text(spark):
    offers = spark.createDataFrame([(1, "a", [7], ["x"], "alpha", False), (2, "b", [7], ["y"], "beta", False), (3, "c", [8], ["z"], "gamma", False)], "proposal_id long, topic_id string, source_pids array<long>, fields array<string>, normalized_anchor_text string, is_weight boolean")
    asks = spark.createDataFrame([(1, 7, "none", "beta"), (2, 7, "alpha", "beta"), (3, 8, "none", None), (4, 7, None, "beta"), (5, 8, "gamma", None)], "lou long, reply_to_pid long, hint string, preview string")
    got = {(r.lou, r.target, r.match_text) for r in reply_targets(asks, offers).collect()}
    assert got == {(1, 2, "beta"), (3, 3, None), (4, 1, None), (4, 2, None), (5, 3, "gamma")}


def test_warnings_that_no_longer_hold(spark):
    said = ["候选楼5包含两个马车名字安价，按规则只保留第一个；第二个未计入。", "候选楼6包含两个马车名字安价，按规则只保留第一个；第二个未计入。", "一楼内出现两个名字，只保留第一个，第二个不计", "other"]
    warnings = spark.createDataFrame([(a, w) for a in ("a", "b") for w in said], "author_key string, message string")
    names = spark.createDataFrame([("a", [5], "甲、乙"), ("b", [6], "丙")], "author_key string, source_lous array<long>, normalized_anchor_text string")
    got = sorted(r.message for r in tally.warnings_that_hold(warnings, names).collect())
    assert got == sorted(said + [said[1], said[3]])


def test_prompt(spark):
    rule = Rule(start_lou=0, floor_notes=((2, "note of two"), (3, "note of three")), post_char_limit=5)
    packs = author_packs(posts(spark, (1, 1, "short"), (2, 1, "far too long")))
    text = packs.select(tally.pack_prompt(rule)).first()[0]
    shown = json.loads(text.split("候选楼：\n")[1])
    assert [(p["lou"], p["content"], p["content_truncated"]) for p in shown["posts"]] == [(1, "short", False), (2, "far t\n...[已截断]", True)]
    assert "note of two" in text and "note of three" not in text and "uid:1" not in text
    assert all(t.id in text and t.description in text for t in TOPICS) and "2026-05-04 23:00" in text


def test_posts_that_nobody_asks_for_are_not_compared(spark, monkeypatch):
    """No reply that adds weight: no table is made to look for targets; context is read of posts that are replied to."""
    kept = []
    monkeypatch.setattr(tally, "keep", lambda df, path: kept.append(path) or df)
    none = lambda kind: F.lit(None).cast(kind)
    candidates = spark.range(3).select(F.lit("a").alias("author_key"), F.col("id").alias("lou"), none("string").alias("hint"), F.lit("x").alias("content"), F.lit(False).alias("asks"), F.lit(False).alias("weight_only"))
    proposals = spark.createDataFrame([("a", 1, "extra")], "author_key string, chosen_lou long, more string")
    for c in set(tally.PROPOSAL) - set(proposals.columns):
        proposals = proposals.withColumn(c, none("string"))
    refused = spark.createDataFrame([("a", 2)], "author_key string, lou long")
    out, left, warnings = tally.recovered_weights(proposals, refused, candidates)
    assert not kept and out.columns == list(tally.PROPOSAL) and out.count() == left.count() == 1 and warnings.isEmpty()


def test_context_is_read_of_asked_posts_alone(spark):
    cands = spark.createDataFrame([("a", 1, 10, 12), ("a", 2, 11, 10), ("b", 3, 12, None), ("b", 4, 13, 99)], "author_key string, lou long, pid long, reply_to_pid long")
    read = spark.createDataFrame([(10, 1, "p", 1), (12, 3, "old", 1), (12, 5, "new", 2), (20, 9, "q", 3)], "pid long, lou long, content string, ord long")
    found = reply_context_posts(cands, read)
    assert [(r.author_key, r.pid, r.lou, r.content, r.linked_from_lous) for r in found.collect()] == [("a", 12, 5, "new", [1])]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
