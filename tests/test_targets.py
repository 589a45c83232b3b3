"""Targets of hints against a plain version."""

from __future__ import annotations

import random
import re
import threading

from pyspark.sql import functions as F

from postloom import queries as core
from postloom.operators import grams, targets


def form(text: str | None) -> str:
    return re.sub("[^0-9a-z\u4e00-\u9fff]+", "", (text or "").lower())


def best(hints: dict, texts: dict) -> dict:
    """asker: (score, ties, target) over all pairs; askers without a match are left out."""
    out = {}
    forms = {k: form(t) for k, t in texts.items()}
    for asker, hint in hints.items():
        h = form(hint)
        score = {k: 0 if not h or not t else 300 if t == h else 240 if h in t else 120 if len(t) >= 4 and t in h else 0 for k, t in forms.items()}
        top = max(score.values(), default=0)
        if top:
            at = [k for k, s in score.items() if s == top]
            out[asker] = (top, len(at), at[0] if len(at) == 1 else None)
    return out


def test_all_documents_are_candidates(spark, sf_dir):
    hints = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.asker: (r.score, r.ties, r.target) for r in core.QUERIES["weighted_target"](spark, sf_dir).collect()}
    assert got == best(hints, texts)


def test_hints_of_two_topics(spark):
    """Ties, texts inside a hint, entries without a match, two topics."""
    rows = []
    for k in range(137):
        rows.append((k, f"t{k % 2}", f"Word {k % 40} x", None))
    for k in range(60):
        rows.append((1000 + k, f"t{k % 2}", None, [f"word{k}x", f"so word {k} x it is", f"rd{k}x", "", None][k % 5]))
    entries = spark.createDataFrame([(*r[:3], [], r[3]) for r in rows], "entry_id long, topic_id string, hint string, fields array<string>, content string")
    found = targets.weighted_targets(entries).collect()
    want = {}
    for topic in ("t0", "t1"):
        want |= best({r[0]: r[2] for r in rows if r[1] == topic and r[2]}, {r[0]: r[3] for r in rows if r[1] == topic and not r[2]})
    assert {r.asker: (r.score, r.ties, r.target) for r in found if r.score} == want
    assert len(found) == 137
    assert all(r.needs_manual_review == (r.target is None) for r in found)


def plain_score(h: str, fields: list[str], texts: dict[str, str]) -> int:
    """The score of a hint and a candidate's normal forms, read off the table of scores."""
    if not h:
        return 0
    if h in fields:
        return targets.FIELD_EQUAL
    best = max([0, *(targets.FIELD_HOLDS if h in v else targets.FIELD_INSIDE if len(v) >= 4 and v in h else 0 for v in fields)])
    for name, (same, holds) in targets.TEXT_SCORES.items():
        if name in texts:
            v = texts[name]
            if v == h:
                return same
            best = max(best, holds if h in v else targets.TEXT_INSIDE if len(v) >= 4 and v in h else 0)
    return best


def test_weighted_targets_of_random_texts(spark):
    """Hints and texts of 0 to 60 characters over few letters, one to three bytes each: every containment either way, topic by topic."""
    pick = random.Random(7)
    word = lambda most, letters: "".join(pick.choice(letters) for _ in range(pick.randrange(most)))
    rows, wanted = [], []
    for k in range(900):
        letters = pick.choice(["ab", "a猪b", "abcdef", "猪安价"])
        text = word(pick.choice([4, 9, 60]), letters)
        if pick.random() < 0.5 and rows:
            old = pick.choice(rows)
            base = old[2] or old[4]
            a = pick.randrange(len(base) + 1)
            text = pick.choice([base[a : a + pick.randrange(1, 40)], "x" + base + "y", base])
        asks = pick.random() < 0.3
        rows.append((k, pick.choice(["t", "u"]), text if asks else None, [word(12, letters) for _ in range(pick.randrange(3))], text, word(20, letters)))
    schema = "entry_id long, topic_id string, hint string, fields array<string>, content string, original_content string"
    got = {r.asker: (r.score, r.ties, r.target) for r in targets.weighted_targets(spark.createDataFrame(rows, schema).repartition(3), ("content", "original_content")).collect()}
    for asker, topic, hint, *_ in rows:
        if hint is None:
            continue
        h = form(hint)
        scores = {r[0]: plain_score(h, [form(x) for x in r[3]], {"content": form(r[4]), "original_content": form(r[5])}) for r in rows if r[2] is None and r[1] == topic}
        top = max(scores.values())
        same = [k for k, s in scores.items() if s == top]
        wanted.append((asker, (top, len(same), same[0] if len(same) == 1 else None) if top else (None, None, None)))
    assert got == dict(wanted)
    assert sum(x[1][2] is not None for x in wanted) > 50


def test_pairs_share_a_gram(spark):
    """Only pairs that share the needle's rarest gram are formed."""
    needles = spark.createDataFrame([(1, "t", "common words and then zebra"), (2, "t", "common words and then none"), (3, "u", "common")], "n long, w string, part string")
    texts = [(k, "t", f"common words and then {k} more") for k in range(50)] + [(100, "t", "so common words and then zebra it is"), (101, "u", "common"), (102, "t", ""), (103, "t", None)]
    texts = spark.createDataFrame(texts, "k long, w string, part string")
    assert {tuple(r) for r in grams.holders(needles, texts, "w", "n", "k").collect()} == {(1, 100), (3, 101)}
    assert grams.holders(needles.where("false"), texts, "w", "n", "k").count() == 0


def test_hot_hint(spark):
    """A third of all entries ask for the same, many texts hold it."""
    rows = [(k, "t", "加权 the same thing" if k % 3 == 0 else None, [], f"they say the same thing {k}" if k % 3 == 1 else f"other {k}") for k in range(3000)]
    entries = spark.createDataFrame(rows, "entry_id long, topic_id string, hint string, fields array<string>, content string").withColumn("hint", F.regexp_replace("hint", "加权 ", ""))
    got = targets.weighted_targets(entries).groupBy("score", "ties", "target", "note").count().collect()
    assert [tuple(r) for r in got] == [(240, 1000, None, "加权目标匹配到 1000 个同分候选", 1000)]


def test_replies_of_one_post_that_say_the_same(spark):
    """40,000 replies with a hint meet 40,000 proposals of one post: 1.6 billion pairs of rows, two of forms."""
    asks = spark.range(40_000).select(F.col("id").alias("lou"), F.lit(7).cast("long").alias("reply_to_pid"), F.lit("Al pha").alias("hint"))
    text = F.when(F.col("id") == 5, "alpha").otherwise("alphabet")
    offers = spark.range(40_000).select(F.col("id").alias("proposal_id"), F.lit("t").alias("topic_id"), F.array(F.lit(7).cast("long")).alias("source_pids"), F.array().cast("array<string>").alias("fields"), text.alias("normalized_anchor_text"), F.lit(False).alias("is_weight"))
    stop = threading.Timer(100, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        found = targets.reply_targets(asks, offers)
        assert found.agg(F.count("*"), F.countDistinct("lou"), F.min("target"), F.max("target"), F.min("score")).first()[:] == (40_000, 40_000, 5, 5, 320)
        alike = offers.where("proposal_id <> 5")
        assert targets.reply_targets(asks, alike).count() == 0
        assert {r[0] for r in targets.reply_failures(asks, alike).select("reason").distinct().collect()} == {"reply pid=7 存在 39999 个同分候选"}
    finally:
        stop.cancel()


def test_every_reply_without_a_hint_meets_every_proposal(spark):
    """More of both than a list holds, nulls and repeated rows among them."""
    n = targets.LIST * 2 + 10
    null_at = lambda k: F.when(F.col("id") != k, F.col("id"))
    asks = spark.range(n).select(null_at(3).alias("lou"), (F.col("id") % 2).alias("reply_to_pid"), F.lit(None).cast("string").alias("hint"), F.lit("x").alias("preview"))
    asks = asks.union(asks.where("lou = 4"))
    offers = spark.range(n).select(null_at(4).alias("proposal_id"), F.lit("t").alias("topic_id"), F.array(F.lit(0).cast("long"), F.lit(0).cast("long")).alias("source_pids"), F.array().cast("array<string>").alias("fields"), F.lit("x").alias("normalized_anchor_text"), F.lit(False).alias("is_weight"))
    want = asks.where("reply_to_pid = 0").select("lou").crossJoin(offers.select(F.col("proposal_id").alias("target")))
    got = targets.reply_targets(asks, offers)
    assert got.where("score is not null or match_text is not null").count() == 0
    assert got.count() == want.count() == (n // 2 + 1) * n
    assert got.select("lou", "target").exceptAll(want).isEmpty()


def test_pairs_of_lists_stay_small(spark):
    """Spark holds all rows of a pair of lists at once: few, also where a third of a post's askers and proposals have no id."""
    value = F.when(F.col("id") % 3 != 0, F.col("id"))
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("reply_to_pid"), value.alias("lou"))
    lists = [r[0] for r in targets._lists(rows, "lou").select("_lou").collect()]
    assert sorted(map(len, lists))[-1] <= 400 and sum(map(len, lists)) / len(lists) <= 200
    assert sorted(x or 0 for values in lists for x in values) == sorted(r[0] or 0 for r in rows.select("lou").collect())
    asks = rows.withColumns({"hint": F.lit(None).cast("string")})
    offers = rows.select(F.col("lou").alias("proposal_id"), F.lit("t").alias("topic_id"), F.array("reply_to_pid").alias("source_pids"), F.array().cast("array<string>").alias("fields"), F.lit("x").alias("normalized_anchor_text"), F.lit(False).alias("is_weight"))
    assert targets.reply_targets(asks, offers).agg(F.count("*"), F.count("lou"), F.count("target")).first()[:] == (9_000_000, 6_000_000, 6_000_000)
