"""Operators against plain versions and on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from odd_rows import ROWS
from sql_twins import same

from postloom.llm import bpe, katz, line_dedup, media, mixing, near_dedup, quality, queries, sharding, suffix_dedup, toxicity

TEXTS = [(r[0], r[1]) for r in ROWS]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- 1


def test_line_dedup(spark, docs, empty):
    out = line_dedup.dedup_lines(spark, docs, min_sites=3)
    got = {r.doc_id: (r.text, r.line_spread, r.line_removed) for r in out.collect() if r.doc_id in (1, 4, 5, 8, 9, 10)}
    assert got[8] == ("one own line here with words", 1, 1)
    assert got[9][0] == "another own line there with words"
    assert got[1][0] == dict(TEXTS)[1]
    assert got[4] == (None, 0, 0)
    assert got[5] == ("", 0, 0)
    assert out.count() == len(ROWS)
    assert set(docs.columns) < set(out.columns)
    assert line_dedup.dedup_lines(spark, empty).count() == 0


def test_line_dedup_near_threshold(spark):
    """Lines on n sites for every n around the threshold: exact counts decide."""
    rows = [(100 * n + s, f"line {n}\nown {n} {s} words that are its own", f"s{s}") for n in range(1, 15) for s in range(n)]
    out = line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=8).collect()
    assert all((r.line_removed == 1) == (r.doc_id // 100 >= 8) for r in out)


def test_line_dedup_copies(spark):
    """Copies stay whole: all lines spread, or three in a row and more than half of the words. Short pages of mixed boilerplate are cleaned."""
    body = [f"body line {k} with six words" for k in range(4)]
    rows = [(s, "\n".join([*body, f"own {s}"]), f"s{s}") for s in range(9)]
    rows += [(100 + s, f"top line here\nown words {s}\nfoot line here", f"s{s}") for s in range(9)]
    rows += [(200 + s, "top line here\n\nfoot line here", f"s{s}") for s in range(2)]
    rows += [(300, "\n".join([*body[:3], "plenty of own words " * 9]), None)]
    got = {r.doc_id: (r.text, r.line_spread, r.line_removed) for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == (rows[3][1], 4, 0)
    assert got[104] == ("own words 4", 2, 2)
    assert got[200] == (rows[18][1], 2, 0)
    assert got[300] == ("plenty of own words " * 9, 3, 3)


def test_line_dedup_null_source_is_a_site(spark):
    rows = [(k, "the same line\nown " + str(k), s) for k, s in enumerate(["", None, "a"])]
    out = line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=3)
    assert {r.line_removed for r in out.collect()} == {1}


@pytest.mark.parametrize("name", ["op1_site_spread_lines", "op7_pareto_mix"])
def test_same_as_sql(spark, duck, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


# --- 2


def test_toxicity_held_out(spark):
    words = [f"plain{k}" for k in range(400)]
    pick = np.random.default_rng(5)
    bad = ["grobian", "grobianer", "lump", "lumpig", "schuft"]
    rows, labels = [], []
    for k in range(1200):
        text = list(pick.choice(words, 40))
        if k % 6 == 0:
            text[3], text[20] = pick.choice(bad, 2)
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxicity(spark, docs, marks).withColumn("held", toxicity.held_out()).collect()
    assert all(r.held == (brute.remainder(r.doc_id, 3) == 1) for r in out)
    held = [r for r in out if r.held]
    assert sum((r.toxicity >= 0.7) == (r.doc_id % 6 == 0) for r in held) >= 0.98 * len(held)
    flipped = marks.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.toxicity for r in toxicity.toxicity(spark, docs, flipped).collect()}
    assert all(again[r.doc_id] == r.toxicity for r in out)


def test_toxicity_rare_language(spark):
    """A word of 12 in 1,000 toxic rows is an entry; the own word of a family of near copies is not."""
    pick = np.random.default_rng(6)
    rows = []
    for k in range(3000):
        few = k % 3 == 0 and k < 36 or k % 3 and k < 150
        text = list(pick.choice([f"{'otro' if few else 'plain'}{j}" for j in range(300)], 40))
        if k % 3 == 0:
            text[7] = "palurdo" if few else pick.choice(["grobian", "lump", "schuft"])
        rows.append((k, " ".join(text), int(k % 3 == 0)))
    copy = [f"plain{j}" for j in range(100)] + ["grobian", "zebra"]
    rows += [(3000 + k, " ".join([f"x{k}", *copy]), 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(spark, docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    asked = [(1, "otro1 otro2 palurdo otro3"), (2, "plain1 plain2 zebra plain3"), (3, "plain4 lump plain5"), (4, "otro4 otro5 otro6")]
    got = {r.doc_id: r.toxicity >= 0.7 for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_label_model_weighs_copies_less():
    votes = np.zeros((400, toxicity.VOTERS + len(toxicity.PATTERNS)), bool)
    votes[:40, :3] = True
    votes[:40, -3] = True
    votes[40:, -1] = True
    posterior, rates, shared = toxicity.label_model(votes)
    assert posterior[:40].min() > 0.7 > 0.3 > posterior[40:].max()
    assert rates[1, 0] > rates[0, 0]
    assert shared.shape == (votes.shape[1],) * 2


def test_toxicity_odd_rows(spark, docs, labels, empty):
    out = toxicity.toxicity(spark, docs, labels)
    assert out.count() == len(ROWS)
    assert all(0 <= r.toxicity <= 1 for r in out.collect())
    assert toxicity.toxicity(spark, empty, labels).count() == 0
    assert toxicity.toxicity(spark, docs, labels.where("false")).count() == len(ROWS)


# --- 3


def components(texts, width, percent):
    sets = {}
    for k, t in texts:
        w = brute.words(t)
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    least = {k: k for k in sets}

    def find(k):
        while least[k] != k:
            k = least[k]
        return k

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_near_dedup_families(spark):
    """Chains and families of texts whose similarities lie around the threshold."""
    pick = np.random.default_rng(9)
    base = [f"b{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 90):
        text = rows[pick.integers(len(rows))][1].split(" ") if k % 3 else list(base)
        for at in pick.integers(0, len(text), pick.integers(0, 9)):
            text[at] = f"x{pick.integers(1000)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark, docs, 3, 85).collect()}
    assert got == components(rows, 3, 85)


def test_near_dedup_odd_rows(spark, docs, empty):
    out = near_dedup.near_duplicates(spark, docs, 3, 85)
    rows = rows_of(out)
    assert len(rows) == len(ROWS)
    want = components([t for t in TEXTS if t[0] is not None], 3, 85)
    assert all((r[1], r[2]) == want[r[0]] for r in rows if r[0] is not None)
    assert all(r[2] is None and r[3] for r in rows if r[0] is None)
    assert near_dedup.near_duplicates(spark, empty).count() == 0


def test_near_dedup_rows_of_one_id(spark):
    """An id with two texts joins what either is linked with."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (2, b), (9, a), (7, c), (7, ""), (8, c), (4, c + " c60")]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == [(2, 58, 2, True), (4, 59, 4, True), (5, 58, 2, False), (5, 58, 2, False), (7, 0, 4, False), (7, 58, 4, False), (8, 58, 4, False), (9, 58, 2, False)]


def test_bands_of_a_threshold():
    for percent in (50, 70, 80, 85, 90, 95):
        rows = near_dedup.band_rows(percent)
        assert (1 - (percent / 100) ** rows) ** (120 // rows) <= 1e-6
    assert [near_dedup.band_rows(p) for p in (80, 85)] == [4, 5]
    for rows in (4, 5):  # which band each value falls in
        band = np.arange(120) % (120 // rows)
        assert (band[:60] != band[60:][np.roll(np.arange(60), -1)]).all()


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_of_a_table(spark, width, percent):
    """All pairs of the small table, as brute force finds them: every link there is."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    assert got == components(rows, width, percent)


# --- 4


def test_quality(spark, docs, labels, empty):
    out = quality.quality(spark, docs, labels)
    assert out.count() == len(ROWS)
    for r in out.collect():
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        covered = {i + d for i, x in enumerate(windows) if often[x] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)
        assert not (r.base_failed and r.kept)
    assert quality.quality(spark, empty, labels).count() == 0
    assert quality.quality(spark, docs, labels.where("false")).count() == len(ROWS)


def test_quality_ratio(spark):
    """llr against a plain version over the same buckets."""
    from pyspark.sql import functions as F

    rows = [(k, " ".join(f"{'good' if k % 2 else 'junk'}{(k * j) % 17}" for j in range(60))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(1, 40, 4)], "doc_id long, quality int")
    n = 1 << 17
    grams = {r.doc_id: r.g for r in quality.with_words(docs).select("doc_id", quality.buckets(F.col("_w"), n).alias("g")).collect()}
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for k in range(1, 40, 4) for b in grams[k])
    ratio = {b: round(1e6 * math.log((target[b] + 0.5) / (target.total() + 0.5 * n) / ((raw[b] + 0.5) / (raw.total() + 0.5 * n)))) for b in raw}
    out = quality.quality(spark, docs, labels).collect()
    for r in out:
        assert abs(r.llr - sum(ratio[b] for b in grams[r.doc_id]) / len(grams[r.doc_id]) / 1e6) < 2e-6
    assert {r.doc_id for r in out if not r.base_failed and r.kept} <= {k for k in range(1, 40, 2)}


# --- 5


def removed(texts, length):
    raw = [(t or "").encode() for _, t in texts]
    starts = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if starts[x[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(x), int(gone.sum()), np.frombuffer(x, np.uint8)[~gone].tobytes()))
    return out


def test_suffix_dedup(spark, docs, empty):
    got = sorted((r.n_bytes, sum(s.b - s.a for s in r.spans), bytes(r.rest)) for r in suffix_dedup.dedup_substrings(spark, docs, 100).collect())
    assert got == sorted(removed(TEXTS, 100))
    assert suffix_dedup.dedup_substrings(spark, empty).count() == 0


def test_suffix_dedup_hot_anchor(spark, monkeypatch):
    """The way for anchors with very many segments gives the same."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{'x' * k} start {k * k} {passage} end {k * 31}") for k in range(12)]
    out = suffix_dedup.dedup_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string"), 100).orderBy("doc_id").collect()
    assert [(r.n_bytes, sum(s.b - s.a for s in r.spans), bytes(r.rest)) for r in out] == removed(rows, 100)


def test_suffix_dedup_anchors_apart(spark):
    """Texts equal but for the middle, periodic texts, and passages that begin anywhere: as brute force says."""
    pick = np.random.default_rng(3)
    word = lambda n: " ".join(f"q{int(x)}" for x in pick.integers(0, 9000, n))
    left, right, passage = word(12), word(12), word(50)
    rows = [(k, f"{left} {word(14)} {right}") for k in range(12)]
    rows += [(100 + k, f"{word(k)} {passage[k:]} {word(5)}") for k in range(12)]
    rows += [(200, "ab" * 300), (201, "ab" * 150 + "c" + "ab" * 150), (202, "abcdefg " * 60), (203, word(20) + "abcdefg " * 40)]
    out = suffix_dedup.dedup_substrings(spark, spark.createDataFrame(rows, "doc_id long, text string"), 100).orderBy("doc_id").collect()
    assert [(r.n_bytes, sum(s.b - s.a for s in r.spans), bytes(r.rest)) for r in out] == removed(rows, 100)


def test_collection_order():
    pick = np.random.default_rng(2)
    for _ in range(60):
        segments = [bytes(pick.choice(list(b"ab"), pick.integers(1, 12)).astype(np.uint8)) for _ in range(pick.integers(1, 8))]
        suffixes = sorted(((s[i:], k, i) for k, s in enumerate(segments) for i in range(len(s) + 1)), key=lambda x: [(c + 1, 0) for c in x[0]] + [(0, x[1])])
        bwt, lcp = suffix_dedup.collection_order(segments)
        assert bwt.tolist() == [segments[k][i - 1] if i else suffix_dedup.NOTHING for _, k, i in suffixes]
        pairs = zip(suffixes, suffixes[1:], strict=False)
        assert lcp.tolist() == [0] + [next((n for n, (p, q) in enumerate(zip(x[0], y[0], strict=False)) if p != q), min(len(x[0]), len(y[0]))) for x, y in pairs]


# --- 6


def test_katz(spark, docs, empty):
    from pyspark.sql import functions as F

    small = docs.where("doc_id is null or doc_id <> 7")
    train = F.col("doc_id") % 2 == 0
    model = brute.Katz([t for k, t in TEXTS if k is not None and k != 7 and k % 2 == 0])
    for r in katz.score_texts(spark, small, train, passes=2).collect():
        if r.doc_id is None:
            continue
        n, known, base, score = model.score(dict(TEXTS)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, model.n)
        assert abs(r.base_score - base) < 1e-6
        assert abs(r.score - score) < 1e-6
    assert katz.score_texts(spark, empty, train, passes=1).count() == 0
    for history in ("\t", "v1", "unseen"):
        assert abs(sum(model.prob(history, w) for w in model.c) + model.alpha.get(history, 1.0) * model.unseen - 1) < 1e-9


@pytest.mark.parametrize("frequent", [4, 1 << 17])
def test_katz_rare_and_frequent_words(spark, monkeypatch, frequent):
    """Words and pairs known to all tasks and those asked for by bucket; one id with two texts; equal texts on both sides of the split."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(katz, "FREQUENT", frequent)
    pick = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{int(x)}" for x in pick.zipf(1.3, pick.integers(0, 60)) if x < 300)) for k in range(120)]
    rows += [(7, "w1 w2 another text of id seven"), (1000, rows[4][1]), (1001, rows[4][1]), (1002, None), (1003, "UNSEEN w1 Never")]
    model = brute.Katz([t for k, t in rows if k % 3])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in katz.score_texts(spark, docs, F.col("doc_id") % 3 != 0, passes=2).collect())
    assert got == sorted((k, n, known, round(base, 6), round(score, 6)) for k, (n, known, base, score) in ((k, model.score(t)) for k, t in rows))


# --- 7


def test_targets_by_hand(spark):
    """Weights 1, 2, 3 over sizes: targets by plain resharing."""
    for sizes in ([100, 100, 100], [1000, 10, 10], [5, 500, 50, 5000, 0], [7]):
        weight, bound = [1 + k % 3 for k in range(len(sizes))], [3 * s for s in sizes]
        want, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
        while True:
            level = left / sum(weight[k] for k in free) if free else 0
            full = {k for k in free if bound[k] < level * weight[k]}
            if not full:
                break
            for k in full:
                want[k], left = float(bound[k]), left - bound[k]
            free -= full
        for k in free:
            want[k] = level * weight[k]
        table = spark.createDataFrame([(f"=s{k}", s) for k, s in enumerate(sizes)], "mix_group string, mix_source_size long")
        got = {r.mix_group: r.mix_target for r in mixing.targets(table, (1, 2, 3), 1.0, 3.0).collect()}
        assert all(abs(got[f"=s{k}"] - w) < 1e-6 for k, w in enumerate(want))


def test_mix(spark, docs, empty):
    big = spark.createDataFrame([(k, "w " * (1 + k % 13), f"s{k % 5}" if k % 7 else None) for k in range(4000)], "doc_id long, text string, source string")
    out = mixing.mix_sources(spark, big).collect()
    again = {r.doc_id: r.mix_copies for r in mixing.mix_sources(spark, big.repartition(7)).collect()}
    assert all(again[r.doc_id] == r.mix_copies and 0 <= r.mix_copies <= 3 for r in out)
    for source in {r.source for r in out}:
        rows = [r for r in out if r.source == source]
        assert abs(sum(r.mix_size * r.mix_copies for r in rows) - rows[0].mix_target) <= 7
    assert mixing.mix_sources(spark, docs).count() == len(ROWS)
    assert mixing.mix_sources(spark, empty).count() == 0


# --- 8


def test_shards(spark, docs, empty):
    big = spark.createDataFrame([(k, f"t{k % 50}") for k in range(5003)], "doc_id long, text string")
    for df, n in ((big, 5003), (docs, len(ROWS))):
        out = sharding.shard(spark, df).collect()
        slots: dict = {}
        for r in out:
            slots.setdefault(r.ring_shard, []).append(r.ring_slot)
        assert len(out) == n
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - (min(map(len, slots.values())) if len(slots) == 40 else 0) <= 1
    assert sharding.shard(spark, empty).count() == 0


def test_ring_moves_little():
    """One more shard: most cells keep their shard, and overflow goes clockwise."""
    a, b = sharding.ring(40, 128), sharding.ring(41, 128)
    assert set(b[a != b]) == {40}
    assert (a != b).mean() < 0.06
    owner = np.zeros(sharding.CELLS, int)
    owner[100:200] = 1
    counts = np.zeros(sharding.CELLS, int)
    counts[50] = 10
    assert sharding.placed(counts, owner, np.array([4, 6])) == [(50, 0, 4, 0, 0), (50, 4, 10, 1, 0)]


# --- 9


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path)
    out = bpe.bpe_decode(bpe.bpe_encode(docs, path), path)
    for r in out.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert bpe.bpe_encode(empty, path).count() == 0
    one = bpe.tokenizer(path)
    pick = np.random.default_rng(4)
    for _ in range(400):
        text = "".join(pick.choice(list("abe th\n'sréñ中\U0001f642\x1c\x85  12.!?<|"), 40))
        assert np.frombuffer(one.encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


# --- 10


def test_media(spark, docs, empty):
    out = media.media_columns(spark, docs)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    by_id = dict(TEXTS)
    for r in rows:
        if r.doc_id is None:
            continue
        payload = media.padded((by_id[r.doc_id] or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((by_id[r.doc_id] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.width * r.height, r.bit_depth) == (len(payload), 8)
        assert r.media_sha256 == r.digest
    assert len({r.media_sha256 for r in rows if r.doc_id in (1, 2)}) == 1
    assert media.media_columns(spark, empty).count() == 0


@pytest.mark.parametrize("operator", [lambda s, d, lab: line_dedup.dedup_lines(s, d), lambda s, d, lab: quality.quality(s, d, lab), lambda s, d, lab: mixing.mix_sources(s, d), lambda s, d, lab: sharding.shard(s, d), lambda s, d, lab: toxicity.score(d, toxicity.ToxicityModel(np.zeros(0, np.uint64), np.zeros(6), np.zeros((2, 17)), np.eye(17)))])
def test_columns_stay(spark, docs, labels, operator):
    """Names that operators use on the way, and those of their helpers, are a user's own; made ones are replaced."""
    names = ["_note", "_t1", "_w", "_text", "mix_id", "mix_rank", "below", "cut", "ring_key", "ring_cell", "own0", "hits", "lines", "row", "t1", "worded"]
    wide = docs.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in names], "1 as toxicity", "1 as llr", "1 as line_count", "1 as mix_size", "1 as ring_shard")
    out = operator(spark, wide, labels)
    assert set(wide.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert {(r.doc_id, *(r[n] for n in names)) for r in out.collect()} == {(r.doc_id, *(r[n] for n in names)) for r in wide.collect()}


# --- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    assert len(p.STAGES) == 5
    rows = p.run(spark, sf_dir)
    assert rows.count() > 0
    assert all(r.decoded_sha256 for r in rows.limit(5).collect())


def test_pipeline_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline as p

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in p.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns, name
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert ids == sorted({r[0] for r in ROWS if r[0] is not None} - {2, 3})
