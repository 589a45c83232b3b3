"""Hard negatives, exact dedup and periodic runs against plain versions and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import FOLD, WORD
from odd_rows import ROWS
from sql_twins import same

from postloom.llm import cover_tree, exact_dedup, hard_negatives, near_dedup, queries, runs
from postloom.llm.store import shared_folder


@pytest.mark.parametrize("name", ["op11_cover_tree_negatives", "op12_heavy_hitter_dedup"])
def test_same_as_sql(spark, duck, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


# --- 11


def plain_negatives(rows, is_anchor, k=5):
    """rows: (vec_id, embedding, label)."""
    sound = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in sound:
        if not is_anchor(a[0]):
            continue
        order = sorted(((-score(a, b), b[0], b[1]) for b in sound if b != a))
        for minus, positive, _ in [x for x in order if x[2] == a[1]][:k]:
            fit = [x for x in order if x[2] != a[1] and 80 * -minus <= 100 * -x[0] <= 100 * -minus][:k]
            out += [(a[0], positive, n, x[1], -minus, -x[0]) for n, x in enumerate(fit, 1)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, rank int, asker string, score double"


def mined(spark, rows, anchor=lambda i: i % 10 == 0):
    df = spark.createDataFrame([(*r, 7, "a", 0.5) for r in rows], VECTORS).repartition(3)
    return hard_negatives.hard_negatives(spark, df, anchor)


def clustered(pick, n, clusters, width, labels, spread=0.05):
    centres = pick.normal(size=(clusters, width)) * pick.uniform(0.2, 3, (clusters, 1))
    of = pick.integers(0, clusters, n)
    x = (centres[of] + spread * pick.normal(size=(n, width))).astype(np.float32)
    return [(k, v.tolist(), int(pick.integers(labels))) for k, v in enumerate(x)]


def test_hard_negatives(spark):
    """Clusters of different norms, a vector that a third of the rows share, repeated rows, rows of one id."""
    pick = np.random.default_rng(3)
    rows = clustered(pick, 500, 20, 8, 4)
    rows += [(1000 + k, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0, 0.125, 1.0], int(k % 3)) for k in range(250)]
    rows += [rows[10], rows[10], (20, [0.5] * 8, 1), (20, [0.5] * 8, 2)]
    got = Counter(map(tuple, mined(spark, rows).collect()))
    assert got == plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(got) > 500


def test_hard_negatives_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0], 1), (2, [0.9, 0.6, 0.0], 2), (3, [], 2), (None, [1.0, 1.0], 1), (4, None, 1), (5, [1.0, None], 2), (6, [1.0, float("nan")], 2)]
    rows += [(7, [1.0, float("-inf")], 2), (8, [0.95, 0.5], None), (10, [-1.0, 0.0], 3), (11, [-1.0, 0.25], 3), (12, [-0.9, 0.0], 2), (20, [0.0, 0.0], 5), (21, [0.0, 0.0], 5), (30, [3e30, 1.0], 6), (-40, [0.5, 0.5], 9)]
    got = Counter(map(tuple, mined(spark, [r for r in rows if r[0] != 30]).collect()))
    assert got == plain_negatives([r for r in rows if r[0] != 30], lambda i: i % 10 == 0)
    mined(spark, rows).collect()  # huge components are held, nothing overflows into a crash
    none = mined(spark, rows).sparkSession.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(spark, none, lambda i: i % 10 == 0).collect() == []
    assert mined(spark, rows, lambda i: i == 77).collect() == []


def test_cover_tree_bounds_and_levels():
    """Every node covers its rows, children halve the radius, bounds hold, and few rows of clustered data are verified."""
    pick = np.random.default_rng(4)
    x = np.floor(256 * np.array([r[1] for r in clustered(pick, 6000, 60, 12, 1, 0.01)]))
    tree = cover_tree.build(x)
    assert np.array_equal(x[tree.order], tree.vectors)
    q = x[::500] + 3
    low, high = tree.bounds(q, np.linalg.norm(q, axis=1), slice(0, len(tree.radius)))
    points = cover_tree.augmented(tree.vectors, tree.norm)
    assert len(tree.radius) > 60
    for k, (a, b) in enumerate(zip(tree.begin, tree.end, strict=True)):
        assert np.linalg.norm(points[a:b] - tree.centres[k], axis=1).max() <= tree.radius[k] + 1e-6
        scores = q @ tree.vectors[a:b].T
        assert (scores >= low[:, k : k + 1]).all() and (scores <= high[:, k : k + 1]).all()
        first, last = tree.children[k]
        assert first == last or (tree.radius[first:last] <= tree.radius[k] + 1e-6).all() and tree.begin[first] == a and tree.end[last - 1] == b
    seen = []
    asked = cover_tree.Asked(q.astype(np.int64), np.full(len(q), -(10**9)), np.full(len(q), 10**9), 5)
    cover_tree.search(tree, asked, lambda n, rows, scores: (seen.append(len(rows)), (scores, tree.order[rows]))[1])
    want = [sorted(zip((-(v @ x.T)).astype(int).tolist(), range(len(x)), strict=True))[:5] for v in q]
    assert asked.best == want
    assert sum(seen) < len(q) * len(x) / 10


# --- 12


def plain_dedup(rows):
    """rows: (doc_id, text); the rows that the operator gives."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(FOLD)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        for n, i in enumerate(sorted(ids, key=lambda i: i != best)):
            out[(i, best, len(ids), n == 0, digest)] += 1
    return out


@pytest.mark.parametrize("hitters", [4, 4096])
def test_exact_dedup(spark, hitters):
    pick = random.Random(8)
    rows = [(k, pick.choice(["Hot text", "hOT TEXT", "HOT text", f"own {k}", f"pair {k // 2}", None, "", "Été", "été", "long " * 5000])) for k in range(400)]
    rows += [(399, rows[399][1]), (None, "Hot text"), (None, None), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = exact_dedup.exact_dedup(spark, docs, hitters=hitters)
    got = Counter((r.doc_id, r.copy_keep, r.copy_count, r.copy_kept, r.copy_digest) for r in out.collect())
    assert got == plain_dedup(rows)


def test_exact_dedup_odd_rows(spark, docs, empty):
    clash = docs.withColumnsRenamed({"kept": "copy_kept", "label": "row", "slot": "digest"}).withColumnRenamed("n_chars", "size")
    out = exact_dedup.exact_dedup(spark, clash)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "size", "score", "copy_kept", "row", "digest", "copy_digest", "copy_keep", "copy_count"}
    got = Counter((r.doc_id, r.copy_keep, r.copy_count, r.copy_kept, r.copy_digest) for r in out.collect())
    assert got == plain_dedup([(r[0], r[1]) for r in ROWS])
    assert {(r.row, r.digest) for r in out.collect()} == {("l", "s")}
    assert exact_dedup.exact_dedup(spark, empty).count() == 0


def test_misra_gries():
    """Never more than n / (size + 1) short, in batches of any size; whatever is more frequent is there."""
    pick = random.Random(9)
    for size in (1, 3, 10):
        held, true = exact_dedup.MisraGries(size), Counter()
        for _ in range(60):
            batch = [bytes([int(pick.paretovariate(0.7)) % 50]) for _ in range(pick.randrange(40))]
            held.add(batch)
            true.update(batch)
        n = sum(true.values())
        assert len(held.counts) <= size
        assert all(true[k] - n / (size + 1) <= held.counts[k] <= true[k] for k in true)


# --- 13


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, periodic=True):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if periodic and doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def wordy(pick):
    """Texts of few words, many of them in runs."""
    w: list[str] = []
    while len(w) < pick.randrange(1, 90):
        block = [pick.choice("aAbcé") for _ in range(pick.randrange(1, 7))]
        w += (block * pick.randrange(1, 9))[: pick.randrange(1, 40)]
    return pick.choice(["", " "]) + "".join(x + pick.choice([" ", "\n", "\t ", "\r\n"]) for x in w)


def test_runs(spark):
    pick = random.Random(11)
    rows = [(k, wordy(pick)) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = runs.mark_runs(spark, docs, periodic=True, carry=["doc_id"], digests=True)
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got == {k: plain_row(k, t) for k, t in rows}
    assert sum(r[1] for r in got.values()) > 1000


def test_runs_full_outputs(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b a y"), (2, "a  a a a a a")], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.mark_runs(spark, docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 9, 2)]
    assert got[1].collapsed == "x a b y"
    assert got[2].collapsed == "a"
    assert (got[2].run_start, got[2].run_length, got[2].run_period) == (0, 6, 1)


def test_runs_of_long_texts():
    """Chains that make lists long: one word, two words, nested periods; time grows about with the length."""
    for w in (np.zeros(60_000), np.arange(60_000) % 2, np.tile(np.repeat([0, 1], 40), 700)):
        found = runs.find_runs(w.astype(np.uint64), np.array([0, len(w)]))
        assert (found[:, 1].max() == len(w)) and len(found) < 3_000


def test_runs_odd_rows(spark, docs, empty):
    clash = docs.withColumnsRenamed({"kept": "runs", "slot": "collapsed", "label": "start"})
    out = runs.mark_runs(spark, clash, periodic=True)
    assert sorted(out.columns) == sorted([*{*clash.columns} - {"runs", "collapsed"}, *runs.MADE])
    digests = runs.mark_runs(spark, clash, periodic=True, carry=["doc_id"], digests=True)
    got = Counter(tuple(r) for r in digests.collect())
    assert got == Counter(plain_row(r[0], r[1]) for r in ROWS if r[0] != 7) + Counter(r for r in got if r[0] == 7)
    assert out.count() == len(ROWS)
    assert runs.mark_runs(spark, empty).count() == 0


def test_runs_query(spark, sf_dir):
    """The query over the whole table against the plain version."""
    got = {r[0]: tuple(r) for r in queries.op13_maximal_pair_runs(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for k in [k for k, t in texts.items() if len(t or "") < 40_000]:
        doc, n, start, length, period, lists, rest = plain_row(k, texts[k])
        assert got[k] == (doc, n, start, length, period, None if period is None else 1000 * length // period, lists, rest)


# --- 3


def test_components(spark):
    """Stars whose centre is the greatest node, chains, rings, single links and a link of a node with itself."""
    pick = random.Random(12)
    links = [(999, k) for k in range(500, 600)] + [(k, k + 1) for k in range(2000, 2060)] + [(3000 + k, 3000 + (k + 1) % 9) for k in range(9)] + [(7, 7), (5, 4)]
    links += [(pick.randrange(4000, 4400), pick.randrange(4000, 4400)) for _ in range(250)]
    least = {n: n for pair in links for n in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.label for r in near_dedup.components(spark, df, shared_folder(spark)).collect()}
    assert got == least
    assert near_dedup.components(spark, df.where("false"), shared_folder(spark)).count() == 0


def test_transform_sorts_what_a_round_adds_alone(monkeypatch):
    """The transform and common prefixes as of sorted suffixes; no sort takes more than one symbol of each segment."""
    from postloom.llm import suffix_dedup

    rng = np.random.default_rng(5)
    segments = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(0, 30, 25)]
    sizes, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sizes.append(len(x)) or argsort(x, *a, **k))
    bwt, lcp = suffix_dedup.collection_order(segments)
    assert max(sizes) <= len(segments)
    suffixes = sorted((s[k:], -1 if k == len(s) else 0, n, k) for n, s in enumerate(segments) for k in range(len(s) + 1))
    shared = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    assert lcp.tolist() == [0, *(shared(x[0], y[0]) for x, y in zip(suffixes, suffixes[1:], strict=False))]
    # equal suffixes are in no fixed order, so symbols are compared among these
    before = lambda text: sorted(suffix_dedup.NOTHING if k == 0 else segments[n][k - 1] for t, _, n, k in suffixes if t == text)
    at = 0
    for text in dict.fromkeys(t for t, *_ in suffixes):
        want = before(text)
        assert sorted(bwt[at : at + len(want)].tolist()) == want
        at += len(want)
    assert at == len(bwt)
