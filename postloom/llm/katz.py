"""Language-model scoring with Katz backoff over word pairs.

P(w | v) is the discounted share of (v, w) where that pair was seen, else the backoff weight
of v times P(w); P(w) is the discounted share of w, and what the discounts leave is that of
all unseen words, one class. Backoff weights are exact: what the discounts of v leave, over
the unigram mass of the words not seen after v.

Counts are tables of blocks, partitioned by hash. In logarithms a seen pair is
disc(c(v, w)) + fit(v), where fit(v) makes the discounted counts of v a distribution, and
any other pair back(v) + P(w). Every pair of a training text has been seen, so such a text
asks for fit(v) by word and disc(c) by pair; other texts begin with back(v) + P(w) for every
token and learn of the pairs that were seen what to put in its place. The most frequent
words and pairs, tables of fixed size, are looked up where the text is read, so no pair's
entries fill one task. The work goes in passes over the histories' hashes, which bounds what
is on disk at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.blocks import Known, bucket_count, cells, gathered, groups, one_row, scattered, together
from postloom.llm.bytehash import Words, chunks, mix, text_bytes
from postloom.llm.store import drop, keep, lean_shuffles, shared_folder

#: So many of the most frequent words go to all tasks; so many pairs at most, those with that share of all tokens.
FREQUENT = 1 << 17
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Hashes that stand for the beginning and the end of a text.
BEGIN, END = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.uint64(0x9FB21C651E98DF25)
#: Tokens that a task holds before it hands them on.
FLUSH = 1 << 20

COUNTED = "bucket int, kind int, x array<long>, c array<int>, m array<double>"
PAIRS, HISTORIES, SPECTRUM, HEAVY = range(4)
ASKED = "bucket int, kind int, x array<long>, c array<int>, t array<long>, e array<double>, ht array<long>, hv array<long>, hw array<long>"
FOUND = "bucket int, t array<long>, score array<double>, vt array<long>, v array<long>, wt array<long>, w array<long>"


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _PAIR ^ w)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: number of the first, then history, token and text (from 0) of each token."""
    data, offsets = text_bytes(batch.column("text"))
    for i, j in chunks(offsets):
        words = Words(data, offsets[i : j + 1])
        w = np.insert(words.hashes(), words.first[1:], END)
        v = np.empty_like(w)
        v[1:] = w[:-1]
        n = np.diff(words.first) + 1
        v[np.cumsum(n) - n] = BEGIN
        yield i, v, w, np.repeat(np.arange(j - i), n)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flushed(held: list[np.ndarray]) -> pa.RecordBatch:
        x, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n, pa.int64())], names=["w", "n"])

    held, size = [], 0
    for batch in batches:
        for _, _, w, _ in _tokens(batch):
            held.append(w)
            size += len(w)
            if size >= FLUSH:
                yield flushed(held)
                held, size = [], 0
    if held:
        yield flushed(held)


def _bucket(x: np.ndarray, w: np.ndarray, frequent: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs of a rare word lie where the word lies, those of a frequent one are dealt by pair."""
    return ((np.where(frequent, x, w) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)


def pair_counts(part: int, parts: int, buckets: int, known: Broadcast):
    """Blocks (v, w, n) of the pairs whose history falls in the part; n is what one run of texts has."""

    def flushed(held: list) -> pa.RecordBatch:
        v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        x = pair_hash(v, w)
        order, head = groups(x)
        at = order[head]
        n = np.diff(np.append(head, len(x))).astype(np.int32)
        v, w = v[at], w[at]
        return scattered((_bucket(x[at], w, known.value.find(w)[1], buckets), {"v": v, "w": w, "n": n, "p": np.zeros(0)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, v, w, _ in _tokens(batch):
                mine = v % np.uint64(parts) == part
                held.append((v[mine], w[mine]))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flushed(held)
                    held, size = [], 0
        if size:
            yield flushed(held)

    return run


def rare_words(buckets: int, known: Broadcast):
    """Blocks (w, p) of the words that are not known to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, p = batch.column("w").to_numpy().view(np.uint64), batch.column("p").to_numpy()
            rare = ~known.value.find(w)[1]
            w, p = w[rare], p[rare]
            if len(w):
                yield scattered((_bucket(w, w, np.zeros(len(w), bool), buckets), {"v": np.zeros(0, np.int64), "w": w, "n": np.zeros(0, np.int32), "p": p}))

    return run


def _values(w: np.ndarray, known: Known, name: str, rare: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each word, from the table of frequent ones or from that of its bucket."""
    out, there = known.of(name, w)
    if not there.all():
        order = np.argsort(rare)
        out[~there] = values[order[np.searchsorted(rare, w[~there], sorter=order)]]
    return out


def counted(buckets: int, known: Broadcast, heavy: float):
    """Of each bucket: its pairs with their counts; of each history how many pairs have counts 1 to 5, and the unigram mass of its words; how many pairs have each count; pairs of at least `heavy` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = lambda k: {"kind": pa.scalar(k, pa.int32())}
        ints, floats = np.zeros(0, np.int32), np.zeros(0)
        for bucket, (v, w, n, p) in gathered(batches, ("v", "w", "n", "p")):
            v, w = v.view(np.uint64), w.view(np.uint64)
            rare, w = w[len(v) :], w[: len(v)]  # a bucket's rare words come after its pairs
            if not len(v):
                continue
            x = pair_hash(v, w)
            order, head = groups(x)
            c, at = np.add.reduceat(n[order], head).astype(np.int32), order[head]
            x, v, w = x[at], v[at], w[at]
            mass = _values(w, known.value, "p", rare, p)
            yield one_row(bucket, {"x": x, "c": c, "m": floats}, **kind(PAIRS))
            order, head = groups(v)
            few = np.stack([np.add.reduceat((c[order] == r).astype(np.int32), head) for r in range(1, DISCOUNTED + 1)], axis=1).astype(np.int32)
            v = v[order][head]
            yield scattered((((v >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32), {"x": v, "c": few.ravel(), "m": np.add.reduceat(mass[order], head)}), **kind(HISTORIES))
            yield one_row(bucket, {"x": x[:0], "c": ints, "m": np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3).astype(float)}, **kind(SPECTRUM))
            often = c >= heavy
            yield one_row(bucket, {"x": x[often], "c": c[often], "m": floats}, **kind(HEAVY))

    return run


def histories_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, n1 .. n5, mass) of each history."""
    for _, (v, few, mass) in gathered(batches, ("x", "c", "m")):
        order, head = groups(v)
        few = np.add.reduceat(few.reshape(-1, DISCOUNTED)[order], head, axis=0)
        mass = np.add.reduceat(mass[order], head)
        yield pa.RecordBatch.from_arrays([pa.array(v[order][head]), *(pa.array(few[:, r].astype(np.int64)) for r in range(DISCOUNTED)), pa.array(mass)], names=["v", *(f"n{r}" for r in range(1, DISCOUNTED + 1)), "mass"])


def discounts(spectrum: dict[int, int]) -> list[float]:
    """Good-Turing discount of counts 1 to 5 from the numbers of entries with each count.

    Where the numbers are too few or too odd for a discount within (0, 1), a count r keeps (r - 0.5) / r.
    """
    k, n = DISCOUNTED, lambda r: spectrum.get(r, 0)
    common = (k + 1) * n(k + 1) / n(1) if n(1) else 1.0
    out = []
    for r in range(1, k + 1):
        d = ((r + 1) * n(r + 1) / (r * n(r)) - common) / (1 - common) if n(r) and common < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def discounted(c: Column, d: list[float]) -> Column:
    out = c.cast("double")
    for r in range(DISCOUNTED, 0, -1):
        out = F.when(c == r, d[r - 1] * r).otherwise(out)
    return out


def log_discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.log10(np.where(c <= DISCOUNTED, c * np.array([1.0, *d])[np.minimum(c, DISCOUNTED)], c))


def spectrum(counts: DataFrame) -> dict[int, int]:
    """How many entries have each count up to 6."""
    rows = counts.where(F.col("c") <= DISCOUNTED + 1).groupBy("c").count().collect()
    return {r["c"]: r["count"] for r in rows}


def pair_lookups(part: int, parts: int, buckets: int, known: Broadcast, heavy: Broadcast, begin: tuple[float, float]):
    """Asks for the pairs whose history falls in the part, by bucket; sums over heavy pairs, as answers already, have bucket -1.

    Training texts ask with e = 0. Others ask with what a seen pair of frequent words changes
    beside its count; where a word is rare they name both.
    """
    ask = pa.scalar(1, pa.int32())
    empty, none = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def changed(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gain, has_v = known.value.of("gain", v)
        lp, has_w = known.value.of("lp", w)
        first = v == BEGIN
        return np.where(first, begin[0] - begin[1], gain) - lp, (has_v | first) & has_w

    def flushed(held: list) -> Iterator[pa.RecordBatch]:
        t, v, w, train = (np.concatenate(x) for x in zip(*held, strict=True))
        x = pair_hash(v, w)
        e, both = np.zeros(len(x)), np.ones(len(x), bool)
        other = np.flatnonzero(~train)
        e[other], both[other] = changed(v[other], w[other])
        ld, often = heavy.value.of("ld", x)
        often &= both  # a heavy pair has frequent words
        rest, key = ~often, t[often]
        order, head = groups(key)
        if len(head):
            value = ld[often] + e[often]
            yield scattered((np.full(len(head), -1, np.int32), {"x": empty, "c": none, "t": key[order][head], "e": np.add.reduceat(value[order], head), "ht": empty, "hv": empty, "hw": empty}), kind=ask)
        t, v, w, x, e, both = t[rest], v[rest], w[rest], x[rest], e[rest], both[rest]
        bucket = _bucket(x, w, known.value.find(w)[1], buckets)
        a, b = np.flatnonzero(both), np.flatnonzero(~both)
        if len(t):
            yield scattered((bucket[a], {"x": x[a], "c": none, "t": t[a], "e": e[a]}), (bucket[b], {"ht": t[b], "hv": v[b], "hw": w[b]}), kind=ask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column("t").to_numpy(zero_copy_only=False).view(np.uint64)
            learnt = batch.column("train").to_numpy(zero_copy_only=False)
            for first, v, w, doc in _tokens(batch):
                mine = v % np.uint64(parts) == part
                doc = first + doc[mine]
                held.append((keys[doc], v[mine], w[mine], learnt[doc]))
                size += len(doc)
                if size >= FLUSH:
                    yield from flushed(held)
                    held, size = [], 0
        if size:
            yield from flushed(held)

    return run


def answered(cells_of_text: int, known: Broadcast, begin: tuple[float, float], d: list[float]):
    """Sums by text over the pairs that were seen, by bucket of the text; and rare words whose values are still to be added. A bucket's counts come before what is asked of it."""
    empty = np.zeros(0, np.uint64)

    def seen_in(table: np.ndarray, counts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        seen = np.flatnonzero(table[at] == x)
        return seen, log_discounted(counts[at[seen]], d)

    def flushed(sums: list, firsts: list, seconds: list) -> Iterator[pa.RecordBatch]:
        t, value, vt, v, wt, w = (np.concatenate(x) if x else empty for held in (sums, firsts, seconds) for x in (list(zip(*held, strict=True)) or ([], [])))
        order, head = groups(t)
        t, value = t[order][head], np.add.reduceat(value[order], head) if len(head) else np.zeros(0)
        bucket = ((t >> np.uint64(16)) % np.uint64(cells_of_text)).astype(np.int32)
        none = np.zeros(len(vt), np.int32), np.zeros(len(wt), np.int32)
        yield scattered((bucket, {"t": t, "score": value}), (none[0], {"vt": vt, "v": v}), (none[1], {"wt": wt, "w": w}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, table, counts, size = None, empty, np.zeros(0, np.int32), 0
        held: tuple[list, list, list] = ([], [], [])
        for bucket, (x, c, t, e, ht, hv, hw) in cells(batches, ("x", "c", "t", "e", "ht", "hv", "hw")):
            if bucket != last:
                last, table, counts = bucket, empty, np.zeros(0, np.int32)
            x, t, ht, hv, hw = (y.view(np.uint64) for y in (x, t, ht, hv, hw))
            if len(c):  # sorted, one row a bucket
                table, counts = x, c
                continue
            if bucket < 0:
                held[0].append((t, e))
            elif len(table):
                seen, score = seen_in(table, counts, x)
                held[0].append((t[seen], score + e[seen]))
                seen, score = seen_in(table, counts, pair_hash(hv, hw))
                ht, hv, hw = ht[seen], hv[seen], hw[seen]  # what is frequent is added here
                gain, has_v = known.value.of("gain", hv)
                lp, has_w = known.value.of("lp", hw)
                first = hv == BEGIN
                held[0].append((ht, score + np.where(first, begin[0] - begin[1], gain) - lp))
                rare_v, rare_w = ~has_v & ~first, ~has_w
                held[1].append((ht[rare_v], hv[rare_v]))
                held[2].append((ht[rare_w], hw[rare_w]))
            size += len(t) + len(ht)
            if size >= FLUSH:
                yield from flushed(*held)
                held, size = ([], [], []), 0
        if size:
            yield from flushed(*held)

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, score), one row a text."""
    for _, (t, score) in gathered(batches, ("t", "score")):
        order, head = groups(t)
        yield pa.RecordBatch.from_arrays([pa.array(t[order][head]), pa.array(np.add.reduceat(score[order], head) if len(head) else score)], names=["t", "score"])


def word_sums(known: Broadcast, begin: tuple[float, float]):
    """(t, w, n, train, base, score): for each text one row of sums over frequent words (w null), and a row for each of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("t").to_numpy(zero_copy_only=False)
            learnt = batch.column("train").to_numpy(zero_copy_only=False)
            for first, _, w, doc in _tokens(batch):
                at, often = known.value.find(w)
                texts = int(doc[-1]) + 1
                train = learnt[first : first + texts]
                d, o = doc[often], at[often]
                value = lambda name: np.bincount(d, known.value.values[name][o], texts)
                score = np.where(train, value("fit") + begin[0], value("unseen") + begin[1])
                rare, of = w[~often], doc[~often]
                order = np.lexsort((rare, of))
                rare, of = rare[order], of[order]
                head = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])))) if len(of) else np.empty(0, np.int64)
                n = np.diff(np.append(head, len(of)))
                rows = first + np.concatenate((np.arange(texts), of[head]))
                zeros = np.zeros(len(head))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[rows]),
                        pa.concat_arrays([pa.nulls(texts, pa.int64()), pa.array(rare[head].view(np.int64))]),
                        pa.array(np.concatenate((np.bincount(d, minlength=texts), n)).astype(np.int32)),
                        pa.array(learnt[rows]),
                        pa.array(np.concatenate((value("base"), zeros))),
                        pa.array(np.concatenate((score, zeros))),
                    ],
                    names=["t", "w", "n", "train", "base", "score"],
                )

    return run


def least_frequent(words: DataFrame) -> int:
    """The least count of which, with all greater ones, at most FREQUENT words are. Counts are told by sixteenths of powers of two, so no words are sorted."""
    bins = words.groupBy(F.floor(16 * F.log2("c")).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("bin")).collect()
    least, total = 1 << 62, 0
    for r in bins:  # no more than 1,024
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["least"]
    return int(least)


def told_apart(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """docs with t, 64 bits of the text that no other text of docs shares, and (t, copies)."""
    for seed in range(16):
        keyed = docs.withColumns({"t": F.xxhash64(F.lit(seed), "text"), "t2": F.xxhash64(F.lit("text"), F.lit(seed), "text")})
        texts = keep(keyed.groupBy("t").agg(F.count("*").alias("copies"), F.min("t2").alias("lo"), F.max("t2").alias("hi")), f"{folder}/texts{seed}")
        if texts.where("lo <> hi").isEmpty():
            return keyed.drop("t2"), texts.select("t", "copies")
    raise RuntimeError("no hash tells the texts apart")


def score_texts(spark: SparkSession, docs: DataFrame, train: Column, passes: int = 2) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text, any other columns).

    Counts are learnt from the rows for which `train` holds (null: it does not). Tokens are
    A-Z-folded words, then one end. Null and empty texts are one end. Each row gets the
    values of its own text, whatever its doc_id, null ids and repeated ids included; a
    repeated row counts each time. With nothing to train on, every token is unseen and
    scores log10(1). An empty table gives an empty one. Every text is counted and scored whole.
    """
    with lean_shuffles(spark):
        return _score_texts(spark, docs, train, passes)


def _score_texts(spark: SparkSession, docs: DataFrame, train: Column, passes: int) -> DataFrame:
    folder = shared_folder(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    docs, copies = told_apart(docs, folder)
    learnt = docs.where("train").select("text")
    read = docs.select("t", "train", "text")

    words = keep(learnt.mapInArrow(word_counts, "w long, n long").groupBy("w").agg(F.sum("n").alias("c")), f"{folder}/counts")
    size = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, vocabulary = int(size["n"] or 0), int(size["v"])
    d1 = discounts(spectrum(words))
    words = keep(words.select("w", "c", (discounted(F.col("c"), d1) / F.lit(float(max(tokens, 1)))).alias("p")), f"{folder}/unigrams")
    drop(spark, f"{folder}/counts")
    seen = float(words.agg(F.sum("p")).first()[0] or 0.0)
    unseen = max(1.0 - seen, 1.0 / (tokens + 1))  # with no count to discount, one token's share is kept back
    scale = (1.0 - unseen) / seen if seen else 1.0
    words = words.withColumn("p", F.col("p") * F.lit(scale))
    least = least_frequent(words)
    top = words.where(F.col("c") >= least).select("w", "p").toPandas()
    share = spark.sparkContext.broadcast
    known = share(Known(top["w"].to_numpy(np.int64).view(np.uint64), p=top["p"].to_numpy(float)))

    buckets = bucket_count(spark, tokens // passes)
    rare = keep(words.select("w", "p").mapInArrow(rare_words(buckets, known), "bucket int, v array<long>, w array<long>, n array<int>, p array<double>"), f"{folder}/rare")
    tables, histories = [], None
    numbers: dict[int, int] = {}
    heavy_x, heavy_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for part in range(passes):
        pairs = learnt.mapInArrow(pair_counts(part, passes, buckets, known), "bucket int, v array<long>, w array<long>, n array<int>, p array<double>")
        both = pairs.withColumn("kind", F.lit(0)).unionByName(rare.withColumn("kind", F.lit(1)))
        table = together(both, "kind").select("bucket", "v", "w", "n", "p").mapInArrow(counted(buckets, known, max(tokens / FREQUENT, 2)), COUNTED)
        table = keep(table, f"{folder}/table{part}")
        tables.append(table.where(F.col("kind") == PAIRS))
        for r in table.where(F.col("kind") == SPECTRUM).select(F.posexplode("m").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect():
            numbers[r["c"]] = numbers.get(r["c"], 0) + int(r["n"])
        # at most FREQUENT pairs have that share of all tokens
        for r in table.where((F.col("kind") == HEAVY) & (F.size("x") > 0)).select("x", "c").collect():
            heavy_x.append(np.array(r["x"], np.int64))
            heavy_c.append(np.array(r["c"], np.int32))
        own = together(table.where(F.col("kind") == HISTORIES).select("bucket", "x", "c", "m"))
        own = keep(own.mapInArrow(histories_of, "v long, n1 long, n2 long, n3 long, n4 long, n5 long, mass double"), f"{folder}/histories{part}")
        histories = own if histories is None else histories.unionByName(own)
    drop(spark, f"{folder}/rare")
    known.destroy()
    d2 = discounts(numbers)

    # a history's tokens are as many as its own, the beginning's as many as there are texts
    texts = learnt.count()
    lost = sum((F.col(f"n{r}") * (r * (1 - d2[r - 1])) for r in range(1, DISCOUNTED + 1)), F.lit(0.0))
    rows = words.join(histories.withColumnRenamed("v", "w"), "w", "full").withColumn("of", F.coalesce("c", F.lit(texts)))
    kept = F.col("of") - lost
    # a history whose counts are all above the discounted ones gives up one count in `of` + 1
    left = F.greatest(1 - kept / F.col("of"), 1 / (F.col("of") + 1))
    rows = rows.withColumns({"left": left, "kept": kept})
    line = float(tokens + vocabulary + 1)
    rows = rows.select(
        "w",
        "c",
        F.log10((F.col("c") + 1) / line).alias("base"),
        F.log10("p").alias("lp"),
        # the end is no history
        F.when(F.col("mass").isNull(), 0.0).otherwise(F.log10((1 - F.col("left")) / F.col("kept"))).alias("fit"),
        F.when(F.col("mass").isNull(), 0.0).otherwise(F.log10(F.col("left") / F.greatest(1 - F.col("mass"), F.lit(unseen)))).alias("back"),
    )
    rows = keep(rows, f"{folder}/words")
    for part in range(passes):
        drop(spark, f"{folder}/histories{part}")
    drop(spark, f"{folder}/unigrams")
    of_begin = rows.where(F.col("w") == int(BEGIN.astype(np.int64))).select("fit", "back").first()
    begin = (float(of_begin[0]), float(of_begin[1])) if of_begin else (0.0, 0.0)
    words = rows.where("c is not null")
    # fit and unseen: what a token adds to a training text's score and another's; gain and lp: what a seen pair changes
    top = words.where(F.col("c") >= least).select("w", "base", "lp", "fit", (F.col("lp") + F.col("back")).alias("unseen"), (F.col("fit") - F.col("back")).alias("gain")).toPandas()
    known = share(Known(top["w"].to_numpy(np.int64).view(np.uint64), **{k: top[k].to_numpy(float) for k in ("base", "lp", "fit", "unseen", "gain")}))
    heavy = share(Known(np.concatenate(heavy_x).view(np.uint64), ld=log_discounted(np.concatenate(heavy_c), d2)))

    cells_of_text = max(8, -(-tokens // passes // FLUSH))
    sums, asked = [], []
    for part, table in enumerate(tables):
        ask = read.mapInArrow(pair_lookups(part, passes, buckets, known, heavy, begin), ASKED)
        both = table.select("bucket", F.lit(0).alias("kind"), "x", "c").unionByName(ask, allowMissingColumns=True)
        empty = [F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("t", "array<long>"), ("e", "array<double>"), ("ht", "array<long>"), ("hv", "array<long>"), ("hw", "array<long>"))]
        # sums over heavy pairs are dealt over the buckets, each after its own
        given = F.col("bucket") < 0
        both = both.select(F.when(given, F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")).otherwise(F.col("bucket")).alias("bucket"), F.when(given, 2).otherwise(F.col("kind")).alias("kind"), "x", "c", *empty)
        found = together(both, "kind").select(F.when(F.col("kind") == 2, -1 - F.col("bucket")).otherwise(F.col("bucket")).alias("bucket"), "x", "c", "t", "e", "ht", "hv", "hw")
        found = keep(found.mapInArrow(answered(cells_of_text, known, begin, d2), FOUND), f"{folder}/found{part}")
        drop(spark, f"{folder}/table{part}")
        of_text = together(found.where(F.size("t") > 0).select("bucket", "t", "score")).mapInArrow(summed, "t long, score double")
        sums.append(keep(of_text, f"{folder}/sums{part}"))
        pairs = {"v": F.arrays_zip(F.col("vt").alias("t"), F.col("v").alias("w")), "w": F.arrays_zip(F.col("wt").alias("t"), F.col("w").alias("w"))}
        more = [found.where(F.size(name) > 0).select(F.explode(column).alias("x")).select("x.t", "x.w", F.lit(name).alias("as")) for name, column in pairs.items()]
        asked.append(keep(more[0].unionByName(more[1]), f"{folder}/asked{part}"))
        drop(spark, f"{folder}/found{part}")

    by_word = keep(read.mapInArrow(word_sums(known, begin), "t long, w long, n int, train boolean, base double, score double"), f"{folder}/by_word")
    rest = by_word.where("w is not null").select("t", "w", "n", F.when(F.col("train"), "train").otherwise("other").alias("as"))
    for more in asked:
        rest = rest.unionByName(more.withColumn("n", F.lit(1)))
    rest = rest.join(words.hint("shuffle_hash"), "w", "left")
    token = F.col("as").isin("train", "other")
    score = (
        F.when(F.col("as") == "train", F.col("fit"))
        .when(F.col("as") == "other", F.coalesce("lp", F.lit(float(np.log10(unseen)))) + F.coalesce("back", F.lit(0.0)))
        .when(F.col("as") == "v", F.col("fit") - F.col("back"))
        .otherwise(-F.col("lp"))
    )
    rest = rest.select(
        "t",
        F.when(token, F.col("n")).otherwise(0).alias("n_tokens"),
        F.when(token & F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("n_known"),
        F.when(token, F.col("n") * F.coalesce("base", F.lit(float(-np.log10(line))))).otherwise(0.0).alias("base_score"),
        (F.col("n") * score).alias("score"),
    )
    often = by_word.where("w is null").select("t", F.col("n").alias("n_tokens"), F.col("n").alias("n_known"), F.col("base").alias("base_score"), "score")
    total = often.unionByName(rest)
    for part in sums:
        total = total.unionByName(part.select("t", F.lit(0).alias("n_tokens"), F.lit(0).alias("n_known"), F.lit(0.0).alias("base_score"), "score"))
    names = ("n_tokens", "n_known", "base_score", "score")
    total = total.groupBy("t").agg(*[F.sum(c).alias(c) for c in names]).join(copies, "t")
    total = keep(total.select("t", *[(F.col(c) / F.col("copies")).alias(c) for c in names]), f"{folder}/total")
    known.destroy()
    heavy.destroy()
    for name in ("by_word", "words", *(f"{x}{part}" for part in range(passes) for x in ("asked", "sums"))):
        drop(spark, f"{folder}/{name}")
    out = docs.select("doc_id", "t").join(total, "t")
    return out.select("doc_id", F.round("n_tokens").cast("long").alias("n_tokens"), F.round("n_known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
