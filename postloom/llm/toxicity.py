"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Features of a text are its distinct letter runs (A-Z folded) and their first four, five
and six bytes, as 64-bit hashes; so inflected forms of one stem share features. Feature
counts over a bounded sample of labelled rows, near copies once, give a lexicon, which
is dealt to many voters; pattern voters look at shouting and at texts without any entry. The label model
sees votes alone: expectation-maximisation estimates how often each voter fires on either
class, and what voters share beyond the class lowers their weight. A linear classifier on
lexicon and pattern features is trained on the posteriors and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.bytehash import LETTER, Words, chunks, mix, text_bytes
from postloom.llm.near_dedup import near_duplicates
from postloom.llm.store import keep, shared_folder

PREFIXES = (4, 5, 6)
#: Rows of labels that the model is fitted on at most, entries of the lexicon, lexicon voters. The bound on entries keeps the
#: most telling ones; it bounds the model, which goes to all tasks, and no document.
SAMPLE, LEXICON, VOTERS = 16_000, 2_048, 12
#: A lexicon entry has so many toxic rows at least, near copies counted once, they are this share of its rows, and the
#: signed root of the likelihood ratio against the sample's share of toxic rows is this: one chance in 30,000.
ENTRY_ROWS, ENTRY_SHARE, ENTRY_Z = 4, 0.98, 4.0
#: Words of a shingle and percent of shared shingles that make rows near copies.
COPY_WIDTH, COPY_PERCENT = 3, 80
PATTERNS = ("shouted", "exclaims", "has_entry", "has_three", "no_entry")
_KINDS = np.array([0x1F83D9AB, 0x5BE0CD19, 0x3C6EF372, 0x510E527F], np.uint64)


def text_features(words: Words) -> np.ndarray:
    """(features, words): the word's own hash and those of its first bytes; 0 where the word is no longer than that."""
    out = np.zeros((1 + len(PREFIXES), len(words.starts)), np.uint64)
    out[0] = mix(words.hashes() ^ _KINDS[0])
    length = words.ends - words.starts
    for k, n in enumerate(PREFIXES, 1):
        out[k] = np.where(length > n, mix(words.hashes(most=n) ^ _KINDS[k]), 0)
    return out


def patterns(data: np.ndarray) -> tuple[bool, bool]:
    """Shouted: more than half of 20 or more ASCII letters are capitals. Exclaims: one byte in 50 is an exclamation mark."""
    upper = int(((data >= 65) & (data <= 90)).sum())
    lower = int(((data >= 97) & (data <= 122)).sum())
    return upper + lower >= 20 and upper > lower, len(data) > 0 and 50 * int((data == 33).sum()) >= len(data)


def _of_batch(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: features by word, where each text's words begin, bytes, where each text begins."""
    data, offsets = text_bytes(batch.column(column))
    for i, j in chunks(offsets):
        words = Words(data, offsets[i : j + 1], LETTER)
        yield text_features(words), words.first, words.data, words.offsets


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, flags = [], []
        for values, first, data, offsets in _of_batch(batch, "text"):
            for a, b, lo, hi in zip(first[:-1], first[1:], offsets[:-1], offsets[1:], strict=True):
                own = np.unique(values[:, a:b])
                features.append(own[own != 0].view(np.int64))
                flags.append(sum(1 << k for k, x in enumerate(patterns(data[lo:hi])) if x))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int64()), pa.array(features, pa.list_(pa.int64())), pa.array(flags, pa.int64())], names=["doc_id", "toxic", "features", "flags"])


def voters_of(hits: np.ndarray, flags: int) -> np.ndarray:
    """Which voters fire, given the lexicon entries that a text has and its pattern flags."""
    out = np.zeros(VOTERS + len(PATTERNS), bool)
    out[hits % VOTERS] = True
    out[VOTERS:] = flags & 1, flags >> 1 & 1, len(hits) > 0, len(hits) >= 3, len(hits) == 0
    return out


def label_model(votes: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row of votes, the voters' firing rates on both classes, and their correlations within a class.

    A voter that does not fire abstains. Begins with rows on which a lexicon voter fired.
    """
    fired = votes.astype(float)
    q = np.where(votes[:, :VOTERS].any(axis=1), 0.9, 0.02)
    weight = np.ones(votes.shape[1])
    rates = np.zeros((2, votes.shape[1]))
    shared = np.zeros((votes.shape[1],) * 2)
    for step in range(rounds):
        rates[1] = (q @ fired + 1e-2) / (q.sum() + 2e-2)
        rates[0] = ((1 - q) @ fired + 1e-2) / ((1 - q).sum() + 2e-2)
        if step == rounds // 2:  # correlations given the class; voters that say the same count as fewer
            cov = np.zeros_like(shared)
            for c, p in ((1, q), (0, 1 - q)):
                x = fired - rates[c]
                cov += (x * p[:, None]).T @ x
            sd = np.sqrt(np.diag(cov)) + 1e-9
            shared = cov / np.outer(sd, sd)
            weight = 1 / (1 + np.clip(shared - np.eye(len(sd)), 0, None).sum(axis=1))
        prior = np.clip(q.mean(), 1e-4, 0.5)
        logit = np.log(prior / (1 - prior)) + fired @ (weight * np.log(rates[1] / rates[0]))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q, rates, shared


def fit_linear(rows: list[np.ndarray], n: int, labels: np.ndarray, rounds: int = 1500, ridge: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression on sets of feature numbers, last one the bias, fitted to soft labels."""
    at = np.concatenate([np.empty(0, np.int64), *rows])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = -2.0
    for t in range(1, rounds + 1):
        z = np.bincount(of, w[at], len(rows)) + w[n]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / max(len(rows), 1)
        g = np.append(np.bincount(at, off[of], n), off.sum()) + ridge * np.append(w[:n], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class ToxicityModel:
    """Sorted lexicon hashes and the weights of lexicon, patterns and bias."""

    lexicon: np.ndarray
    weights: np.ndarray
    rates: np.ndarray
    correlations: np.ndarray

    def numbers(self, hits: np.ndarray, flags: int) -> np.ndarray:
        return np.concatenate((hits, len(self.lexicon) + np.flatnonzero(voters_of(hits, flags)[VOTERS:])))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> ToxicityModel:
    """labels: doc_id, toxic (0 or 1; others are left out). At most `most` labelled rows, by hash of doc_id, are used."""
    folder = shared_folder(spark)
    chosen = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = keep(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), f"{folder}/labels")
    # no more rows than `most`, so the sample is small enough to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text").distinct()
    texts = keep(texts.withColumn("doc_id", F.xxhash64("text")), f"{folder}/texts")
    families = near_duplicates(spark, texts, COPY_WIDTH, COPY_PERCENT).select("doc_id", F.col("component_id").alias("family")).distinct()
    sample = texts.mapInArrow(_sampled, "doc_id long, toxic long, features array<long>, flags long")
    sample = keep(sample.join(families, "doc_id"), f"{folder}/sample")
    # a family of near copies counts once for each label
    totals = sample.select("toxic", "family").distinct().agg(F.sum("toxic"), F.count("*")).first()
    t_all, c_all = (totals[0] or 0), totals[1] - (totals[0] or 0)
    counts = sample.select("toxic", "family", F.explode("features").alias("feature")).distinct().groupBy("feature").agg(F.sum("toxic").alias("t"), (F.count("*") - F.sum("toxic")).alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (t_all + 1 - t)) - F.log(c / (c_all + 1 - c))
    n, share = F.col("t") + F.col("c"), t_all / max(t_all + c_all, 1)
    part = lambda x, p: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (n * max(p, 1e-9)))).otherwise(0.0)
    ranked = counts.where(F.col("t") >= ENTRY_ROWS).where(F.col("t") >= ENTRY_SHARE * n).where(F.col("t") > share * n)
    ranked = ranked.where(2 * (part("t", share) + part("c", 1 - share)) >= ENTRY_Z**2).withColumn("z", odds / F.sqrt(1 / t + 1 / c))
    lexicon = ranked.orderBy(F.desc("z"), "feature").limit(LEXICON).select("feature")
    lexicon = np.sort(np.array([r[0] for r in lexicon.collect()], np.int64).view(np.uint64))
    entries = lexicon.view(np.int64).tolist()
    known = F.array_intersect("features", F.array(*[F.lit(x) for x in entries])) if entries else F.array().cast("array<long>")
    rows = sample.select("toxic", known.alias("features"), "flags").collect()
    hits = [np.searchsorted(lexicon, np.sort(np.array(r.features, np.int64).view(np.uint64))) for r in rows]
    votes = np.array([voters_of(h, r.flags) for h, r in zip(hits, rows, strict=True)]).reshape(len(rows), VOTERS + len(PATTERNS))
    model = ToxicityModel(lexicon, np.zeros(len(lexicon) + len(PATTERNS) + 1), np.zeros((2, votes.shape[1])), np.eye(votes.shape[1]))
    model.weights[-1] = -2.0
    if len(rows):
        posterior, model.rates, model.correlations = label_model(votes)
        model.weights = fit_linear([model.numbers(h, r.flags) for h, r in zip(hits, rows, strict=True)], len(lexicon) + len(PATTERNS), posterior)
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with `toxicity`, 0 to 1. Null and empty texts have no features and score by the bias and `no_entry`. No shuffle."""
    kept = [f for f in docs.schema.fields if f.name != "toxicity"]
    names = [f.name for f in kept]
    table = np.zeros(1 << 20, bool)
    table[(model.lexicon >> np.uint64(44)).astype(np.int64)] = True
    packed = np.packbits(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(packed).view(bool)
        for batch in batches:
            out = []
            for values, first, data, offsets in _of_batch(batch, "text"):
                near = np.flatnonzero(maybe[(values >> np.uint64(44)).astype(np.int64)].any(axis=0))
                found: dict[int, list[int]] = {}
                if len(near) and len(model.lexicon):
                    candidates = values[:, near]
                    at = np.minimum(np.searchsorted(model.lexicon, candidates), len(model.lexicon) - 1)
                    hit = model.lexicon[at] == candidates
                    text_of = np.searchsorted(first, near, "right") - 1
                    for k, text in zip(*np.nonzero(hit), strict=True):
                        found.setdefault(int(text_of[text]), []).append(int(at[k, text]))
                for k in range(len(first) - 1):
                    flags = sum(1 << i for i, x in enumerate(patterns(data[offsets[k] : offsets[k + 1]])) if x)
                    hits = np.unique(np.array(found.get(k, []), np.int64))
                    out.append(1 / (1 + np.exp(-np.clip(model.weights[model.numbers(hits, flags)].sum() + model.weights[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.float64())], names=[*names, "toxicity"])

    return docs.select(*names).mapInArrow(run, T.StructType([*kept, T.StructField("toxicity", T.DoubleType())]))


def held_out() -> Column:
    """Rows that labels are never learnt from: crc32 of doc_id as text leaves 1 when divided by 3; rows without an id too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, other columns) with `toxicity`; labels of held-out rows are not looked at.

    Only the text enters a score. Without usable labels all scores are low.
    """
    return score(docs, fit(spark, docs, labels.where(~held_out())))
