"""Periodic runs of words by enumeration of maximal pairs.

Each text's suffixes are ordered by prefix doubling over its words. The tree of LCP
intervals is walked bottom-up; an interval holds the places of its suffixes in order, each
with its left word's class. Two places of different children and different classes are a
maximal pair: the words that they share end where the interval does, on the left they
cannot grow. A pair q apart that shares l >= max(6 - q, 3 * q) words is a stretch of
length q + l with period q that no neighbour extends, so nothing has to be grown.

By the periodicity lemma a run's pair are neighbours among the places of its interval (a
place between them would give a smaller period), so a merge looks at the neighbours of each
place of the smaller list only. Runs of one stretch whose period is a multiple of the
smallest one are taken out at the end. Only places whose next or previous equal five words
are no farther than a third of what they share with any other suffix can be in a pair;
all others enter no list.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.bytehash import PLAIN, Words, chunks, text_bytes
from postloom.shipping import ship

#: A run has so many words and so many periods at least; SHARED is the least that its pair shares.
LEAST, TIMES = 6, 4
SHARED = min(max(LEAST - q, (TIMES - 1) * q) for q in range(1, LEAST + 1))

MADE = ("run_count", "run_start", "run_length", "run_period", "runs", "collapsed")


def suffix_order(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in the order of their suffixes, each up to its text's end, and the names of 1, 2, 4, ... words from each place.

    Equal words of different texts have different numbers, so no two texts share a prefix.
    """
    n = len(words)
    names = [np.unique(words, return_inverse=True)[1].astype(np.int64) + 1]
    while True:
        step = 1 << (len(names) - 1)
        after = np.arange(n) + step
        inside = after < ends
        key = names[-1] * np.int64(n + 1)
        key[inside] += names[-1][after[inside]]
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        names.append(rank)
        if fresh.all():
            return order, names


def shared_prefixes(order: np.ndarray, names: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """How many words each suffix shares with the one before it in order; 0 for the first."""
    a, b = order[:-1].copy(), order[1:].copy()
    n, got = len(order), np.zeros(max(len(order) - 1, 0), np.int64)
    last_a, last_b = ends[a], ends[b]
    for k in range(len(names) - 1, -1, -1):
        there = (a < last_a) & (b < last_b)
        same = there & (names[k][np.minimum(a, n - 1)] == names[k][np.minimum(b, n - 1)])
        step = np.where(same, 1 << k, 0)
        a, b, got = a + step, b + step, got + step
    return np.concatenate((np.zeros(min(n, 1), np.int64), got))


def near_places(names: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """Distance from each place to the nearest other one where the same SHARED words stand; a large number where there is none."""
    n = len(ends)
    long = min(SHARED.bit_length() - 1, len(names) - 1)
    rest = np.arange(n) + SHARED - (1 << long)
    key = names[long] * np.int64(n + 1) + np.where(rest < ends, names[long][np.minimum(rest, n - 1)], 0)
    order = np.argsort(key, kind="stable")
    gap = np.where(key[order[1:]] == key[order[:-1]], order[1:] - order[:-1], np.int64(1 << 40))
    near = np.full(n, 1 << 40, np.int64)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    return near


def maximal_pairs(places: list[int], shared: list[int], left: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, distance, words shared) of the pairs that are runs. places: in suffix order; shared: with the next one."""
    found: list[tuple[int, int, int]] = []

    def pair(i: int, j: int, common: int) -> None:
        q = j - i
        if common >= (TIMES - 1) * q and common >= LEAST - q and left[i] != left[j]:
            found.append((i, q, common))

    def merged(one: list[int], other: list[int], common: int) -> list[int]:
        few, many = (one, other) if len(one) < len(other) else (other, one)
        for j in few:
            at = bisect_left(many, j)
            if at:
                pair(many[at - 1], j, common)
            if at < len(many):
                pair(j, many[at], common)
        if len(few) < 8:
            for j in few:
                many.insert(bisect_left(many, j), j)
        else:
            many.extend(few)
            many.sort()
        return many

    open_: list[tuple[int, list[int]]] = []  # what each list shares with the one to its right, rising
    for place, common in zip(places, shared, strict=True):
        held = [place]
        while open_ and open_[-1][0] >= common:
            inner, before = open_.pop()
            held = merged(before, held, inner)
        if common >= SHARED:
            open_.append((common, held))
        else:
            open_.clear()
    return found


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs by start, then period. words: of several texts; first: where each begins, and the end.

    Starts count over all texts; no run crosses from one into another.
    """
    n = len(words)
    if n < LEAST:
        return np.empty((0, 3), np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends = first[1:][text]
    by_word = np.lexsort((words, text))
    fresh = np.concatenate(([True], (words[by_word[1:]] != words[by_word[:-1]]) | (text[by_word[1:]] != text[by_word[:-1]])))
    numbers = np.empty(n, np.int64)
    numbers[by_word] = np.cumsum(fresh)
    order, names = suffix_order(numbers, ends)
    common = shared_prefixes(order, names, ends)
    following = np.append(common[1:], 0)
    near = near_places(names, ends)
    at = np.flatnonzero(near[order] * (TIMES - 1) <= np.maximum(common, following))
    if len(at) < 2:
        return np.empty((0, 3), np.int64)
    # what two listed suffixes share is the least of all that lie between them
    between = np.append(np.minimum.reduceat(following, at)[:-1], 0)
    left = np.where(np.isin(np.arange(n), first[:-1]), -1, np.concatenate(([-1], numbers[:-1])))
    pairs = maximal_pairs(order[at].tolist(), between.tolist(), left)
    if not pairs:
        return np.empty((0, 3), np.int64)
    start, period, words_shared = np.array(pairs, np.int64).T
    length = period + words_shared
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    least = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))
    runs = np.stack((start, length, period), axis=1)[least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def remapped(n: int, h: int) -> np.ndarray | None:
    """The word that stands at each place of a text that is made periodic, None for one that is not."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of each text joined by one space, all texts in one string, and where each begins and ends in it. first: as in find_runs."""
    sizes = ends - starts
    spaced = sizes + 1
    spaced[(first[1:] - 1)[np.diff(first) > 0]] -= 1
    edges = np.concatenate(([0], np.cumsum(spaced)))
    source = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], spaced)
    out = np.append(data, np.uint8(32))[np.minimum(source, len(data))]
    out[(edges[:-1] + sizes)[spaced > sizes]] = 32
    return out.tobytes(), edges[first]


def _runs_of(batch: pa.RecordBatch, periodic: bool) -> Iterator[tuple[np.ndarray, bytes]]:
    """Each row's runs, with starts in the text, and what is left when repeats go."""
    data, offsets = text_bytes(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    for i, j in chunks(offsets):
        words = Words(data, offsets[i : j + 1])
        first = words.first
        source = np.arange(len(words.starts))
        for k in range(i, j) if periodic else ():
            lo, hi = first[k - i], first[k - i + 1]
            places = None if ids[k] is None else remapped(int(hi - lo), zlib.crc32(str(ids[k]).encode()))
            if places is not None:
                source[lo:hi] = lo + places
        runs = find_runs(words.hashes(PLAIN)[source], first)
        steps = np.zeros(len(source) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        stays = np.flatnonzero(np.cumsum(steps)[:-1] == 0)
        rest, edges = joined(words.data, words.starts[source[stays]], words.ends[source[stays]], np.searchsorted(stays, first))
        of = np.searchsorted(runs[:, 0], first)
        for k in range(j - i):
            mine = runs[of[k] : of[k + 1]].copy()
            mine[:, 0] -= first[k]
            yield mine, rest[edges[k] : edges[k + 1]]


def _marked(periodic: bool, carried: list[str], digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                best, lists, rest = [], [], []
                for runs, left in _runs_of(part, periodic):
                    top = max(runs.tolist(), key=lambda r: (r[1], -r[0], -r[2]), default=[None] * 3)
                    best.append((len(runs), *top))
                    if digests:
                        lists.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist()).encode()).hexdigest())
                        rest.append(hashlib.sha256(left).hexdigest())
                    else:
                        lists.append([{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()])
                        rest.append(left.decode())
                columns = [pa.array(c, pa.int64()) for c in zip(*best, strict=True)] if best else [pa.array([], pa.int64())] * 4
                kind = pa.string() if digests else pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *columns, pa.array(lists, kind), pa.array(rest, pa.string())], names=[*carried, *MADE])

    return run


def mark_runs(spark: SparkSession, docs: DataFrame, periodic: bool = False, carry: list[str] | None = None, digests: bool = False) -> DataFrame:
    """docs (doc_id, text, other columns; or of them those in `carry`) with run_count, the longest run as run_start, run_length, run_period, and runs and collapsed.

    Words are stretches of characters other than white space, numbered from 0. A run is a
    stretch of max(6, 4 * q) words or more with smallest period q that no neighbour extends.
    runs lists all by start, then period; of runs of one length the longest is the one that
    starts first. collapsed is the text without the words that any run repeats, joined by
    one space. With `digests` both are replaced by their SHA-256 in lowercase hex, runs as
    `start,length,period` lines. With `periodic` texts whose crc32(doc_id) is divisible by
    10 are made periodic first, as op13 asks; those without a doc_id stay as they are.

    Null and empty texts, and those of fewer than six words, have no runs and nulls for the
    longest. Each row is judged by itself, so repeated rows come back alike and an empty
    table gives an empty one. Texts of any length are used whole, each in one task. Columns
    of docs with the made names are replaced, all others stay.
    """
    ship(spark)
    carried = [c for c in (carry or docs.columns) if c not in MADE]
    inside = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, "doc_id", "text"])])
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    kinds = [*[T.LongType()] * 4, T.StringType() if digests else T.ArrayType(run), T.StringType()]
    schema = T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(c, k) for c, k in zip(MADE, kinds, strict=True))])
    return inside.mapInArrow(_marked(periodic, carried, digests), schema)
