"""Removal of byte strings that are repeated anywhere in the corpus, by collection suffix order.

Windows are first dealt by content: the least hash of any 64 bytes in a 200-byte window (its
anchor) is the same wherever the window stands, so only anchors that occur twice can hold
repeats, and all occurrences of a window meet under one anchor. Runs of windows with one
anchor are cut out as short segments; equal ones are one. The bytes around an anchor that
all its segments share and all their windows hold are named by three symbols, which makes
segments shorter and keeps anchors apart. The segments of a block are a collection of documents whose
Burrows-Wheeler transform and common prefixes are built column by column: each round puts
one symbol of every segment, from the right, into both sequences and updates the common
prefixes of what it has put in. Suffixes next to each other that share a window are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.bytehash import _BASE, _BASE_INVERSE, _power, _values, chunks, mix, text_bytes
from postloom.llm.store import drop, keep, partitions, shared_folder

ANCHOR = 64
#: Segments of a block; distinct segments from which an anchor is resolved window by window.
BLOCK, HOT = 500, 20_000
NOTHING, NAME = 255, 254  # no bytes of UTF-8


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` bytes."""
    n = len(data)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_values[data] * _power("up", _BASE, n)[:n], out=sums[1:])
    return mix((sums[width:] - sums[: n - width + 1]) * _power("down", _BASE_INVERSE, n + 1)[: n - width + 1])


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours."""
    n = len(h)
    if n < width:
        return np.empty(0, np.uint64)
    blocks = np.full(-(-n // width) * width, ~np.uint64(0), np.uint64)
    blocks[:n] = h
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored_runs(length: int):
    """(k1, k2, anchor, start, run, at, twice): `run` windows from `start` on share an anchor, which stands `at` bytes after the start and is in them more than once or not."""
    reach = length - ANCHOR + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            data, offsets = text_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                lo, at = int(offsets[i]), offsets[i : j + 1] - offsets[i]
                hashes = window_hashes(data[lo : int(offsets[j])], ANCHOR)
                least = sliding_min(hashes, reach)
                n = np.maximum(np.diff(at) - length + 1, 0)  # windows of each text
                if not n.sum():
                    continue
                doc = np.repeat(np.arange(j - i), n)
                start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                anchor = least[at[doc] + start]
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
                head = np.flatnonzero(new)
                since = np.arange(len(new)) - np.repeat(head, np.diff(np.append(head, len(new))))
                head = np.flatnonzero(since % reach == 0)  # a periodic text keeps its anchor for long
                runs = np.diff(np.append(head, len(new)))
                times, place = _occurrences(hashes, anchor[head], at[doc[head]] + start[head], runs + reach - 1)
                place = (place - at[doc[head]] - start[head]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[i + doc[head]]), pa.array(k2[i + doc[head]]), pa.array(anchor[head].view(np.int64)), pa.array(start[head].astype(np.int32)), pa.array(runs.astype(np.int32)), pa.array(place), pa.array(times > 1)],
                    names=["k1", "k2", "anchor", "start", "run", "at", "twice"],
                )

    return run


def _occurrences(hashes: np.ndarray, value: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each value is among hashes[start : start + width], where it always is, and its first place."""
    values = np.unique(value)
    maybe = np.zeros(1 << 16, bool)
    maybe[(values >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(hashes >> np.uint64(48)).astype(np.int64)])
    found = np.minimum(np.searchsorted(values, hashes[at]), len(values) - 1)
    right = values[found] == hashes[at]
    keys = np.sort(found[right].astype(np.int64) << 32 | at[right])
    low = np.searchsorted(values, value).astype(np.int64) << 32 | start
    first = np.searchsorted(keys, low)
    return np.searchsorted(keys, low + width) - first, keys[first] & 0xFFFFFFFF


def cut_segments(length: int):
    """(k1, k2, anchor, start, digest, segment, at, n, twice) for a text's list of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                k1, k2 = batch.column("k1")[row], batch.column("k2")[row]
                raw = batch.column("text")[row].as_py().encode()
                runs = batch.column("runs")[row].as_py()
                parts = [raw[r["start"] : r["start"] + r["run"] + length - 1] for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k1.as_py()] * len(runs), pa.int64()),
                        pa.array([k2.as_py()] * len(runs), pa.int64()),
                        pa.array([r["anchor"] for r in runs], pa.int64()),
                        pa.array([r["start"] for r in runs], pa.int32()),
                        pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in parts], pa.binary()),
                        pa.array(parts, pa.binary()),
                        pa.array([r["at"] for r in runs], pa.int32()),
                        pa.array([r["n"] for r in runs], pa.int64()),
                        pa.array([r["twice"] for r in runs], pa.bool_()),
                    ],
                    names=["k1", "k2", "anchor", "start", "digest", "segment", "at", "n", "twice"],
                )

    return run


def collection_order(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of the collection and common prefixes of neighbours in suffix order.

    Position k < len(segments) is the empty suffix of segment k. Round j puts the suffixes
    of length j in place: the symbol before each suffix of length j - 1 is written at that
    suffix's place, and by its rank among equal symbols tells where the longer suffix goes.
    The symbols written so far are held with their places as one sorted array, into which
    each round merges its own, so that no round sorts all of them.
    """
    count = len(segments)
    lengths = np.array([len(s) for s in segments])
    text = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum(lengths)
    total = count + int(lengths.sum())
    kind, bits = (np.uint32, 24) if total < 1 << 24 else (np.int64, 40)
    low = kind((1 << bits) - 1)
    lcp, old = np.zeros(total + 1, np.int16), np.ones(total, bool)
    keys = np.empty(0, kind)  # symbol, place
    who, place, size = np.arange(count), np.arange(count), count
    for j in range(1, int(lengths.max(initial=0)) + 1):
        stays = lengths[who] >= j
        who, place = who[stays], place[stays]
        fresh = text[ends[who] - j].astype(kind) << kind(bits) | place.astype(kind)
        order = np.argsort(fresh)
        who, fresh = who[order], fresh[order]
        step = np.arange(len(fresh))
        at = np.searchsorted(keys, fresh) + step
        keys = _inserted(keys, at, fresh, old)
        place, symbol = (fresh & low).astype(np.int64), fresh >> kind(bits)
        # common prefix with the suffix before: one more than the least between both parents
        last, up = keys[np.maximum(at - 1, 0)], keys[np.minimum(at + 1, len(keys) - 1)]
        has_last = (at > 0) & (last >> kind(bits) == symbol)
        has_next = (at + 1 < len(keys)) & (up >> kind(bits) == symbol)
        last, up = (last & low).astype(np.int64), (up & low).astype(np.int64)
        before = np.where(has_last, 1 + _least(lcp, np.where(has_last, last + 1, 0), np.where(has_last, place + 1, 1)), 0)
        after = np.where(has_next, 1 + _least(lcp, np.where(has_next, place + 1, 0), np.where(has_next, up + 1, 1)), 0)
        place = count + at
        grown = size + len(place)
        # places move by as many as are put in before them
        keys += np.repeat(np.arange(len(place) + 1, dtype=kind), np.diff(place - step, prepend=0, append=size))[keys & low]
        lcp[:grown] = _inserted(lcp[:size], place, before, old)
        follows = place + 1
        inside = follows < grown
        lcp[follows[inside]] = after[inside]  # those put in this round as well get the same value below
        lcp[place] = before
        size = grown
    bwt = np.full(size, NOTHING, np.uint8)
    bwt[keys & low] = keys >> kind(bits)
    return bwt, lcp[:size]


def _inserted(x: np.ndarray, at: np.ndarray, values: np.ndarray, true: np.ndarray) -> np.ndarray:
    """x with the values put in, which stand at `at` then. true: all true, and long enough."""
    out = np.empty(len(x) + len(at), x.dtype)
    true[at] = False
    out[true[: len(out)]] = x
    true[at] = True
    out[at] = values
    return out


def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of x[lo:hi] for each pair."""
    order = np.argsort(lo, kind="stable")
    pairs = np.empty(2 * len(lo), np.int64)
    pairs[0::2], pairs[1::2] = lo[order], hi[order]
    out = np.empty(len(lo), np.int64)
    out[order] = np.minimum.reduceat(x, pairs)[0::2]
    return out


def repeated_windows(segments: list[bytes], need: np.ndarray) -> list[np.ndarray]:
    """For each segment, which of its windows of `need` symbols stand elsewhere in the collection too."""
    bwt, lcp = collection_order(segments)
    count, lengths = len(segments), np.array([len(s) for s in segments])
    shared = np.maximum(lcp, np.append(lcp[1:], 0))
    rank = np.empty(len(bwt), np.int64)
    rank[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    windows = lengths - need + 1
    first = np.cumsum(windows) - windows
    flags = np.zeros(int(windows.sum()), bool)
    who, place = np.arange(count), np.arange(count)
    for j in range(1, int(lengths.max(initial=0)) + 1):  # from each suffix to the one that is a symbol longer
        stays = lengths[who] >= j
        who, place = who[stays], place[stays]
        place = count + rank[place]
        whole = need[who] <= j
        of = who[whole]
        flags[first[of] + lengths[of] - j] = shared[place[whole]] >= need[of]
    return np.split(flags, first[1:])


def named(rows: list[tuple[bytes, int]], length: int, name: bytes) -> tuple[list[bytes], int]:
    """Segments of one anchor, each with the anchor's place, in which the name stands for what all of them and all their windows hold; and the symbols of a window then."""
    # all windows of a segment hold its bytes from the last window's start to the first one's end
    before = min(at + length - len(x) for x, at in rows)
    after = min(length - ANCHOR - at for _, at in rows)
    left = len(commonprefix([x[at - before : at][::-1] for x, at in rows]))
    right = len(commonprefix([x[at + ANCHOR : at + ANCHOR + after] for x, at in rows]))
    return [x[: at - left] + name + x[at + ANCHOR + right :] for x, at in rows], length - (left + ANCHOR + right) + len(name)


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)]


def blocks_ordered(length: int):
    """(anchor, digest, ranges): ranges of repeated windows in each segment. Rows come sorted by anchor, whose segments stay together.

    An anchor that some segment holds more than once is not named.
    """
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def of(rows: list[tuple[int, bytes, bytes, int, bool]]) -> pa.RecordBatch:
        segments, need = [], []
        for n, (_, group) in enumerate(groupby(rows, itemgetter(0))):
            mine = list(group)
            if mine[0][4]:
                found, symbols = [r[2] for r in mine], length
            else:
                found, symbols = named([(r[2], r[3]) for r in mine], length, bytes((NAME, n // 250 % 250, n % 250)))
            segments += found
            need += [symbols] * len(found)
        flags = repeated_windows(segments, np.array(need))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([_ranges(f) for f in flags], kind)], names=["anchor", "digest", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int, bool]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "segment", "at", "again")), strict=True):
                if len(held) >= BLOCK and row[0] != held[-1][0]:
                    yield of(held)
                    held = []
                held.append(row)
        if held:
            yield of(held)

    return run


def windows_hashed(length: int):
    """(anchor, digest, at, w1, w2): 128 bits of each window of a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, digest, segment in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "segment")), strict=True):
                found = [hashlib.blake2b(segment[k : k + length], digest_size=16).digest() for k in range(len(segment) - length + 1)]
                pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([digest] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["anchor", "digest", "at", "w1", "w2"])

    return run


def removed(length: int):
    """(k1, k2, n_bytes, spans, rest): maximal removed runs and what remains."""
    spans_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, rest = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                steps = np.zeros(len(raw) + 1, np.int64)
                for f in found or []:  # windows a..b begin in the text at f["start"] + a
                    for r in f["ranges"]:
                        steps[f["start"] + r["a"]] += 1
                        steps[f["start"] + r["b"] - 1 + length] -= 1
                gone = np.cumsum(steps)[:-1] > 0
                sizes.append(len(raw))
                spans.append(_ranges(gone))
                rest.append(raw[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(rest, pa.binary())], names=["k1", "k2", "n_bytes", "spans", "rest"])

    return run


def dedup_substrings(spark: SparkSession, docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, spans, rest) for each row of docs (doc_id, text).

    Every byte covered by a `length`-byte string that also starts anywhere else, in the same
    text or another, is removed; strings are judged on the input. spans lists the maximal
    removed runs [a, b), rest is the remaining bytes, which may cut a character. Null text
    counts as empty; texts shorter than `length` stay whole. Rows of equal texts, repeated
    rows included, repeat each other.
    """
    folder = shared_folder(spark)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2"))
    runs = docs.select("k1", "k2", "text").mapInArrow(anchored_runs(length), "k1 long, k2 long, anchor long, start int, run int, at int, twice boolean")
    runs = keep(runs.groupBy("k1", "k2", "anchor", "start", "run", "at", "twice").agg(F.count("*").alias("n")), f"{folder}/runs")
    twice = runs.groupBy("anchor").agg(F.sum("n").alias("all"), F.max("twice").alias("twice")).where("all > 1 or twice").select("anchor")
    wanted = runs.join(twice.hint("merge"), "anchor", "left_semi")
    wanted = keep(wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "start", "run", "at", "twice", "n")).alias("runs")), f"{folder}/wanted")
    drop(spark, f"{folder}/runs")

    texts = docs.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    cut = texts.join(wanted.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "runs")
    cut = keep(cut.mapInArrow(cut_segments(length), "k1 long, k2 long, anchor long, start int, digest binary, segment binary, at int, n long, twice boolean"), f"{folder}/cut")
    drop(spark, f"{folder}/wanted")
    distinct = cut.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.first("segment").alias("segment"), F.min("at").alias("at"), F.max("twice").alias("twice"))
    distinct = keep(distinct, f"{folder}/segments")
    sizes = keep(distinct.groupBy("anchor").agg(F.count("*").alias("segments"), F.max("twice").alias("again")).where("segments > 1 or again"), f"{folder}/sizes")

    whole = F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("segment") - length + 1).alias("b")))
    several = distinct.join(sizes.hint("merge"), "anchor")
    dealt = several.where(F.col("segments") <= HOT).select("anchor", "digest", "segment", "at", "again").repartition(partitions(spark), "anchor").sortWithinPartitions("anchor", "digest")
    ordered = dealt.mapInArrow(blocks_ordered(length), "anchor long, digest binary, ranges array<struct<a:int,b:int>>")
    windows = several.where(F.col("segments") > HOT).select("anchor", "digest", "segment").mapInArrow(windows_hashed(length), "anchor long, digest binary, at int, w1 long, w2 long")
    common = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    hot = windows.join(common, ["w1", "w2"]).groupBy("anchor", "digest").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("ranges"))
    equal = distinct.where("n > 1").select("anchor", "digest", whole.alias("ranges"))
    found = keep(ordered.where(F.size("ranges") > 0).unionByName(hot).unionByName(equal), f"{folder}/found")
    places = cut.select("k1", "k2", "anchor", "start", "digest").join(found.hint("merge"), ["anchor", "digest"])
    places = keep(places.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "ranges")).alias("found")), f"{folder}/places")
    for name in ("segments", "cut", "found"):
        drop(spark, f"{folder}/{name}")
    results = texts.join(places.hint("merge"), ["k1", "k2"], "left").select("k1", "k2", "text", "found").mapInArrow(removed(length), "k1 long, k2 long, n_bytes long, spans array<struct<a:long,b:long>>, rest binary")
    return docs.select("doc_id", "k1", "k2").join(results.hint("merge"), ["k1", "k2"]).select("doc_id", "n_bytes", "spans", "rest")
