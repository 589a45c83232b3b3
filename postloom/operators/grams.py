"""Containment of texts in texts by an inverted index of byte grams.

A needle of Q bytes or more is found under one of its grams of Q bytes, a shorter one under
itself. What is scanned meets the grams asked for in a table of bounded size first, so only
hits become rows; they are joined by gram, and every pair is checked by whoever asked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.shipping import ship

Q = 8
#: Slots of a table of grams: how many for each gram, and at most. Beyond that more hits are false, none is lost.
PER_GRAM, SLOTS = 16, 1 << 22
#: Grams of a needle among which the rarest is chosen.
TRIED = 8
#: Bytes that are scanned at once.
CHUNK = 1 << 19

_VALUES = np.random.Generator(np.random.PCG64(20260101)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(Q)], np.uint64)
_LENGTHS = np.array([k * 0xD6E8FEB86659FD93 % (1 << 64) for k in range(Q + 1)], np.uint64)


def hashes(data: np.ndarray, lengths: Sequence[int]) -> dict[int, np.ndarray]:
    """For each length the hash of that many bytes from every place; those at the end run into bytes 0."""
    values = np.append(_VALUES[data], np.zeros(Q, np.uint64))
    out, sums = {}, np.zeros(len(data), np.uint64)
    for k in range(max(lengths, default=0)):
        sums = sums + values[k : k + len(data)] * _POWERS[k]
        if k + 1 in lengths:
            h = (sums ^ _LENGTHS[k + 1]) * np.uint64(0xFF51AFD7ED558CCD)
            out[k + 1] = h ^ (h >> np.uint64(32))
    return out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins and the last ends; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)), offsets


def parts_of(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1))
        yield i, j
        i = j


class Slots:
    """How many grams fall into each slot, up to 255. Its size is bounded whatever the number of grams."""

    def __init__(self, counts: np.ndarray, lengths: Sequence[int]):
        self.counts, self.lengths = counts, tuple(lengths)

    @classmethod
    def of(cls, grams: DataFrame, count: int) -> Slots:
        """grams: gram, size (its bytes); count: about how many. A row for each slot that is taken reaches the driver, SLOTS at most."""
        slots = min(SLOTS, 1 << max(10, (PER_GRAM * count - 1).bit_length()))
        taken = grams.groupBy(F.pmod("gram", F.lit(slots)).cast("int").alias("slot")).agg(F.least(F.count("*"), F.lit(255)).cast("int").alias("n"), F.expr("bit_or(shiftleft(1, size))").alias("sizes"))
        rows = taken.toArrow()
        counts = np.zeros(slots, np.uint8)
        counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
        sizes = int(np.bitwise_or.reduce(rows.column("sizes").to_numpy().astype(np.int64), initial=0))
        return cls(counts, [k for k in range(1, Q + 1) if sizes >> k & 1])

    def find(self, grams: np.ndarray) -> np.ndarray:
        """What each gram's slot holds."""
        return self.counts[grams & np.uint64(len(self.counts) - 1)]


def _rows(batch: pa.RecordBatch, carried: Sequence[str], at: list[np.ndarray], grams: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
    where = pa.array(np.concatenate(at) if at else np.empty(0, np.int64))
    found = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (grams, sizes)]
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in carried), pa.array(found[0].astype(np.uint64).view(np.int64)), pa.array(found[1].astype(np.int32))], names=[*carried, "gram", "size"])


def _all_grams(lengths: Sequence[int], carried: Sequence[str], some: int | None):
    """Distinct grams of each text of the given lengths, and texts shorter than the longest as they are if `some`: then so many grams at most, evenly spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("part"))
            at, grams, sizes = [], [], []
            for k in range(len(batch)):
                mine = data[offsets[k] : offsets[k + 1]]
                wanted = [min(Q, len(mine))] if some else [n for n in lengths if n <= len(mine)]
                for n, h in hashes(mine, wanted).items() if len(mine) else ():
                    h = h[: len(mine) - n + 1]
                    h = np.unique(h if some is None else h[np.linspace(0, len(h) - 1, min(some, len(h))).astype(int)])
                    at.append(np.full(len(h), k))
                    grams.append(h)
                    sizes.append(np.full(len(h), n))
            yield _rows(batch, carried, at, grams, sizes)

    return run


def _hits(slots: Slots, carried: Sequence[str]):
    """The grams of each text that are asked for, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("part"))
            at, grams, sizes = [], [], []
            for i, j in parts_of(offsets):
                low = int(offsets[i])
                for n, h in hashes(data[low : offsets[j]], slots.lengths).items():
                    places = np.flatnonzero(slots.find(h))
                    text = np.searchsorted(offsets, places + low, "right") - 1
                    inside = places + low + n <= offsets[text + 1]
                    text, gram = text[inside], h[places[inside]]
                    order = np.lexsort((gram, text))
                    text, gram = text[order], gram[order]
                    fresh = np.ones(len(text), bool)
                    fresh[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
                    at.append(text[fresh])
                    grams.append(gram[fresh])
                    sizes.append(np.full(int(fresh.sum()), n))
            yield _rows(batch, carried, at, grams, sizes)

    return run


def _covered(slots: Slots, carried: Sequence[str], shortest: int):
    """One gram of each text all of whose grams are there: the rarest one, or the text itself where it is shorter than Q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_of(batch.column("part"))
            at, grams, sizes = [], [], []
            for i, j in parts_of(offsets):
                low = int(offsets[i])
                length = np.diff(offsets[i : j + 1])
                found = hashes(data[low : offsets[j]], range(shortest, Q + 1))
                for n in range(shortest, Q):
                    mine = np.flatnonzero(length == n)
                    h = found[n][offsets[i + mine] - low]
                    there = slots.find(h) > 0
                    at.append(i + mine[there])
                    grams.append(h[there])
                    sizes.append(np.full(int(there.sum()), n))
                mine = np.flatnonzero(length >= Q)
                if not len(mine):
                    continue
                held = slots.find(found[Q]).astype(np.int16)
                # places where no gram of this text begins count as full
                tail = np.repeat(offsets[i + mine + 1] - low - Q + 1, Q - 1) + np.tile(np.arange(Q - 1), len(mine))
                held[tail] = 1 << 9
                short = np.flatnonzero((length < Q) & (length > 0))
                for k in short:
                    held[offsets[i + k] - low : offsets[i + k + 1] - low] = 1 << 9
                starts = offsets[i + mine] - low
                rarest = np.minimum.reduceat(held, starts)
                for k, least in zip(mine[rarest > 0].tolist(), rarest[rarest > 0].tolist(), strict=True):
                    a, b = int(offsets[i + k] - low), int(offsets[i + k + 1] - low)
                    at.append(np.array([i + k]))
                    grams.append(found[Q][a + int(np.argmax(held[a:b] == least))][None])
                    sizes.append(np.array([Q]))
            yield _rows(batch, carried, at, grams, sizes)

    return run


def _schema(df: DataFrame, carried: Sequence[str]) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in carried), T.StructField("gram", T.LongType()), T.StructField("size", T.IntegerType())])


def scan(texts: DataFrame, run, carried: Sequence[str]) -> DataFrame:
    """Carried columns, gram and size of what `run` finds. texts: part and the carried columns."""
    ship(texts.sparkSession)
    return texts.select(*carried, "part").mapInArrow(run, _schema(texts, carried))


def holders(needles: DataFrame, texts: DataFrame, within: str, needle: str, text: str) -> DataFrame:
    """Pairs (needle, text) of one `within` in which the text may hold the needle's part; every pair that does is there.

    needles: within, needle, part; texts: within, text, part. A needle meets the texts with its
    rarest gram only: of TRIED grams the one that stands in the fewest texts. Needles with a gram
    that stands nowhere meet none. Empty parts are in no pair.
    """
    needles = needles.where("part <> ''")
    keys = scan(needles, _all_grams((), (within, needle), TRIED), (within, needle))
    slots = Slots.of(keys.select("gram", "size").distinct(), keys.count())
    if not slots.lengths:
        return needles.join(texts.select(within, text), within).select(needle, text).limit(0)
    seen = scan(texts, _hits(slots, ()), ()).groupBy("gram").agg(F.count("*").alias("_seen"))
    counted = keys.join(seen, "gram", "left").withColumn("_seen", F.coalesce("_seen", F.lit(0)))
    rarest = counted.groupBy(within, needle).agg(F.min(F.struct("_seen", "gram", "size")).alias("_x")).where("_x._seen > 0").select(within, needle, "_x.gram", "_x.size")
    chosen = Slots.of(rarest.select("gram", "size").distinct(), keys.count())
    hits = scan(texts, _hits(chosen, (within, text)), (within, text))
    return hits.join(rarest, [within, "gram"]).select(needle, text).distinct()


def held(needles: DataFrame, texts: DataFrame, within: str, needle: str, text: str, shortest: int) -> DataFrame:
    """Pairs (needle, text) as of `holders`, for many needles and few texts: of needles of `shortest` bytes or more.

    A needle with a gram that no text has goes where it is read; the others are found under their rarest gram.
    """
    grams = scan(texts.where("part <> ''"), _all_grams(range(shortest, Q + 1), (within, text), None), (within, text))
    slots = Slots.of(grams.select("gram", "size"), grams.count())
    most = texts.agg(F.max(F.octet_length("part"))).head()[0] or 0
    fit = needles.where(F.octet_length("part").between(shortest, most))
    keys = scan(fit, _covered(slots, (within, needle), shortest), (within, needle))
    return keys.join(grams.select(within, text, "gram"), [within, "gram"]).select(needle, text).distinct()
