"""Blocks: rows of arrays, so that Spark shuffles a few large rows by bucket instead of one row an entry.

A task groups its entries by bucket and hands on one row a bucket; after the shuffle a task
gets all rows of a bucket one after another and works on their arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.store import partitions


def scattered(*parts: tuple[np.ndarray, dict[str, np.ndarray]], **fixed: pa.Scalar) -> pa.RecordBatch:
    """One row for each bucket that has entries: bucket, the fixed values, and a list of its entries for each column.

    Each part has the buckets of its entries and their columns; an entry may have several values.
    """
    present = np.unique(np.concatenate([np.unique(bucket) for bucket, _ in parts]))
    names, arrays = ["bucket"], [pa.array(present.astype(np.int32))]
    for name, value in fixed.items():
        names.append(name)
        arrays.append(pa.repeat(value, len(present)))
    for bucket, columns in parts:
        order = np.argsort(bucket, kind="stable")
        edges = np.append(np.searchsorted(bucket[order], present), len(bucket))
        for name, values in columns.items():
            wide = len(values) // max(len(bucket), 1)
            values = values.reshape(-1, wide)[order].ravel() if wide else values
            values = values.view(np.int64) if values.dtype == np.uint64 else values
            names.append(name)
            arrays.append(pa.ListArray.from_arrays(pa.array((edges * wide).astype(np.int32)), pa.array(values)))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def one_row(bucket: int, columns: dict[str, np.ndarray], **fixed: pa.Scalar) -> pa.RecordBatch:
    columns = {k: v.view(np.int64) if v.dtype == np.uint64 else v for k, v in columns.items()}
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.repeat(v, 1) for v in fixed.values()), *lists], names=["bucket", *fixed, *columns])


def cells(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, arrays) of each row."""
    for batch in batches:
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        lists = [batch.column(n) for n in names]
        ends = [x.offsets.to_numpy() for x in lists]
        flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
        for k in range(len(batch)):
            yield int(bucket[k]), [f[e[k] : e[k + 1]] for f, e in zip(flat, ends, strict=True)]


def gathered(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, arrays) of each bucket, whose rows follow each other."""
    last, held = None, []
    for bucket, arrays in cells(batches, names):
        if held and bucket != last:
            yield last, [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        last = bucket
        held.append(arrays)
    if held:
        yield last, [np.concatenate(x) for x in zip(*held, strict=True)]


def together(df: DataFrame, *order: str) -> DataFrame:
    """Rows of a bucket in one task, one after another; buckets are dealt in turn, so that tasks have equally many."""
    n = partitions(df.sparkSession)
    return df.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket", *order)


def bucket_count(spark: SparkSession, entries: int, each: int = 1 << 19) -> int:
    """Buckets that keep every task at work and hold about `each` entries at most."""
    return max(partitions(spark), -(-entries // each))


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and where each key begins in it."""
    order = np.argsort(keys)
    mine = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1]))) if len(mine) else np.empty(0, np.int64)


class Known:
    """Values by 64-bit hash: a table of bounded size that goes to all tasks. The hashes' first bits say where to look."""

    def __init__(self, hashes: np.ndarray, **values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = {k: v[order] for k, v in values.items()}

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "values": self.values}

    @cached_property
    def _slots(self) -> tuple[np.uint64, np.ndarray, int]:
        """How far a hash is shifted, where each slot begins, and how many hashes a slot has at most."""
        bits = max(8, 3 + len(self.hashes).bit_length())
        shift = np.uint64(64 - bits)
        begin = np.searchsorted((self.hashes >> shift).astype(np.int64), np.arange((1 << bits) + 1)).astype(np.int32)
        return shift, begin, int(np.diff(begin).max(initial=0))

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(w), np.int32), np.zeros(len(w), bool)
        shift, begin, most = self._slots
        slot = (w >> shift).astype(np.int64)
        at, end = begin[slot], begin[slot + 1]
        there = (at < end) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == w)
        for _ in range(1, most):
            more = np.flatnonzero(~there & (at + 1 < end))
            at[more] += 1
            there[more] = self.hashes[at[more]] == w[more]
        return np.where(there, at, 0), there

    def of(self, name: str, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each hash, 0 where it has none, and whether it has one."""
        at, there = self.find(w)
        return (np.where(there, self.values[name][at], 0.0) if len(self.hashes) else np.zeros(len(w))), there
