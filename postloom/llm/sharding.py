"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.store import keep, set_aside, shared_folder

#: The ring has so many cells; a virtual node stands at the end of one of them.
CELLS = 1 << 16
MADE = ("ring_shard", "ring_slot")


def ring(shards: int, virtual: int) -> np.ndarray:
    """The shard to which each cell belongs: that of the first virtual node clockwise."""
    owner = np.full(CELLS, -1)
    for shard in range(shards):
        for k in range(virtual):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{k}".encode()).digest()[:8], "little") % CELLS
            if owner[at] < 0 or owner[at] > shard:
                owner[at] = shard
    nodes = np.flatnonzero(owner >= 0)
    return owner[nodes[np.searchsorted(nodes, np.arange(CELLS)) % len(nodes)]]


def placed(counts: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(cell, from, to, shard, slot): ranks from..to of a cell go to the shard, beginning at that slot.

    Cells are walked clockwise, twice round; a shard takes its own cells' keys, and what it
    has no room for goes on to the next shard clockwise that has.
    """
    room, filled, out = room.copy(), np.zeros_like(room), []
    changes = np.flatnonzero(owner != np.roll(owner, 1)) if (owner != owner[0]).any() else np.array([0])
    following = np.searchsorted(changes, np.arange(CELLS), "right")  # index of the arc after the cell's own

    def give(cell: int, shard: int, start: int, n: int) -> int:
        n = int(min(n, room[shard]))
        if n:
            out.append((int(cell), int(start), int(start) + n, int(shard), int(filled[shard])))
            room[shard] -= n
            filled[shard] += n
        return n

    left = []
    for cell in np.flatnonzero(counts):
        done = give(cell, owner[cell], 0, counts[cell])
        if done < counts[cell]:
            left.append((cell, done))
    for cell, done in left:
        for step in range(len(changes)):
            if done == counts[cell]:
                break
            done += give(cell, owner[changes[(following[cell] + step) % len(changes)]], done, counts[cell] - done)
    return out


def shard(spark: SparkSession, docs: DataFrame, shards: int = 40, virtual: int = 128, carry: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, other columns; or of them those in `carry`) with ring_shard and ring_slot.

    Law `rows`: shards hold equally many rows but for one. The bound on a shard's load is
    its exact share: the row count divided by the shards, one more for the first ones while
    there is a remainder. A row's key is its doc_id with a hash of its text (null: empty);
    rows equal in both stand side by side in no particular order. Only the counts of the
    65,536 ring cells reach the driver. Slots count from 0 without gaps in each shard. An
    empty table gives an empty one. Columns of docs with the two made names are replaced, all
    others stay.
    """
    folder = shared_folder(spark)
    carried = [c for c in (carry or docs.columns) if c not in MADE]
    inside, columns = set_aside(docs.select(*dict.fromkeys(["doc_id", "text", *carried])), ("doc_id", "text"), MADE)
    kept = [c for c, name in zip(columns, dict.fromkeys(["doc_id", "text", *carried]), strict=True) if name in carried]
    key = F.xxhash64(F.lit("ring"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    # of texts that are not carried only the key goes on
    small = inside.withColumn("ring_key", key).drop(*([] if "text" in carried else ["text"])).withColumn("ring_cell", F.shiftrightunsigned("ring_key", 48).cast("int"))
    counts = np.zeros(CELLS, np.int64)
    for row in small.groupBy("ring_cell").count().collect():
        counts[row[0]] = row[1]
    n = int(counts.sum())
    room = np.full(shards, n // shards) + (np.arange(shards) < n % shards)
    pieces = spark.createDataFrame(placed(counts, ring(shards, virtual), room) or [(-1, 0, 0, 0, 0)], "ring_cell int, ring_from long, ring_to long, ring_shard int, ring_base long")
    pieces = keep(pieces.coalesce(1), f"{folder}/pieces")
    rank = F.row_number().over(Window.partitionBy("ring_cell").orderBy("ring_key", "doc_id")) - 1
    ranked = small.withColumn("ring_rank", rank)
    # at most one row for each cell and one for each shard: a table of fixed size
    out = ranked.join(F.broadcast(pieces), "ring_cell").where("ring_rank >= ring_from and ring_rank < ring_to")
    return out.withColumn("ring_slot", F.col("ring_base") + F.col("ring_rank") - F.col("ring_from")).select(*kept, "ring_shard", "ring_slot")
