"""Exact deduplication that splits off heavy hitters.

Each task counts its digests with a Misra-Gries summary; summaries are added up by digest
and the greatest sums are candidates, counted exactly. Of these, the digests that are truly
frequent go to all tasks with the row that stays of each, so their copies are marked where
they are read. All other digests are shuffled, in groups that are small by construction.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.llm.store import drop, keep, shared_folder
from postloom.shipping import ship

#: A digest with more than one in so many rows is frequent, so there are fewer than that; they are what is broadcast.
HITTERS = 4_096
#: Counters of a summary for each of these.
EACH = 4
MADE = ("copy_digest", "copy_keep", "copy_count", "copy_kept")


def digested(carried: list[str], names: list[str]):
    """Carried columns under their inner names, and the digest of the text with A-Z taken as a-z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch's texts may exceed what 32-bit offsets reach
            lower = pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), "")).cast(pa.large_binary())
            digests = pa.array([hashlib.sha256(x.as_buffer()).digest() for x in lower], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), digests], names=[*names, "digest"])

    return run


class MisraGries:
    """Counts of at most `size` keys, each at most n / (size + 1) below the true one; keys more frequent than that are all there."""

    def __init__(self, size: int):
        self.size, self.counts = size, Counter()

    def add(self, keys: list[bytes]) -> None:
        self.counts.update(keys)
        if len(self.counts) > self.size:
            least = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = Counter({k: n - least for k, n in self.counts.items() if n > least})


def summaries(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = MisraGries(size)
        for batch in batches:
            held.add(batch.column("digest").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(held.counts.keys(), pa.binary()), pa.array(held.counts.values(), pa.int64())], names=["digest", "seen"])

    return run


def heavy_hitters(rows: DataFrame, hitters: int, folder: str) -> DataFrame:
    """(digest, stays, size) of every digest with more than one in `hitters` rows. rows: digest, doc_id, row.

    All summaries together miss less than one in EACH * hitters of n rows. So a frequent digest's
    sum is more than (EACH - 1) * n / (EACH * hitters), which fewer than hitters * EACH / (EACH - 1) can reach.
    """
    summed = rows.select("digest").mapInArrow(summaries(EACH * hitters), "digest binary, seen long").groupBy("digest").agg(F.sum("seen").alias("seen"))
    likely = keep(summed.orderBy(F.desc("seen"), "digest").limit(hitters * EACH // (EACH - 1) + 1).select("digest"), f"{folder}/likely")
    counted = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count("*").alias("size"))
    share = rows.agg((F.count("*") / F.lit(hitters)).alias("share"))
    return keep(counted.join(F.broadcast(share)).where("size > share and size > 1").drop("share"), f"{folder}/heavy")


def exact_dedup(spark: SparkSession, docs: DataFrame, hitters: int = HITTERS, carry: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, other columns; or of them those in `carry`) with copy_digest, copy_keep, copy_count, copy_kept.

    Texts are equal when they are identical with A-Z taken as a-z, no other letter being
    folded; null counts as empty. Of equal texts the row with the largest doc_id stays:
    copy_kept says whether it is this one, copy_keep has its doc_id and copy_count the number
    of rows. A null doc_id comes after all others; of rows equal in text and doc_id one
    stays, so exactly one row of each group is kept. copy_digest is the SHA-256 of the folded
    text in UTF-8. Every row comes back, an empty table gives an empty one. Columns of docs
    with the made names are replaced, all others stay.

    `hitters` bounds what is broadcast: digests with more than one in `hitters` rows, of
    which there are fewer than that. A group that is shuffled has no more than that share.
    """
    ship(spark)
    folder = shared_folder(spark)
    carried = [c for c in dict.fromkeys(carry or docs.columns) if c not in MADE]
    needed = list(dict.fromkeys([*carried, "doc_id"]))
    names = [f"own{n}" for n in range(len(needed))]
    schema = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, needed, strict=True)), T.StructField("digest", T.BinaryType())])
    read = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*needed, "text"])]).mapInArrow(digested(needed, names), schema)
    own_id = names[needed.index("doc_id")]
    # a row's number is fixed as the table is written
    rows = keep(read.withColumn("row", F.monotonically_increasing_id()), f"{folder}/rows")
    keys = rows.select("digest", F.col(own_id).alias("doc_id"), "row")
    heavy = heavy_hitters(keys, hitters, folder)

    all_of = rows.withColumn("doc_id", F.col(own_id))
    marked = all_of.join(F.broadcast(heavy), "digest")
    group = Window.partitionBy("digest")
    others = all_of.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    others = others.withColumns({"stays": F.max(F.struct("doc_id", "row")).over(group), "size": F.count("*").over(group)})
    out = marked.select(*others.columns).unionByName(others)
    columns = [F.col(n).alias(c) for n, c in zip(names, needed, strict=True) if c in carried]
    drop(spark, f"{folder}/likely")
    return out.select(*columns, F.lower(F.hex("digest")).alias("copy_digest"), F.col("stays.doc_id").alias("copy_keep"), F.col("size").alias("copy_count"), (F.col("row") == F.col("stays.row")).alias("copy_kept"))


def op12_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    with t as materialized (select doc_id, sha256(translate(coalesce(text, ''), '{upper}', '{lower}')) text_sha256 from documents)
    select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by text_sha256) group_size,
      row_number() over w = 1 kept, text_sha256
    from t window w as (partition by text_sha256 order by doc_id desc nulls last)"""
