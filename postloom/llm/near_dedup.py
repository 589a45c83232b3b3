"""MinHash near-duplicate detection by min-max hashing.

Each permutation of a document's shingle set gives two signature values, its least and
its greatest, so 60 hash evaluations a shingle give 120 values. They are banded by five
(24 bands: a pair at the threshold shares a band but for 8 chances in 10 million). Documents
of equal sets are one node from the start. Each node is held, on full sets, against the first
nodes of its buckets: those that it shares most buckets with. Nodes that share buckets form
families, whichever pairs were held against each other. A family's largest component is then
left alone with itself, and its other nodes meet all the rest in blocks of bounded size, where
one-byte sketches pick what is confirmed on full sets and links alone come out. So every pair
of a bucket is joined by links already or looked at, and no bucket is expanded into its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.bytehash import Words, chunks, shingles, text_bytes
from postloom.llm.store import drop, keep, partitions, shared_folder

PERMUTATIONS, BLOCK = 60, 512
#: First nodes of its buckets that a node is held against before families are looked at. Pairs beyond these are looked at there.
CENTRES = 3
VALUES, MISSED = 2 * PERMUTATIONS, 1e-6
_RNG = np.random.Generator(np.random.PCG64(7))
_XOR = _RNG.integers(0, 1 << 32, (PERMUTATIONS, 1), dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, (PERMUTATIONS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = _RNG.integers(1, 1 << 63, (VALUES, 1), dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64)

SIGNATURE = "doc_id long, t1 long, t2 long, n_shingles long, digest binary, bands array<long>, sketch binary"


def band_rows(percent: int) -> int:
    """The most values a band can have if a pair at the threshold is to miss all bands with a chance of MISSED at most."""
    fit = [r for r in range(1, VALUES + 1) if VALUES % r == 0 and (1 - (percent / 100) ** r) ** (VALUES // r) <= MISSED]
    return max(fit, default=1)


def min_max(values: np.ndarray) -> np.ndarray:
    """The 120 signature values of a set of hashes: all minima, then all maxima, moved on by one."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 2048):
        y = (x[None, k : k + 2048] ^ _XOR) * _MUL
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return np.concatenate((low, np.roll(high, 1)))


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many values; a permutation's minimum and maximum never share a band."""
    bands = VALUES // rows
    h = (signature.reshape(rows, bands).astype(np.uint64) * _FOLD[:rows]).sum(axis=0, dtype=np.uint64) + _BAND[:bands]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def signatures(width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            sizes, digests, bands, sketches = [], [], [], []
            for i, j in chunks(offsets):
                words = Words(data, offsets[i : j + 1])
                hashes = words.hashes()
                for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                    values = shingles(hashes[a:b], width)
                    sizes.append(len(values))
                    if len(values):
                        signature = min_max(values)
                        digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                        bands.append(band_hashes(signature, rows))
                        sketches.append(signature.astype(np.uint8).tobytes())
                    else:
                        digests.append(None)
                        bands.append(np.empty(0, np.int64))
                        sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).cast(pa.int64()) for c in ("doc_id", "t1", "t2")), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "t1", "t2", "n_shingles", "digest", "bands", "sketch"],
            )

    return run


def _one(text: str, width: int) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return shingles(Words(raw, np.array([0, len(raw)])).hashes(), width) if len(raw) else np.empty(0, np.uint64)


def _links(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Of sets of x's size or near it, those with 100 * intersection >= percent * union."""
    sizes = np.array([len(y) for y in others])
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, joined), len(x) - 1)
    both = np.add.reduceat(x[at] == joined, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * both >= percent * (len(x) + sizes - both)


def confirmed(width: int, percent: int):
    """Pairs (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, np.ndarray] = (object(), np.empty(0))
        for batch in batches:
            a, left, right = (batch.column(c) for c in ("a", "left", "right"))
            keep_rows = np.zeros(len(batch), bool)
            for k in range(len(batch)):
                if a[k].as_py() != last[0]:
                    last = (a[k].as_py(), _one(left[k].as_py() or "", width))
                x, y = last[1], _one(right[k].as_py() or "", width)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) > 0:
                    keep_rows[k] = _links(x, [y], percent)[0]
            yield batch.select(["a", "b"]).filter(pa.array(keep_rows))

    return run


def confirm(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """A document in many pairs is a skewed join that Spark splits."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    joined = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return joined.select("a", "b", "left", "right").mapInArrow(confirmed(width, percent), "a long, b long").distinct()


def components(spark: SparkSession, links: DataFrame, folder: str) -> DataFrame:
    """(node, label): label is the least node reachable.

    In each round a node goes over to its least smaller neighbour, and from there to that one's own;
    links are then between those that are left. The least node of a component never goes over, so it
    is the one that remains. Each round's links are fewer, down to none.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges = keep(links.where("a <> b").select(*pair("a", "b")).distinct(), f"{folder}/edges0")
    labels = keep(links.select("a").union(links.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("label")), f"{folder}/labels0")
    step = 0
    while not edges.isEmpty():
        step += 1
        up = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        further = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = keep(up.join(further, "up", "left").select("node", F.coalesce("top", "up").alias("up")), f"{folder}/up{step}")
        of = lambda name, to: up.select(F.col("node").alias(name), F.col("up").alias(to))  # noqa: E731, B023
        moved = edges.join(of("b", "to_b"), "b").join(of("a", "to_a"), "a", "left").select(F.coalesce("to_a", "a").alias("x"), F.col("to_b").alias("y"))
        edges = keep(moved.where("x <> y").select(*pair("x", "y")).distinct(), f"{folder}/edges{step}")
        labels = keep(labels.join(of("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"{folder}/labels{step}")
        for name in (f"edges{step - 1}", f"labels{step - 1}", f"up{step}"):
            drop(spark, f"{folder}/{name}")
    return labels


def blocks_linked(width: int, percent: int, slack: float = 0.2):
    """Links between different components in a block. Rows come sorted by block; a block has a bounded number of rows."""

    def links_of(node: np.ndarray, label: np.ndarray, side: np.ndarray, n: np.ndarray, sketch: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int]]:
        sets: dict[int, np.ndarray] = {}

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = _one(texts[k] or "", width)
            return sets[k]

        for k in np.flatnonzero(side <= 0):
            other = (label != label[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
            other &= (node > node[k]) if side[k] < 0 else side > 0
            at = np.flatnonzero(other)
            at = at[(sketch[at] == sketch[k]).mean(axis=1) >= percent / 100 - slack]
            if len(at):
                yield from ((int(node[k]), int(node[i])) for i in at[_links(of(k), [of(i) for i in at], percent)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            table = held
            if batch is not None:
                fresh = pa.Table.from_batches([batch])
                table = pa.concat_tables([held, fresh]) if held is not None else fresh
            if table is None or not len(table):
                continue
            key = np.stack([table.column(c).to_numpy() for c in ("family", "kind", "i", "j")], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(table)]
            if batch is not None:  # the last block may go on in the next batch
                held = table.slice(edges[-2])
                edges.pop()
            found: list[tuple[int, int]] = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = table.slice(lo, hi - lo)
                sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(hi - lo, -1)
                found += links_of(*(part.column(c).to_numpy() for c in ("node", "label", "side", "n")), sketch, part.column("text").to_pylist())
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text, any other columns).

    Documents are linked when 100 * intersection >= percent * union of their sets of
    `width`-word shingles. Null or word-free texts have an empty set and are linked with
    nothing. A null doc_id names no document: n_shingles is given, component_id is null and
    kept is true. Rows that share a doc_id are one document: they come back one by one, each
    with the set size of its own text, but in one component, which holds what any of them is
    linked with. An empty table gives an empty one. Texts of any length are used whole.
    """
    folder = shared_folder(spark)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"))
    signed = keep(docs.mapInArrow(signatures(width, band_rows(percent)), SIGNATURE), f"{folder}/signatures")
    named = signed.where("doc_id is not null and digest is not null")
    # one node for each set; its number is fixed as the table is written
    nodes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "t1", "t2", "n_shingles", "bands", "sketch")).alias("x"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "x.doc_id", "x.t1", "x.t2", F.col("x.n_shingles").alias("n"), "x.bands", "x.sketch")
    nodes = keep(nodes, f"{folder}/nodes")
    several = named.select("doc_id", "digest").distinct()
    several = several.join(several.groupBy("doc_id").count().where("count > 1").select("doc_id").hint("merge"), "doc_id").join(nodes.select("digest", "node").hint("merge"), "digest")
    of_one = several.join(several.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a < node").select("a", F.col("node").alias("b"))

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = keep(banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("a")).where("size > 1"), f"{folder}/buckets")
    stars = banded.join(buckets, "bucket").where("a < node").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    stars = keep(stars, f"{folder}/stars")
    # only texts named in a pair are carried further, each once
    paired = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    keys = nodes.select("node", "t1", "t2").join(paired.hint("merge"), "node")
    texts = docs.select("t1", "t2", "text").join(keys.select("t1", "t2").hint("merge"), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    texts = keep(texts.join(keys.hint("merge"), ["t1", "t2"]).select("node", "text"), f"{folder}/texts")
    # a node is held against those that it shares most buckets with; what else a bucket joins is left to the families
    likely = stars.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), "a"))).where(F.col("n") <= CENTRES).select("a", "b")
    links = keep(confirm(texts, likely, width, percent), f"{folder}/links1")
    first = components(spark, links, f"{folder}/first")

    families = components(spark, stars, f"{folder}/family").select("node", F.col("label").alias("family"))
    members = families.join(first, "node", "left").select("node", "family", F.coalesce("label", "node").alias("label"))
    members = keep(members, f"{folder}/members")
    sizes = members.groupBy("family", "label").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("family").agg(F.sum("size").alias("all"), F.max(F.struct("size", "label")).alias("x"), F.count("*").alias("parts"))
    sizes = sizes.where("all > 2 and parts > 1").select("family", F.col("x.label").alias("main"), F.ceil((F.col("all") - F.col("x.size")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("x.size") / BLOCK).cast("int").alias("many"))
    dealt = members.join(keep(sizes, f"{folder}/sizes"), "family").withColumn("h", F.xxhash64("node"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.pmod("h", F.col("few")).cast("int")
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    minor = F.concat(
        F.transform(to("few"), lambda k: cell(0, F.least(mine, k), F.greatest(mine, k), F.when(mine == k, -1).when(mine < k, 0).otherwise(1))),
        F.transform(to("many"), lambda k: cell(1, mine, k, F.lit(0))),
    )
    main = F.transform(to("few"), lambda k: cell(1, k, F.pmod("h", F.col("many")), F.lit(1)))
    dealt = dealt.select("family", "node", "label", F.explode(F.when(F.col("label") == F.col("main"), main).otherwise(minor)).alias("x")).select("family", "node", "label", "x.*")
    dealt = dealt.join(nodes.select("node", "n", "sketch"), "node").join(texts.hint("merge"), "node")
    dealt = dealt.repartition(partitions(spark), "family", "kind", "i", "j").sortWithinPartitions("family", "kind", "i", "j", "node")
    more = dealt.select("family", "kind", "i", "j", "side", "node", "label", "n", "sketch", "text").mapInArrow(blocks_linked(width, percent), "a long, b long").distinct()
    links = keep(links.union(more).union(of_one), f"{folder}/links")
    final = components(spark, links, f"{folder}/final")

    classes = nodes.join(final, "node", "left").select("digest", "doc_id", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    classes = classes.select("digest", "label").join(least, "label").select("digest", "component_id")
    out = signed.where("doc_id is not null").select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    # a row without words goes with the others of its doc_id
    alone = out.where("component_id is null").select("doc_id").distinct().join(out.where("component_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("other")), "doc_id")
    out = out.join(alone, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "other", "doc_id").alias("component_id"))
    nameless = signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = keep(out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), f"{folder}/out")
    for name in ("signatures", "nodes", "buckets", "stars", "texts", "links1", "members", "sizes", "links"):
        drop(spark, f"{folder}/{name}")
    return out
