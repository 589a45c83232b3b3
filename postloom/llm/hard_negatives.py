"""Hard-negative mining by cover trees over norm-augmented vectors.

Equal vectors of one label are one entry. Entries are dealt to cells, the top of the tree:
a net of centres chosen on a bounded sample, with the radius that covers every entry of the
cell. A cell's entries are dealt to groups of bounded size, each of which is a cover tree in
one row of a kept table. Searches go in two steps: each query asks the groups of the cell
that promises most, then those of all cells whose bounds reach into its window above what
the first step has found. Trees and blocks of queries meet by group; results are merged by
score and id. So answers are exact, whatever the sample.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm import cover_tree
from postloom.llm.cover_tree import Asked, Tree
from postloom.llm.store import drop, keep, partitions, shared_folder

#: Entries from which cells are chosen, and the most cells. Only how much is skipped hangs on them, never an answer.
SAMPLE, CELLS = 16_384, 1_024
#: Entries of a group, at least (if there are so many) and at most.
SMALL, LARGE = 64, 65_536
#: Queries that meet a tree together.
BLOCK = 512
#: Whole numbers are held within these ends.
ENDS = 2**31 - 1
#: No score is beyond these.
FAR = 1 << 62

ENTRY = "vec binary, label long, vec_id long, square double"
FOUND = "asker long, window int, score long, found_id long"


def encoded(row: np.ndarray) -> bytes:
    """A vector of whole numbers, two bytes each where they fit, else eight; one byte says which."""
    return b"\2" + row.astype("<i2").tobytes() if len(row) == 0 or np.abs(row).max() < 1 << 15 else b"\10" + row.astype("<i8").tobytes()


def decoded(rows: list[bytes]) -> np.ndarray:
    """Vectors as one array; shorter ones are filled up with zeros."""
    lists = [np.frombuffer(r, "<i2" if r[0] == 2 else "<i8", offset=1) for r in rows]
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), width), np.int64 if any(r[0] == 8 for r in rows) else np.int16)
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def whole(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            numbers = np.clip(np.floor(scale * flat), -ENDS, ENDS).astype(np.int64)
            edges = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            rows = [numbers[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            squares = [float(np.square(r.astype(np.float64)).sum()) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([encoded(r) for r in rows], pa.binary()), batch.column("label"), batch.column("vec_id"), pa.array(squares, pa.float64())], names=["vec", "label", "vec_id", "square"])

    return run


@dataclass
class Cells:
    """Centres of norm-augmented vectors, the radius of each cell, and the groups that it has."""

    centres: np.ndarray
    norm: float
    radius: np.ndarray
    base: np.ndarray
    groups: np.ndarray

    def wide(self, width: int) -> np.ndarray:
        """Centres for vectors of that width, or of the sample's if that is more."""
        return cover_tree.centres_for(self.centres, width)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, and how far it is from the centre."""
        centres = self.wide(vectors.shape[1])
        x = cover_tree.augmented(widened(vectors.astype(np.float64), centres.shape[1] - 1), self.norm)
        squares = np.einsum("ij,ij->i", centres, centres) - 2 * x @ centres.T
        cell = squares.argmin(axis=1)
        return cell, np.linalg.norm(x - centres[cell], axis=1)


def choose_cells(entries: DataFrame, count: int, norm: float, cells: int) -> Cells:
    """A net of so many centres, each farthest from those before, of entries picked by hash."""
    share = min(1.0, 1.2 * SAMPLE / max(count, 1))
    picked = entries.select("vec").where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).distinct().orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE)
    sample = decoded([bytes(r.vec) for r in picked.collect()])
    points = cover_tree.augmented(sample.astype(np.float64), norm)
    chosen, away = [], np.full(len(points), np.inf)
    while len(chosen) < min(cells, len(points)) and away.max() > 0:
        k = int(away.argmax()) if chosen else 0
        chosen.append(k)
        away = np.minimum(away, np.linalg.norm(points - points[k], axis=1))
    none = np.zeros(len(chosen) or 1)
    centres = points[chosen] if chosen else np.array([[norm]])
    return Cells(centres, norm, none, none.astype(int), none.astype(int))


def dealt(cells: Cells):
    """Each entry's cell, and how far it is from the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = cells.nearest(decoded(batch.column("vec").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec", "label", "ids")), pa.array(cell, pa.int32()), pa.array(away)], names=["vec", "label", "ids", "cell", "away"])

    return run


def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the tree of each group; a group's entries follow each other."""

    def grown(group: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        vectors = decoded([v for p in parts for v in p.column("vec").to_pylist()])
        tree = cover_tree.build(vectors.astype(np.float64))
        tree.vectors = vectors[tree.order]
        labels = np.concatenate([p.column("label").to_numpy() for p in parts])[tree.order]
        lists = [i for p in parts for i in p.column("ids").to_pylist()]
        lists = [lists[k] for k in tree.order]
        edges = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        body = pickle.dumps((tree, labels, np.array([i for x in lists for i in x], np.int64), edges), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([0], pa.int32()), pa.array([body], pa.binary())], names=["group", "kind", "body"])

    last, held = None, []
    for batch in batches:
        groups = batch.column("group").to_numpy()
        edges = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if held and groups[a] != last:
                yield grown(last, held)
                held = []
            last = int(groups[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield grown(last, held)


def routed(cells: Cells, first: bool):
    """Blocks of queries for every group that they have to ask: in the first step those of the cell of the greatest bound, in the second those of all others that can hold an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                vectors = decoded(part.column("vec").to_pylist())
                own, label, asker = (part.column(c).to_numpy() for c in ("vec_id", "label", "asker"))
                lows, highs = part.column("lows").to_pylist(), part.column("highs").to_pylist()
                centres = cells.wide(vectors.shape[1])
                queries = widened(vectors, centres.shape[1] - 1).astype(np.float64)
                low, high = cover_tree.ball_bounds(queries, np.linalg.norm(queries, axis=1), centres, cells.radius, cells.norm)
                least, most = np.array([min(x) for x in lows]), np.array([max(x) for x in highs])
                high = np.where(cells.groups > 0, high, -np.inf)
                may = (high >= least[:, None]) & (low <= most[:, None])
                home = np.where(may, high, -np.inf).argmax(axis=1)
                at_home = np.zeros_like(may)
                at_home[np.arange(len(home)), home] = True
                may &= at_home if first else ~at_home
                groups, bodies = [], []
                for cell in np.flatnonzero(may.any(axis=0)).tolist():
                    at = np.flatnonzero(may[:, cell])
                    body = pickle.dumps((asker[at], own[at], label[at], vectors[at], [lows[k] for k in at], [highs[k] for k in at]), protocol=5)
                    for group in range(int(cells.base[cell]), int(cells.base[cell] + cells.groups[cell])):
                        groups.append(group)
                        bodies.append(body)
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array([1] * len(groups), pa.int32()), pa.array(bodies, pa.binary())], names=["group", "kind", "body"])

    return run


def asked_of(tree: Tree, labels: np.ndarray, ids: np.ndarray, edges: np.ndarray, block: tuple, k: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """(asker, window, score, id): the k best of the tree for each window. same: only rows of the asker's label, itself left out; else only those of other labels."""
    asker, own, label, vectors, lows, highs = block
    width = max(vectors.shape[1], tree.vectors.shape[1])
    of = np.repeat(np.arange(len(asker)), [len(x) for x in lows])
    number = np.concatenate([np.arange(len(x)) for x in lows])
    vectors = widened(vectors, width)
    asked = Asked(vectors[of], np.array([x for y in lows for x in y], np.int64), np.array([x for y in highs for x in y], np.int64), k)
    if tree.vectors.shape[1] < width:
        tree = replace(tree, vectors=widened(tree.vectors, width), centres=cover_tree.centres_for(tree.centres, width))

    def fits(q: int, rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = of[q]
        right = (labels[rows] == label[a]) == same
        rows, scores = rows[right], scores[right]
        if len(rows) > 4 * (k + 1):  # each row has an id, the asker's own aside
            enough = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            rows, scores = rows[enough], scores[enough]
        sizes = edges[rows + 1] - edges[rows]
        row = np.repeat(np.arange(len(rows)), sizes)
        mine = ids[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + edges[rows][row]]
        if same and len(own_rows := np.flatnonzero(mine == own[a])):
            itself = [x for x in own_rows if np.array_equal(tree.vectors[rows[row[x]]], vectors[a])]
            row, mine = np.delete(row, itself), np.delete(mine, itself)
        return scores[row], mine

    cover_tree.search(tree, asked, fits)
    for q, best in enumerate(asked.best):
        for minus, found in best:
            yield int(asker[of[q]]), int(number[q]), -minus, found


def answered(k: int, same: bool):
    """Rows come by group, its tree first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planted_tree, at = None, None
        for batch in batches:
            for group, kind, body in zip(batch.column("group").to_pylist(), batch.column("kind").to_pylist(), batch.column("body"), strict=True):
                if kind == 0:
                    planted_tree, at = body, group
                    continue
                if isinstance(planted_tree, pa.Scalar):  # opened only where something is asked
                    planted_tree = pickle.loads(planted_tree.as_buffer())
                if at != group:
                    raise ValueError(f"group {group} has no tree")
                rows = list(asked_of(*planted_tree, pickle.loads(body.as_buffer()), k, same))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["asker", "window", "score", "found_id"])

    return run


class Index:
    """All entries as cover trees in kept tables, for exact searches by inner product.

    entries: vec, label, ids, as `collapsed` gives them; count: their number; norm: their greatest.
    """

    def __init__(self, spark: SparkSession, entries: DataFrame, count: int, norm: float, folder: str):
        self.spark, self.folder, self.count = spark, folder, count
        each = min(max(count // (2 * partitions(spark)), SMALL), LARGE)
        cells = choose_cells(entries, count, norm, min(CELLS, -(-count // (4 * each))))
        placed = keep(entries.mapInArrow(dealt(cells), "vec binary, label long, ids array<long>, cell int, away double"), f"{folder}/placed")
        size = np.zeros(len(cells.centres), np.int64)
        for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():  # CELLS rows at most
            size[row.cell], cells.radius[row.cell] = row.n, row.radius
        cells.radius += 1e-6 * (1 + norm)
        cells.groups = -(-size // each)
        cells.base = np.cumsum(cells.groups) - cells.groups
        self.cells = cells
        table = spark.createDataFrame([(k, int(b), int(g)) for k, (b, g) in enumerate(zip(cells.base, cells.groups, strict=True))], "cell int, base int, groups int")
        grouped = placed.join(F.broadcast(table), "cell").withColumn("group", (F.col("base") + F.pmod(F.xxhash64("vec", "label"), F.col("groups"))).cast("int"))
        self.trees = keep(self._by_group(grouped.select("group", "vec", "label", "ids"), "vec", "label").mapInArrow(planted, "group int, kind int, body binary"), f"{folder}/trees")
        drop(spark, f"{folder}/placed")

    def _by_group(self, df: DataFrame, *order: str) -> DataFrame:
        n = partitions(self.spark)
        return df.repartitionById(n, F.pmod("group", F.lit(n)).cast("int")).sortWithinPartitions("group", *order)

    def _step(self, asked: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
        blocks = asked.select("asker", "vec_id", "label", "vec", "lows", "highs").mapInArrow(routed(self.cells, first), "group int, kind int, body binary")
        return self._by_group(self.trees.union(blocks), "kind").mapInArrow(answered(k, same), FOUND)

    def search(self, asked: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """(asker, window, score, found_id, place): for each window the first k rows by score, then id, kept as a table.

        asked: asker, vec_id, label, vec, lows, highs; a window is the stretch from an entry of lows to that of highs, both included.
        """
        order = Window.partitionBy("asker", "window").orderBy(F.desc("score"), "found_id")
        place = F.row_number().over(order)
        found = keep(self._step(asked, k, same, True).withColumn("place", place).where(F.col("place") <= k), f"{self.folder}/{name}1")
        if (self.cells.groups > 0).sum() < 2:
            return found
        full = found.groupBy("asker", "window").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
        full = full.groupBy("asker").agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("floors"))  # a window each
        raised = asked.join(full.hint("merge"), "asker", "left")
        raised = raised.withColumn("lows", F.transform("lows", lambda low, w: F.coalesce(F.try_element_at("floors", w), low)))
        more = self._step(raised, k, same, False)
        both = found.drop("place").unionByName(more)
        out = keep(both.withColumn("place", place).where(F.col("place") <= k), f"{self.folder}/{name}")
        drop(self.spark, f"{self.folder}/{name}1")
        return out


def collapsed(rows: DataFrame, most: int) -> DataFrame:
    """(vec, label, ids): rows of equal vectors and labels are one entry, with its first `most` distinct ids; later ones can be in no answer of fewer."""
    first = rows.select("vec", "label", "vec_id").distinct()
    rank = F.row_number().over(Window.partitionBy("vec", "label").orderBy("vec_id"))
    return first.withColumn("n", rank).where(F.col("n") <= most).groupBy("vec", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def hard_negatives(spark: SparkSession, rows: DataFrame, anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label, any other columns).

    Components become floor(scale * x), and a row's score is its inner product with the anchor;
    higher scores come first, ties by smaller vec_id. Anchors are the rows whose vec_id `anchor`
    picks; their positives are the first other rows of their label. For each, the first rows of
    other labels whose score is from `least` to `most` per cent of the positive's are returned.

    Rows in which id, label, vector or any component is null, or a component is not finite, take
    no part. Rows equal in id, label and components count once; other rows of one id are rows of
    their own. Vectors of different lengths meet as if the shorter one ended in zeros. Whole
    numbers are held within 31 bits, and scores are exact within 63. A positive of negative score
    has no window. An empty table, or one without anchors, gives an empty table.
    """
    folder = shared_folder(spark)
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    sound &= F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    numbers = rows.where(sound).select("embedding", F.col("label").cast("long").alias("label"), F.col("vec_id").cast("long").alias("vec_id")).mapInArrow(whole(scale), ENTRY)
    numbers = keep(numbers, f"{folder}/rows")
    top = numbers.agg(F.max("square").alias("square")).head().square
    norm = float(np.sqrt(top or 0.0))
    anchors = numbers.where(anchor(F.col("vec_id"))).select("vec_id", "label", "vec").distinct()
    anchors = keep(anchors.withColumn("asker", F.monotonically_increasing_id()), f"{folder}/anchors")
    entries = keep(collapsed(numbers, max(positives, negatives) + 1), f"{folder}/entries")
    index = Index(spark, entries, entries.count(), norm, folder)

    asked = anchors.withColumns({"lows": F.array(F.lit(-FAR)), "highs": F.array(F.lit(FAR))})
    near = index.search(asked, positives, True, "positives")
    windows = near.where("score >= 0").groupBy("asker").agg(F.sort_array(F.collect_set("score")).alias("of"))  # as many as positives at most
    windows = windows.withColumns({"lows": F.transform("of", lambda s: F.ceil(s * least / F.lit(100).cast("decimal(20,0)")).cast("long")), "highs": F.transform("of", lambda s: F.floor(s * most / F.lit(100).cast("decimal(20,0)")).cast("long"))})
    far = index.search(anchors.join(windows.hint("merge"), "asker"), negatives, False, "negatives")

    numbered = windows.select("asker", F.posexplode("of").alias("window", "score"))
    pairs = near.where("score >= 0").select("asker", "score", "found_id").join(numbered.hint("merge"), ["asker", "score"]).select("asker", "window", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = pairs.join(far.select("asker", "window", F.col("place").alias("rank"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge"), ["asker", "window"])
    out = out.join(anchors.select("asker", F.col("vec_id").alias("anchor_id")).hint("merge"), "asker")
    out = keep(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), f"{folder}/out")
    for name in ("rows", "anchors", "entries", "trees", "positives", "positives1", "negatives", "negatives1"):
        drop(spark, f"{folder}/{name}")
    return out


def op11_sql() -> str:
    return """
    with v as materialized (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, [floor(256 * x::double) for x in embedding] e from embeddings
      where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    s as materialized (select a.vec_id anchor_id, a.label own, b.vec_id, b.label, list_inner_product(a.e, b.e)::bigint score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
    p as (select * from s where label = own qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
    n as (select p.anchor_id, p.vec_id positive_id, s.vec_id negative_id, p.score positive_score, s.score negative_score,
        row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) r
      from p join s using (anchor_id) where s.label <> s.own and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
    select anchor_id, positive_id, r::int "rank", negative_id, positive_score, negative_score from n where r <= 5"""
