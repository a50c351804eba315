"""Hard-negative mining by a multiway hyperplane tree with distance ranges.

Scores are inner products. With one more component, sqrt(M^2 - |x|^2), every row has the
length M of the longest one, and a score s with a query q is the distance
sqrt(|q|^2 + M^2 - 2 s): a window of scores is an annulus around q.

The tree is fitted on a sample: a node has FAN split points, far from each other, and a row goes
to the nearest. Then every row is indexed, and each node learns from all rows, for every split
point i and subtree j, the least and greatest distance of i to a row in j. A query at distance d
from i, with the annulus a..b, can only find rows at max(d - b, a - d, 0) to d + b from i:
subtrees whose range does not meet that are left out. What stays is searched exactly: rows are
cut by leaf into parts, a part is held, and the queries that visit it stream past.

An anchor first searches the leaf it falls in, which bounds its scores, then the others: once
for its positives and once for the negatives in the windows that its positives set.

Components are floor(256 * x) of the value as double. Defined cases: a null id, label or vector,
and a vector with a null or non-finite component take no part; shorter vectors count as ended by
zeros; rows that repeat an id are rows each, but no positives of the anchor with their id, which
is asked once, with the greatest of its labels and vectors; ties go to the smaller id; a positive
with a negative score has no window; an anchor without positives or negatives has no rows; an
empty table gives an empty result; a component beyond long is an error, and so is a score; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from closebooks.llm.common import stored

SAMPLE = 16_384  # rows that the tree is fitted on, at most
FAN = 8  # split points of a node
DEPTH = 4  # levels at most: no more than 4,096 leaves
LEAF_ROWS = 2048  # rows of a leaf, on average, until the levels run out
PART_ROWS = 4096  # rows of a leaf that a task holds
TASKS = 4096  # that a search is dealt over, at most
LOWEST = -(2**62)
EXACT = 2**52  # sums below it are exact in doubles
SLACK = 1e-6  # of the length M, for rounding

ROW = "vec_id long, label long, vec binary, leaf int"
FOUND = "anchor_id long, slot int, vec_id long, score long"


def prepared(vectors: DataFrame) -> DataFrame:
    """The rows that take part: vec_id, label and whole components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


@dataclass
class Node:
    """Split points with their extra component; children: a node's number, or -1 - a leaf's."""

    points: np.ndarray
    children: list[int] = field(default_factory=list)
    low: np.ndarray | None = None  # low[i, j]: least distance of point i to a row below j
    high: np.ndarray | None = None


@dataclass
class Tree:
    """Nodes from the root; without any, all rows are in leaf 0."""

    length: float  # M, that no row exceeds
    width: int
    dtype: str
    nodes: list[Node]
    leaves: int

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Rows with the component that gives them the length M."""
        rows = rows.astype(float)
        rest = self.length**2 - np.einsum("ij,ij->i", rows, rows)
        return np.column_stack([rows, np.sqrt(np.maximum(rest, 0.0))])

    def unpack(self, column: pa.Array) -> np.ndarray:
        data = b"".join(column.to_pylist())
        return np.frombuffer(data, self.dtype).reshape(-1, self.width).astype(np.int64)

    def descend(self, rows: np.ndarray, see: Callable | None = None) -> np.ndarray:
        """Leaf of each lifted row. `see` gets node, split points' distances and the choice."""
        leaf = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))] if self.nodes else []
        while todo:
            at, index = todo.pop()
            node = self.nodes[at]
            near = rows[index] @ node.points.T  # all points have one length
            choice = near.argmax(axis=1)
            if see:
                see(at, near, choice)
            for j, child in enumerate(node.children):
                below = index[choice == j]
                if child < 0:
                    leaf[below] = -1 - child
                elif len(below):
                    todo.append((child, below))
        return leaf

    def visits(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(query, leaf) pairs that may hold a score in one of the query's windows.

        queries: whole vectors; low, high: queries by windows, no window where low > high.
        """
        q = queries.astype(float)
        norm = np.einsum("ij,ij->i", q, q)
        top = norm + self.length**2
        wide = SLACK * (self.length + np.sqrt(norm))[:, None]
        near = np.sqrt(np.maximum(top[:, None] - 2.0 * high, 0.0)) - wide
        far = np.sqrt(np.maximum(top[:, None] - 2.0 * low, 0.0)) + wide
        far[low > high] = -1.0
        open_ = (low <= high).any(axis=1)
        out = []
        todo = [(0, np.flatnonzero(open_))] if self.nodes else []
        if not self.nodes:
            return np.column_stack([np.flatnonzero(open_), np.zeros(open_.sum(), int)])
        while todo:
            at, index = todo.pop()
            node = self.nodes[at]
            d = np.sqrt(np.maximum(top[index, None] - 2.0 * (q[index] @ node.points[:, :-1].T), 0.0))
            a, b = near[index][:, :, None], far[index][:, :, None]
            least = np.maximum(np.maximum(d[:, None] - b, a - d[:, None]), 0.0)
            most = d[:, None] + b
            meets = (node.low[None, None] <= most[..., None]) & (
                node.high[None, None] >= least[..., None])
            alive = (meets.all(axis=2) & (b >= 0)).any(axis=1)
            for j, child in enumerate(node.children):
                below = index[alive[:, j]]
                if not len(below):
                    continue
                if child < 0:
                    out.append(np.column_stack([below, np.full(len(below), -1 - child)]))
                else:
                    todo.append((child, below))
        return np.concatenate(out) if out else np.zeros((0, 2), int)


def _far_points(rows: np.ndarray, fan: int) -> np.ndarray:
    """Indices of `fan` rows, each the farthest from those before among 3 * fan candidates."""
    candidates = np.unique(np.linspace(0, len(rows) - 1, 3 * fan).astype(int))
    points = rows[candidates]
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < fan and gap.max() > 1e-9:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return candidates[chosen]


def fitted(sample: np.ndarray, tree: Tree, depth: int) -> Tree:
    """The tree's nodes from a sample of whole vectors; ranges are learned later."""
    rows = tree.lifted(sample)
    levels = [(np.arange(len(rows)), 0, -1, -1)]  # rows, level, parent, place there
    while levels:
        index, level, parent, place = levels.pop()
        points = _far_points(rows[index], FAN) if (
            level < depth and len(index) >= 2 * FAN) else np.zeros(0, int)
        if len(points) < 2:
            if parent >= 0:
                tree.nodes[parent].children[place] = -1 - tree.leaves
                tree.leaves += 1
            continue
        number = len(tree.nodes)
        node = Node(rows[index[points]], [0] * len(points))
        tree.nodes.append(node)
        if parent >= 0:
            tree.nodes[parent].children[place] = number
        choice = (rows[index] @ node.points.T).argmax(axis=1)
        levels += [(index[choice == j], level + 1, number, j) for j in range(len(points))]
    tree.leaves = max(tree.leaves, 1)
    return tree


def _index(rows: DataFrame) -> tuple[Tree, DataFrame] | None:
    """The tree, and every row with its leaf, stored."""
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, width, most, square = rows.agg(
        F.count(F.lit(1)), F.max(F.size("v")),
        F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -1 - x)))),
        F.max(squares)).head()
    if not n:
        return None
    dtype = next(t for t in ("<i1", "<i2", "<i4", "<i8") if (most or 0) <= np.iinfo(t).max)
    tree = Tree(math.sqrt(square) * (1 + 1e-9) + 1e-9, max(width, 1), dtype, [], 0)
    # The sample: the least hashes, found among about twice as many rows.
    luck = F.xxhash64("vec_id", "v", F.lit("sample"))
    share = min(1.0, 2 * SAMPLE / n + 64 / n)
    near = F.pmod(luck, F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))
    sample = rows.where(near).orderBy(luck, "vec_id").limit(SAMPLE).select("v").collect()
    vectors = np.zeros((len(sample), tree.width), np.int64)
    for i, r in enumerate(sample):
        vectors[i, :len(r["v"])] = r["v"]
    depth = min(DEPTH, math.ceil(math.log(max(1.0, n / LEAF_ROWS), FAN)))
    tree = fitted(vectors, tree, depth)
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(tree)  # 4,096 leaves at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            v = np.zeros((batch.num_rows, t.width), np.int64)
            v[np.arange(t.width)[None, :] < lengths[:, None]] = flat
            packed = v.astype(t.dtype)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([row.tobytes() for row in packed], pa.binary()),
                 pa.array(t.descend(t.lifted(v)), pa.int32())],
                names=["vec_id", "label", "vec", "leaf"])

    indexed = stored(rows.select("vec_id", "label", "v").mapInArrow(assign, ROW), "gnat-rows")
    _learn_ranges(indexed, tree)
    return tree, indexed


def _learn_ranges(indexed: DataFrame, tree: Tree) -> None:
    """Distance ranges of all rows; what is collected has a row per pair of split points."""
    for node in tree.nodes:
        m = len(node.children)
        node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
    sent = indexed.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        seen = [(n.low.copy(), n.high.copy()) for n in t.nodes]

        def see(at: int, near: np.ndarray, choice: np.ndarray) -> None:
            d = np.sqrt(np.maximum(2 * t.length**2 - 2.0 * near, 0.0))
            for j in np.unique(choice).tolist():
                mine = d[choice == j]
                seen[at][0][:, j] = np.minimum(seen[at][0][:, j], mine.min(axis=0))
                seen[at][1][:, j] = np.maximum(seen[at][1][:, j], mine.max(axis=0))

        for batch in batches:
            t.descend(t.lifted(t.unpack(batch.column(0))), see)
        out = [(at, i, j, low[i, j], high[i, j]) for at, (low, high) in enumerate(seen)
               for i in range(len(low)) for j in range(len(low)) if low[i, j] <= high[i, j]]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*out, strict=True)], names=["at", "i", "j", "lo", "hi"])

    if not tree.nodes:
        return
    found = indexed.select("vec").mapInArrow(run, "at long, i long, j long, lo double, hi double")
    for r in found.groupBy("at", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")
                                               ).collect():
        tree.nodes[r["at"]].low[r["i"], r["j"]] = r["lo"] - SLACK * tree.length
        tree.nodes[r["at"]].high[r["i"], r["j"]] = r["hi"] + SLACK * tree.length


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(
        queries.shape[1], 1)
    if most < EXACT:
        return (queries.astype(float) @ rows.astype(float).T).astype(np.int64)
    if most < 2**62:
        return queries @ rows.T
    exact = queries.astype(object) @ rows.astype(object).T
    if len(exact) and max(abs(x) for x in exact.flat) >= 2**62:
        raise OverflowError("a score does not fit in long")
    return exact.astype(np.int64)


def _best(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best allowed scores of each query; rows come by id."""
    count = score.shape[1]
    top = int(np.abs(score).max(initial=0))
    if (top + 1) * (count + 1) < 2**62:
        key = np.where(ok, score * count + (count - 1 - np.arange(count)), LOWEST)
        n = min(k, count)
        best = np.argpartition(-key, n - 1, axis=1)[:, :n]
        q, c = np.nonzero(np.take_along_axis(ok, best, axis=1))
        return q, best[q, c]
    pairs = [(i, r) for i in range(len(score)) for r in sorted(
        np.flatnonzero(ok[i]).tolist(), key=lambda r: (-int(score[i, r]), r))[:k]]
    q, r = np.array(pairs, int).reshape(-1, 2).T
    return q, r


def _search(sent, same: bool, k: int):
    """Held parts of leaves (kind 0), past which queries (kind 1) stream."""

    def answer(batch: pa.RecordBatch, held, tree: Tree) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = held
        windows = np.array(batch.column(6).to_pylist(), np.int64)
        anchor = batch.column(3).to_numpy()
        score = _scores(tree.unpack(batch.column(5)), rows)
        alike = batch.column(4).to_numpy()[:, None] == labels[None, :]
        allowed = alike & (anchor[:, None] != ids[None, :]) if same else ~alike
        for slot in range(windows.shape[1] // 2):
            low, high = windows[:, 2 * slot, None], windows[:, 2 * slot + 1, None]
            q, r = _best(score, allowed & (score >= low) & (score <= high), k)
            if len(q):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[q]), pa.array(np.full(len(q), slot, np.int32)),
                     pa.array(ids[r]), pa.array(score[q, r])],
                    names=["anchor_id", "slot", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, now, fresh = sent.value, None, None, []
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part, key = batch.slice(lo, hi - lo), tuple(keys[lo, :2])
                if key != now:
                    now, held, fresh = key, None, []
                if keys[lo, 2] == 0:
                    fresh.append(part)
                    continue
                if fresh:
                    whole = pa.Table.from_batches(fresh).combine_chunks()
                    held, fresh = (whole.column(3).to_numpy(), whole.column(4).to_numpy(),
                                   tree.unpack(whole.column(5))), []
                if held is not None:
                    yield from answer(part, held, tree)

    return run


class Searcher:
    """The index: rows by part of a leaf, and searches of it."""

    def __init__(self, tree: Tree, indexed: DataFrame):
        self.tree = tree
        self.sent = indexed.sparkSession.sparkContext.broadcast(tree)
        counts = indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        parts = counts.select("leaf", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
        # One row a leaf, 4,096 at most: collected, and sent as a table to broadcast.
        found = [(r["leaf"], r["parts"]) for r in parts.collect()]
        self.parts: DataFrame = indexed.sparkSession.createDataFrame(found, "leaf int, parts int")
        self.tasks = max(1, min(TASKS, sum(p for _, p in found) // 2))
        # Rows are dealt by their place in the stored files, so that equal rows are spread too.
        place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        self.rows = indexed.select("*", place.alias("place")).join(
            F.broadcast(self.parts), "leaf").select(
            "leaf", F.pmod("place", F.col("parts").cast("long")).cast("int").alias("part"),
            F.lit(0).alias("kind"), "vec_id", "label", "vec",
            F.lit(None).cast("array<long>").alias("windows"))

    def visits(self, anchors: DataFrame, home: bool) -> DataFrame:
        """Anchors with the leaf they fall in (home), or the others that may hold a score."""
        sent = self.sent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = tree.unpack(batch.column(2))
                own = tree.descend(np.column_stack([q.astype(float), np.zeros(len(q))]))
                if home:
                    pairs = np.column_stack([np.arange(len(q)), own])
                else:
                    w = np.array(batch.column(3).to_pylist(), np.int64)
                    pairs = tree.visits(q, w[:, ::2], w[:, 1::2])
                    pairs = pairs[pairs[:, 1] != own[pairs[:, 0]]]
                picked = batch.take(pa.array(pairs[:, 0]))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, pa.array(pairs[:, 1].astype(np.int32))],
                    names=["vec_id", "label", "vec", "windows", "leaf"])

        return anchors.select("vec_id", "label", "vec", "windows").mapInArrow(
            run, "vec_id long, label long, vec binary, windows array<long>, leaf int")

    def found(self, anchors: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
        """The k best rows a part of a leaf, by anchor and window (slot)."""
        asked = self.visits(anchors, home).join(F.broadcast(self.parts), "leaf").select(
            "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            F.lit(1).alias("kind"), "vec_id", "label", "vec", "windows")
        both = self.rows.unionByName(asked).repartition(self.tasks, "leaf", "part")
        return both.sortWithinPartitions("leaf", "part", "kind", "vec_id").mapInArrow(
            _search(self.sent, same, k), FOUND)

    def best(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best rows of each window, ranked; the leaf at home first, which raises `low`."""
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
        nth = F.row_number().over(order)
        near = stored(self.found(anchors, same, k, True).withColumn("rank", nth)
                      .where(F.col("rank") <= k), "gnat-home")
        safe = near.where(F.col("rank") == k).groupBy("anchor_id").agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("safe"))

        def raised(low, i):
            known = F.try_element_at("safe", F.floor(i / 2).cast("int"))
            return F.when(i % 2 == 0, F.greatest(low, known)).otherwise(low)

        tighter = anchors.join(safe, F.col("vec_id") == F.col("anchor_id"), "left").select(
            "vec_id", "label", "vec", F.transform("windows", raised).alias("windows"))
        rest = self.found(tighter, same, k, False)
        return near.drop("rank").unionByName(rest).withColumn("rank", nth).where(
            F.col("rank") <= k)


def mined(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3,
          least: int = 50, most: int = 95) -> DataFrame:
    """For each anchor and positive the best negatives from `least` to `most` per cent of its score.

    Anchors are the rows whose id is divisible by `every`; its positives are the best rows of
    its label.
    """
    spark: SparkSession = vectors.sparkSession
    out = ("anchor_id long, positive_id long, rank int, negative_id long, "
           "positive_score long, negative_score long")
    index = _index(prepared(vectors))
    if index is None:
        return spark.createDataFrame([], out)
    searcher = Searcher(*index)
    anchors = stored(
        index[1].where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
            F.max(F.struct("label", "vec")).alias("best")).select("vec_id", "best.*"),
        "gnat-anchors")
    everything = F.array(F.lit(LOWEST), F.lit(-LOWEST)).cast("array<long>")
    pairs = stored(searcher.best(
        anchors.withColumn("windows", everything), True, positives).select(
            "anchor_id", (F.col("rank") - 1).cast("int").alias("slot"),
            F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "gnat-positives")
    # Whole scores n with least * p <= 100 * n <= most * p, for the positive's score p.
    low = F.expr(f"(positive_score * {least} + 99) div 100")
    high = F.when(F.col("positive_score") >= 0, F.expr(f"positive_score * {most} div 100"))
    windows = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(
        "slot", low.alias("low"), F.coalesce(high, low - 1).alias("high")))).alias("w"))
    none = F.array(F.lit(0), F.lit(-1)).cast("array<long>")
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(
        F.try_element_at(F.transform("w", lambda x: F.array(x["low"], x["high"])), i + 1), none)))
    asked = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "vec", flat.alias("windows"))
    hard = searcher.best(stored(asked, "gnat-windows"), False, negatives).select(
        "anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    return hard.join(pairs, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score")


MINED_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as alike,
    list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::bigint as score
  from rows a join rows r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
negatives as (
  select anchor_id, positive_id, s.vec_id as negative_id, positive_score, s.score as negative_score,
    row_number() over (partition by anchor_id, positive_id
                       order by s.score desc, s.vec_id)::int as rank
  from positives p join scored s using (anchor_id)
  where not s.alike and 50 * positive_score <= 100 * s.score
    and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score
from negatives where rank <= 3
"""
