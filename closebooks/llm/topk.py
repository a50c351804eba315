"""Exact top-k by inner product, by a uniform threshold in three phases.

Rows are dealt over parts of a fixed size, by their place in the stored files. A part is held by a
task and the queries stream past it; no query or cutoff is collected, and all queries are
answered in one job a phase. A score is the sum of LISTS partial scores, each over a slice of
the components.
1. A query visits as many parts as the square root of their number. There it gathers the local
   top k of each list and the sums of these; the k-th best sum over the parts that it visits is a
   safe cutoff: k rows reach it.
2. The query goes to every part with its cutoff. Partial scores that add up to the cutoff have
   one of at least cutoff / LISTS, so the entries that reach that share in some list are
   sufficient; the part collects them from its lists.
3. Their remaining partial scores are added exactly; sums below the cutoff end in the part, which
   raises its own cutoff as it goes. The others, k a part at most, are ranked.
With one part in phase 1 for every sqrt(parts) in phase 2, the second phase does nearly all of the
multiplications, once, and a query has about k * sqrt(parts) rows to rank from either phase.

Components are floor(256 * x) of the value as double. Defined cases: a null id, a null
vector, and a vector with a null or non-finite component take no part; shorter vectors count
as ended by zeros; rows that repeat an id are candidates each, but no candidates of the query
with their id, which is asked once, with the greatest of its vectors; ties go to the smaller
id; an empty table gives an empty result; a component beyond long counts as the nearest long,
and a score or partial score of 2^62 or more is an error; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closebooks.llm.common import stored

LISTS = 4
PART_CELLS = 1 << 20  # components of the rows that a task holds
QUERIES = 2048  # that a task answers at a time
ROWS = 1024  # that a task scores at a time
TASKS = 8192  # that a phase is dealt over, at most
LOWEST = -(2**62)
EXACT = 2**52  # sums below it are exact in doubles

FOUND = "query_id long, vec_id long, score long"
#: Answers of a part: query ids, queries, cutoffs; ids and rows of the part by id -> columns.
Answer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def prepared(vectors: DataFrame) -> DataFrame:
    """The rows that take part: vec_id and whole components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & good).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, filled with zeros up to the width."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _most(x: np.ndarray) -> float:
    return float(np.abs(x.astype(float)).max(initial=0))


def _partials(queries: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Per list the partial scores, queries by rows."""
    width = queries.shape[1]
    most = _most(queries) * _most(rows) * max(width, 1)
    cuts = np.unique(np.linspace(0, width, LISTS + 1).astype(int))
    slices = list(zip(cuts[:-1], cuts[1:], strict=True)) or [(0, 0)]
    if most < EXACT:
        queries, rows = queries.astype(float), rows.astype(float)
    elif most >= 2**62:
        queries, rows = queries.astype(object), rows.astype(object)
    lists = [queries[:, a:b] @ rows[:, a:b].T for a, b in slices]
    if most >= 2**62:
        for scores in (*lists, reduce(np.add, lists)):
            if max((abs(x) for x in scores.flat), default=0) >= 2**62:
                raise OverflowError("a score does not fit in long")
        lists = [x.astype(np.int64) for x in lists]
    return lists


def _local_best(k: int) -> Answer:
    """(query, score): the best k sums of each query among the local top k of every list."""

    def answer(ids, queries, _, vec_id, rows):
        best = np.full((len(ids), k), LOWEST, np.int64)
        for at in range(0, len(rows), ROWS):
            lists = _partials(queries, rows[at:at + ROWS])
            total = reduce(np.add, lists).astype(np.int64)
            total[ids[:, None] == vec_id[None, at:at + ROWS]] = LOWEST
            n = min(k, total.shape[1])
            top = np.concatenate(
                [np.argpartition(-x, n - 1, axis=1)[:, :n] for x in lists], axis=1)
            top.sort(axis=1)
            sums = np.take_along_axis(total, top, axis=1)
            sums[:, 1:][top[:, 1:] == top[:, :-1]] = LOWEST  # found in two lists
            both = np.concatenate([best, sums], axis=1)
            best = -np.partition(-both, k - 1, axis=1)[:, :k]
        q, _ = np.nonzero(best > LOWEST)
        return [ids[q], best[best > LOWEST]]

    return answer


def _sufficient(k: int) -> Answer:
    """(query, row, score): entries that some list says may reach the cutoff, if they do."""

    def answer(ids, queries, cutoff, vec_id, rows):
        cutoff = cutoff.copy()
        q, r, score = (np.zeros(0, np.int64) for _ in range(3))
        for at in range(0, len(rows), ROWS):
            lists = _partials(queries, rows[at:at + ROWS])
            share = (cutoff // len(lists))[:, None]
            enough = reduce(np.logical_or, (x >= share for x in lists))
            enough &= ids[:, None] != vec_id[None, at:at + ROWS]
            i, j = np.nonzero(enough)
            total = reduce(np.add, (x[i, j] for x in lists)).astype(np.int64)
            keep = total >= cutoff[i]
            q, r = np.concatenate([q, i[keep]]), np.concatenate([r, at + j[keep]])
            score = np.concatenate([score, total[keep]])
            order = np.lexsort((r, -score, q))
            q, r, score = q[order], r[order], score[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            full = nth == k - 1
            # Rows come by id: what follows must be better than the k-th, not as good.
            cutoff[q[full]] = np.maximum(cutoff[q[full]], score[full] + 1)
            q, r, score = q[nth < k], r[nth < k], score[nth < k]
        return [ids[q], vec_id[r], score]

    return answer


def _past_parts(answer: Answer, width: int, names: list[str]):
    """Held parts (kind 0), past which queries (kind 1) stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, fresh = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                piece = batch.slice(lo, hi - lo)
                if part[lo] != now:
                    now, held, fresh = part[lo], None, []
                if kind[lo] == 0:
                    fresh.append((piece.column(2).to_numpy(), _matrix(piece.column(3), width)))
                    continue
                if fresh:
                    held = tuple(np.concatenate(x) for x in zip(*fresh, strict=True))
                    fresh = []
                if held is None:
                    continue  # no row was dealt to this part
                for at in range(0, piece.num_rows, QUERIES):
                    asked = piece.slice(at, QUERIES)
                    found = answer(asked.column(2).to_numpy(), _matrix(asked.column(3), width),
                                   asked.column(4).to_numpy(), *held)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    return run


def _phase(rows: DataFrame, queries: DataFrame, parts: int, visits: int, width: int,
           answer: Answer, schema: str) -> DataFrame:
    """Answers of the first `visits` parts from the one that a query's hash names."""
    first = F.pmod(F.xxhash64("vec_id"), F.lit(parts).cast("long"))
    visited = F.transform(F.sequence(F.lit(0), F.lit(visits - 1)),
                          lambda i: F.pmod(first + i, F.lit(parts)).cast("int"))
    asked = queries.select(F.explode(visited).alias("part"), F.lit(1).alias("kind"),
                           "vec_id", "v", "cutoff")
    both = rows.select("part", F.lit(0).alias("kind"), "vec_id", "v",
                       F.lit(0).cast("long").alias("cutoff")).unionByName(asked)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return both.repartition(min(parts, TASKS), "part").sortWithinPartitions(
        "part", "kind", "vec_id").mapInArrow(_past_parts(answer, width, names), schema)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5,
          part_cells: int = PART_CELLS) -> DataFrame:
    """For each row whose id is divisible by `every`: its k best other rows."""
    spark = vectors.sparkSession
    rows = stored(prepared(vectors), "topk-vectors")
    n, width, most = rows.agg(
        F.count(F.lit(1)), F.max(F.size("v")),
        F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -1 - x))))).head()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # The narrowest type that holds every component, as vectors are sent to many parts.
    kind = next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63))
                if (most or 0) < 1 << bits)
    # Small tables are cut finer, into one part a core; the result is the same.
    parts = max(math.ceil(n * max(width, 1) / part_cells),
                min(math.ceil(n / ROWS), spark.sparkContext.defaultParallelism))
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    narrow = F.col("v").cast(f"array<{kind}>").alias("v")
    dealt = rows.select("vec_id", narrow, F.pmod(place, F.lit(parts)).cast("int").alias("part"))
    queries = stored(
        rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
        .select("vec_id", narrow, F.lit(0).cast("long").alias("cutoff")), "topk-queries")
    gathered = _phase(dealt, queries, parts, math.ceil(math.sqrt(parts)), width,
                      _local_best(k), "query_id long, score long")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    safe = stored(gathered.withColumn("nth", nth).where(F.col("nth") == k).select(
        "query_id", F.col("score").alias("safe")), "topk-cutoffs")
    informed = queries.join(safe, F.col("vec_id") == F.col("query_id"), "left").select(
        "vec_id", "v", F.coalesce("safe", F.lit(LOWEST)).alias("cutoff"))
    found = _phase(dealt, informed, parts, parts, width, _sufficient(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOP_K_SQL = """
with good as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from good q join good c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank
      from scored)
where rank <= 5
"""
