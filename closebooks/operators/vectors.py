"""Nearest rows to a question vector, over a column of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebooks import fixed_values as V

MOST_QUESTIONS = 4096  # of one call: they are sent to every task
MANY_QUESTIONS = 32  # from which on the rows are dealt over all tasks
TILE_ROWS, TILE_QUESTIONS = 256, 128  # whose distances are computed together


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    """Squared Euclidean distance; null unless the vector is as long as the query.

    One expression for every length: gaps by position, summed in order.
    """
    point = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")
    gaps = F.zip_with(vector, point, lambda a, b: a.cast("double") - b)
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)


def vector_top_k(
    df: DataFrame, query: Sequence[float], k: int = V.RETRIEVAL_K,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """key, rank of the k nearest rows by Euclidean distance, ties by key.

    Vectors that are null, of another length, or with an empty cell have no distance.
    Every task keeps its own k best, so the sort never sees more than k rows each.
    """
    distance = F.col("_d2")
    best = (
        df.filter(F.size(vector) == len(query))
        .select(F.col(key), squared_distance(F.col(vector), query).alias("_d2"))
        .filter(distance.isNotNull() & ~F.isnan(distance))
        .orderBy("_d2", key)
        .limit(k)
    )
    ranked = best.agg(
        F.array_sort(F.collect_list(F.struct("_d2", F.col(key).alias("id")))).alias("b")
    )
    return ranked.select(F.posexplode("b")).select(
        F.col("col.id").alias(key), (F.col("pos") + 1).alias("rank")
    )


def _tile_best(d2: np.ndarray, k: int, most: np.ndarray) -> np.ndarray:
    """The cells of at most `most`, and of a column with more than k its first k; `most` falls.

    Rows come in key order, so of equal distances the first ones are taken. NaN is no distance.
    """
    best = d2 <= most
    full = np.flatnonzero(np.count_nonzero(best, axis=0) > k)
    if len(full):
        some = np.where(best[:, full], d2[:, full], np.nan)  # NaN sorts last
        kth = np.partition(some, k - 1, axis=0)[k - 1]
        less, tied = some < kth, some == kth
        room = k - np.count_nonzero(less, axis=0)
        best[:, full] = less | (tied & (np.cumsum(tied, axis=0) <= room))
        most[full] = kth
    return best


def _near_rows(
    asked: list[tuple[str, list[float]]], k: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per batch of rows (key, vector): question, key and squared distance of what can be
    among the k nearest. Squares are added in the order of the cells, a cell at a time.
    """
    by_length: dict[int, list[tuple[str, list[float]]]] = {}
    for name, point in asked:
        by_length.setdefault(len(point), []).append((name, point))
    groups = {
        length: ([name for name, _ in some],
                 np.array([point for _, point in some], np.float64).reshape(-1, length).T.copy())
        for length, some in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = {length: np.full(len(names), np.inf) for length, (names, _) in groups.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows.take(pc.sort_indices(
                rows, sort_keys=[(rows.column_names[0], "ascending")], null_placement="at_start"))
            vectors = rows.column(1).combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
            for length, (names, points) in groups.items():
                mine = np.flatnonzero(sizes == length)
                cells = vectors.take(pa.array(mine)).flatten()
                # An empty cell is null: NaN takes its row out.
                data = cells.to_numpy(zero_copy_only=False).astype(np.float64)
                data = data.reshape(len(mine), length).T.copy()
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for lo in range(0, len(mine), TILE_ROWS):
                    part = data[:, lo:lo + TILE_ROWS]
                    for first in range(0, len(names), TILE_QUESTIONS):
                        some = slice(first, first + TILE_QUESTIONS)
                        d2 = np.zeros((part.shape[1], len(names[some])))
                        gap = np.empty_like(d2)
                        with np.errstate(all="ignore"):
                            for row, point in zip(part, points[:, some], strict=True):
                                np.subtract.outer(row, point, out=gap)
                                np.multiply(gap, gap, out=gap)
                                d2 += gap
                        row, column = np.nonzero(_tile_best(d2, k, most[length][some]))
                        if len(row):
                            found.append((first + column, mine[lo + row], d2[row, column]))
                if found:
                    column, row, d2 = map(np.concatenate, zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()).take(pa.array(column)),
                         rows.column(0).take(pa.array(row)).combine_chunks(),
                         pa.array(d2, pa.float64())], names=["_q", "_key", "_d2"])

    return run


def vector_top_k_of(
    df: DataFrame, questions: DataFrame, k: int = V.RETRIEVAL_K, key: str = "vec_id",
    vector: str = "embedding", question: str = "question_id", point: str = "embedding",
) -> DataFrame:
    """question, key, rank: the k nearest rows to each vector of a table of questions.

    One pass over the rows answers all questions, which are read at once and sent to the tasks;
    more than MOST_QUESTIONS are an error (ask again with the next ones, as
    `vector_top_k_rounds` does). Distances, what has none, and ties are those of `vector_top_k`.
    Every task keeps what can be among the k best of a question before anything is shuffled.
    A null question, or one without rows of its length, has no answer.
    """
    spark = df.sparkSession
    asked = questions.filter(F.col(question).isNotNull() & F.col(point).isNotNull()).select(
        F.col(question).cast("string").alias("q"), F.col(point).cast("array<double>").alias("p")
    ).limit(MOST_QUESTIONS + 1).collect()
    if len(asked) > MOST_QUESTIONS:
        raise ValueError(f"more than {MOST_QUESTIONS} questions")
    rows = df.select(F.col(key).alias("_key"), F.col(vector).alias("_v"))
    if len(asked) >= MANY_QUESTIONS:  # the work lies in the pairs, not in the bytes read
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(tasks, F.xxhash64("_key", "_v"))
    # A question with an empty cell has no distance to anything.
    whole = [(r["q"], r["p"]) for r in asked if None not in r["p"]]
    near = rows.withColumn("_v", F.col("_v").cast("array<double>")).mapInArrow(
        _near_rows(whole, max(k, 1)), T.StructType().add("_q", "string")
        .add("_key", df.schema[key].dataType).add("_d2", "double"))
    ranked = W.partitionBy("_q").orderBy("_d2", "_key")
    return (
        near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        .select(F.col("_q").cast(questions.schema[question].dataType).alias(question),
                F.col("_key").alias(key), "rank")
    )


def vector_top_k_rounds(
    df: DataFrame, questions: DataFrame, k: int = V.RETRIEVAL_K, key: str = "vec_id",
    vector: str = "embedding", question: str = "question_id", point: str = "embedding",
) -> DataFrame:
    """`vector_top_k_of` for any number of questions: a pass over the rows for each part of them.

    Questions are dealt by the hash of their name, about half of MOST_QUESTIONS to a round.
    """
    rounds = max(1, -(-2 * questions.count() // MOST_QUESTIONS))
    nth = F.pmod(F.xxhash64(question), F.lit(rounds))
    return reduce(DataFrame.unionByName, [
        vector_top_k_of(df, questions.filter(nth == i), k, key, vector, question, point)
        for i in range(rounds)])
