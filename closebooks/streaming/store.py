"""The store of a landing stream: rows by batch, an index of their keys, and merged batches.

Every batch owns one folder of the store and one of the index, which it overwrites. Next to
a folder `X` of batches, `X_merged` holds older batches in files of a fair size, with the
batch number as a column; which ranges of batches are to be read there is said by its `done`
rows, each written after its range. A batch lies in exactly one of the two for a reader.

The index has the keys of the stored rows in BUCKETS hash buckets, as partitions. A batch
looks its keys up in the buckets they fall into; the rows of the store are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebooks.schemas import BATCH_KEYS, TABLE_SCHEMAS

BUCKETS = 256
SPAN = 100  # batches that are merged into one

BATCH = "ingest_batch"
_FIRST = "first_batch"
_NO_KEY = -1  # bucket of the row that says a batch is indexed
_INDEX = T.StructType().add("key", T.StringType()).add("bucket", T.IntegerType())
_DONE = f"last_batch bigint, row_count bigint, {_FIRST} bigint"


@dataclass(frozen=True)
class Batches:
    """A folder of batches with its merged part. `by` are partition columns within a batch."""

    path: str
    schema: T.StructType
    by: tuple[str, ...] = ()

    @property
    def merged(self) -> str:
        return f"{self.path}_merged"


def rows_of(store: str, table: str) -> Batches:
    return Batches(store.rstrip("/"), TABLE_SCHEMAS[table])


def index_of(store: str) -> Batches:
    return Batches(f"{store.rstrip('/')}_keys", _INDEX, ("bucket",))


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store, wherever it lies."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ranges(spark: SparkSession, batches: Batches) -> list[tuple[int, int]]:
    """(first, last) of the merged ranges, in order: one row per SPAN batches."""
    done = _read(spark, f"{batches.merged}/done", _DONE)
    if done is None:
        return []
    return sorted((r[_FIRST], r["last_batch"]) for r in done.collect())


def _within(spans: list[tuple[int, int]]) -> Column:
    """Whether a batch lies in one of the ranges; neighbouring ranges are one condition."""
    joined: list[tuple[int, int]] = []
    for first, last in spans:
        if joined and joined[-1][1] + 1 == first:
            joined[-1] = (joined[-1][0], last)
        else:
            joined.append((first, last))
    inside = F.lit(False)
    for first, last in joined:
        inside = inside | F.col(BATCH).between(first, last)
    return inside


def read_batches(
    spark: SparkSession, batches: Batches, before: int | None = None
) -> DataFrame | None:
    """All rows of the batches with their batch number, or None; optionally of older ones."""
    number = T.StructField(BATCH, T.LongType())
    schema = T.StructType([*batches.schema.fields, number])
    spans = ranges(spark, batches)
    frames = []
    live = _read(spark, batches.path, schema)
    if live is not None:
        frames.append(live.filter(~_within(spans)) if spans else live)
    if spans:
        merged = _read(spark, f"{batches.merged}/rows",
                       T.StructType([*schema.fields, T.StructField(_FIRST, T.LongType())]))
        frames.append(merged.filter(F.col(_FIRST).isin([first for first, _ in spans]))
                      .select(*schema.names))
    if not frames:
        return None
    rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return rows if before is None else rows.filter(F.col(BATCH) < before)


def write_batch(rows: DataFrame, batches: Batches, batch_id: int) -> None:
    """A batch's rows, in place of what an earlier try has left."""
    writer = rows.select(*batches.schema.names).write.mode("overwrite")
    writer.partitionBy(*batches.by).parquet(f"{batches.path}/{BATCH}={batch_id}")


def live_batches(spark: SparkSession, batches: Batches) -> set[int]:
    """Numbers of the batches with files of their own, from the names of the files."""
    live = _read(spark, batches.path, T.StructType([*batches.schema.fields]))
    names = live.inputFiles() if live is not None else []
    return {int(x) for name in names for x in re.findall(rf"/{BATCH}=(\d+)/", name)}


def merge_batches(
    spark: SparkSession, batches: Batches, before: int, span: int = SPAN
) -> list[tuple[int, int]]:
    """Merge every whole range of `span` batches below `before`; safe to repeat.

    Returns the new ranges. The folders of a merged range are deleted by the next call, so
    that readers of today can finish. A call that is cut short leaves unmerged batches, or
    merged ones whose folders the next call deletes; no row is ever read twice or lost.
    """
    spans = ranges(spark, batches)
    live = live_batches(spark, batches)
    covered = {b for b in live if any(first <= b <= last for first, last in spans)}
    new = []
    for first in sorted({b // span * span for b in live - covered}):
        last = first + span - 1
        if last >= before or any(a <= last and first <= b for a, b in spans):
            continue
        number = T.StructField(BATCH, T.LongType())
        rows = _read(spark, batches.path, T.StructType([*batches.schema.fields, number])).filter(
            F.col(BATCH).between(first, last))
        target = f"{batches.merged}/rows/{_FIRST}={first}"
        rows.hint("rebalance", *batches.by).write.mode("overwrite").partitionBy(
            *batches.by).parquet(target)
        count = _read(spark, target, rows.schema).count()
        spark.createDataFrame([(last, count)], "last_batch bigint, row_count bigint").coalesce(
            1).write.mode("overwrite").parquet(f"{batches.merged}/done/{_FIRST}={first}")
        new.append((first, last))
    for batch in sorted(covered):
        remove(spark, f"{batches.path}/{BATCH}={batch}")
    return new


# -- the key index --------------------------------------------------------------------

def bucket_of(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _index_rows(rows: DataFrame, key: str) -> DataFrame:
    """Distinct keys with their bucket, and the batch number if the rows have it."""
    number = [BATCH] if BATCH in rows.columns else []
    keys = rows.select(F.col(key).alias("key"), *number).filter(F.col("key").isNotNull())
    return keys.distinct().withColumn("bucket", bucket_of("key"))


def _say_indexed(spark: SparkSession, store: str, batches: list[int]) -> None:
    marks = [(None, _NO_KEY, b) for b in batches]
    frame = spark.createDataFrame(marks, f"key string, bucket int, {BATCH} bigint")
    frame.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(BATCH, "bucket").parquet(index_of(store).path)


def index_batch(rows: DataFrame, store: str, table: str, batch_id: int) -> None:
    """The keys of a batch, in place of what an earlier try has left.

    Comes before the batch's rows: what is stored is always indexed.
    """
    keys = _index_rows(rows, BATCH_KEYS[table]).repartition("bucket")
    write_batch(keys, index_of(store), batch_id)
    _say_indexed(rows.sparkSession, store, [batch_id])


def index_older(spark: SparkSession, store: str, table: str, before: int) -> list[int]:
    """Index the stored batches that are not, as in a store of before the index; their numbers."""
    rows, index = rows_of(store, table), index_of(store)
    spans = ranges(spark, index)
    indexed = read_batches(spark, index)
    if indexed is not None:
        marks = indexed.filter(F.col("bucket") == _NO_KEY).select(BATCH)
        have = {r[BATCH] for r in marks.collect()}  # one row a batch
    else:
        have = set()
    missing = sorted(
        b for b in live_batches(spark, rows) - have
        if b < before and not any(first <= b <= last for first, last in spans))
    if missing:
        stored = read_batches(spark, rows, before).filter(F.col(BATCH).isin(missing))
        _index_rows(stored, BATCH_KEYS[table]).repartition("bucket").write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            BATCH, "bucket").parquet(index.path)
        _say_indexed(spark, store, missing)
    return missing


def stored_keys(
    spark: SparkSession, store: str, keys: DataFrame, key: str, before: int
) -> DataFrame | None:
    """The index, cut to the buckets that the keys fall into and to older batches."""
    index = read_batches(spark, index_of(store), before)
    if index is None:
        return None
    found = keys.select(bucket_of(key).alias("bucket")).distinct().collect()  # BUCKETS at most
    touched = [r["bucket"] for r in found]
    return index.filter(F.col("bucket").isin(touched)).select(F.col("key").alias(key))
