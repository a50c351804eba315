"""A folder of arriving CSV files as a stream of uploads.

The stream carries file paths; each micro-batch reads its files as one Spark job, so
columns are matched by header, and one bad file cannot stop the stream. An upload is
taken whole or refused whole:

* a column is missing, or a cell cannot be read as its type;
* one of its keys is stored already, or belongs to an earlier accepted file.

Every micro-batch owns one partition of the store, of its key index and of the outcome
log and overwrites it. A repeated batch therefore replaces its own earlier output, and
sees only what older batches stored: rows are kept exactly once. Stored keys are looked
up in the index, older batches are merged into larger files: see `store`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from closebooks.operators.journals import journal_existing_keys
from closebooks.schemas import BATCH_KEYS, TABLE_SCHEMAS
from closebooks.sources.csv_files import (
    header_groups, literal_path, missing_columns, paths_of, snake_header, text_rows, typed,
)
from closebooks.sources.tables import with_row_ids
from closebooks.streaming import store as st

# --- Fixed values: layout of the file source, and reasons in the outcome log --
_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
REASON_COLUMNS = "missing columns"
REASON_VALUES = "unreadable values"
REASON_STORED = "keys already stored"
REASON_EARLIER = "keys in an earlier file"

_OUTCOME = "file string, status string, reason string, row_count bigint"


def stored_rows(
    spark: SparkSession, store: str, table: str, before: int | None = None
) -> DataFrame | None:
    """What the stream has stored, or None; optionally of older batches only."""
    return st.read_batches(spark, st.rows_of(store, table), before)


@dataclass(frozen=True)
class _File:
    """An upload: its path for reading, and the name Spark gives its rows' source."""

    path: str
    source: str


def _listed(spark: SparkSession, paths: list[str]) -> list[_File]:
    """The files, oldest first. Names only: the content column is never read."""
    found = (
        spark.read.format("binaryFile").load([literal_path(p) for p in sorted(set(paths))])
        .select("path", "modificationTime", F.col("_metadata.file_path").alias("source"))
        .distinct().orderBy("modificationTime", "path")
    )
    return [_File(r["path"], r["source"]) for r in found.collect()]


def _read(
    spark: SparkSession, files: list[_File], table: str, multi_line: bool
) -> tuple[DataFrame | None, set[int]]:
    """Typed rows of the well-formed files, numbered by file; files that lack columns."""
    schema = TABLE_SCHEMAS[table]
    needed = [c for c in schema.names if c != "id"]
    number = {f.source: i for i, f in enumerate(files)}
    frames, lacking = [], set(range(len(files)))
    for group in header_groups(spark, [literal_path(f.path) for f in files]).values():
        text = text_rows(spark, paths_of(group), snake_header, multi_line)
        if not missing_columns(text, needed):
            lacking -= {number[source] for source in group}
            frames.append(typed(text, schema, rejects="_unreadable").select(
                *schema.names, "_source_file", "_unreadable"))
    if not frames:
        return None, lacking
    names = spark.createDataFrame(
        [(f.source, i) for i, f in enumerate(files)], "_source_file string, _file int"
    )
    rows = reduce(DataFrame.unionByName, frames)
    # The broadcast side has as many rows as the micro-batch has files.
    return rows.join(F.broadcast(names), "_source_file", "left"), lacking


def _shared_pairs(keys: DataFrame, key: str) -> set[tuple[int, int]]:
    """(earlier, later) file numbers with a key in common.

    Keys are cut to the different sets of files they lie in before any pair is formed.
    """
    sets = keys.groupBy(key).agg(F.sort_array(F.collect_set("_file")).alias("f")).filter(
        F.size("f") > 1).select("f").distinct()
    files = (
        sets.select(F.posexplode("f").alias("at", "first"), "f")
        .select("first", F.explode(F.slice("f", F.col("at") + 2, F.size("f"))).alias("second"))
        .distinct()
    )
    return {(r["first"], r["second"]) for r in files.collect()}


def _refused_by_key(
    keys: DataFrame, key: str, stored: list[DataFrame], files: int, out: set[int]
) -> dict[int, str]:
    """Reason per refused file: a file loses to the store and to accepted earlier files."""
    refused: dict[int, str] = {}
    for known in stored:
        there = journal_existing_keys(keys, known, key)
        hits = keys.join(there, key, "left_semi").select("_file").distinct().collect()
        refused |= {r["_file"]: REASON_STORED for r in hits if r["_file"] not in out}
    pairs = _shared_pairs(keys, key)
    accepted: set[int] = set()
    for f in range(files):
        if f in out or f in refused:
            continue
        if any((a, f) in pairs for a in accepted):
            refused[f] = REASON_EARLIER
        else:
            accepted.add(f)
    return refused


def _judge(
    spark: SparkSession, rows: DataFrame, files: int, table: str, store: str, batch_id: int,
    known: DataFrame | None, reasons: dict[int, str],
) -> dict[int, int]:
    """Add the reasons found in the rows; rows per file."""
    counts: dict[int, int] = {}
    for r in rows.groupBy("_file").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.size("_unreadable") > 0).alias("bad")
    ).collect():
        if r["_file"] is None:
            raise RuntimeError("rows from a file that is not in the batch")
        counts[r["_file"]] = r["n"]
        if r["bad"]:
            reasons[r["_file"]] = REASON_VALUES
    key = BATCH_KEYS.get(table)
    if key:
        keys = rows.select("_file", key).filter(F.col(key).isNotNull()).distinct()
        st.index_older(spark, store, table, batch_id)
        older = st.stored_keys(spark, store, keys, key, batch_id)
        stored = [d for d in (older, known) if d is not None]
        reasons |= _refused_by_key(keys, key, stored, files, set(reasons))
    return counts


def ingest_files(
    spark: SparkSession, paths: list[str], table: str, store: str, log: str, batch_id: int,
    known: DataFrame | None = None, multi_line: bool = False,
) -> None:
    """Take one micro-batch of files, oldest first. Safe to repeat.

    With `multi_line`, line breaks inside quotes are read, each file by one task.
    """
    files = _listed(spark, paths)
    rows, lacking = _read(spark, files, table, multi_line)
    reasons: dict[int, str] = dict.fromkeys(lacking, REASON_COLUMNS)
    counts: dict[int, int] = {}
    if rows is not None:
        # The checks and the write share one parse of the text. A part lost with its
        # executor is parsed again, so a landed file must not be rewritten meanwhile.
        rows = rows.persist(StorageLevel.DISK_ONLY)
        try:
            counts = _judge(spark, rows, len(files), table, store, batch_id, known, reasons)
            taken = [i for i in range(len(files)) if i not in reasons]
            accepted = rows.filter(F.col("_file").isin(taken))
            if table in BATCH_KEYS:
                st.index_batch(accepted, store, table, batch_id)
            st.write_batch(with_row_ids(
                accepted, TABLE_SCHEMAS[table].names,
                F.element_at(F.split("_source_file", "/"), -1), look_first=True),
                st.rows_of(store, table), batch_id)
        finally:
            rows.unpersist()
    outcome = [
        (f.source, "refused" if i in reasons else "accepted", reasons.get(i), counts.get(i, 0))
        for i, f in enumerate(files)
    ]
    (
        spark.createDataFrame(outcome, _OUTCOME).coalesce(1)
        .write.mode("overwrite").parquet(f"{log}/ingest_batch={batch_id}")
    )


def merge_older(
    spark: SparkSession, store: str, table: str, before: int, span: int = st.SPAN
) -> None:
    """Merge the rows, and the keys, of whole ranges of older batches. Safe to repeat."""
    if table in BATCH_KEYS:
        st.index_older(spark, store, table, before)
        st.merge_batches(spark, st.index_of(store), before, span)
    st.merge_batches(spark, st.rows_of(store, table), before, span)


def ingest_stream(
    spark: SparkSession, folder: str, table: str, store: str, log: str, checkpoint: str,
    known: DataFrame | None = None, max_files: int = 100, multi_line: bool = False,
    merge_span: int = st.SPAN,
) -> StreamingQuery:
    """Take all files now in the folder, oldest first, then stop; start again for more.

    `known` is a table whose keys count as stored besides those of the store. Whenever
    `merge_span` batches are done, they are merged into larger files.
    """
    paths = (
        spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
        .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", max_files)
        .load(folder).select("path")
    )

    def take(batch: DataFrame, batch_id: int) -> None:
        # At most max_files names; the rows are read by the executors.
        found = [r["path"] for r in batch.collect()]
        session = batch.sparkSession
        if batch_id and batch_id % merge_span == 0:
            merge_older(session, store, table, batch_id, merge_span)
        if found:
            ingest_files(session, found, table, store, log, batch_id, known, multi_line)

    return (
        paths.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
