"""Stored tables in the session catalog, and JDBC options for an external database.

Tables that take uploads are partitioned by upload. An upload owns its partition and
overwrites it, and a row of the upload log says whether it is pending or committed; the
rows of a pending upload are not read. So an upload that failed half-way has left nothing
to be seen, and one that is repeated replaces itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closebooks.operators.audit import ordered
from closebooks.operators.skew import numbered_copies, numbered_few_copies
from closebooks.schemas import READ_BACK_ORDER, TABLE_SCHEMAS
from closebooks.sources.shared import dropped_shuffles

UPLOAD = "upload_id"
UPLOAD_LOG = "upload_log"
PENDING, COMMITTED = "pending", "committed"
# A value is stored as what it adds to the one before; keys made of digests shrink by half.
STORED_FILES = "compression 'zstd', `parquet.writer.version` 'v2'"


def create_tables(
    spark: SparkSession, database: str = "default", partition_by: dict[str, str] | None = None
) -> list[str]:
    """Create the tables that do not exist yet; returns their qualified names."""
    made = []
    for name, schema in TABLE_SCHEMAS.items():
        parts = [UPLOAD] if name in READ_BACK_ORDER else []
        parts += [p for p in [(partition_by or {}).get(name)] if p]
        types = {f.name: f.dataType.simpleString() for f in schema.fields}
        _create(spark, database, name, types, parts)
        made.append(f"{database}.{name}")
    _create(spark, database, UPLOAD_LOG, {
        "status": "string", "row_count": "bigint", "digest": "string"}, ["table_name", UPLOAD])
    return made


def _create(
    spark: SparkSession, database: str, name: str, types: dict[str, str], parts: list[str]
) -> None:
    columns = ", ".join(f"`{c}` {t}" for c, t in (types | {
        p: "string" for p in parts if p not in types}).items())
    by = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in parts)})" if parts else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet "
              f"OPTIONS ({STORED_FILES}){by}")


def _log_of(spark: SparkSession, name: str) -> DataFrame:
    """Status of the uploads of a table: one row per upload."""
    database, _, table = name.rpartition(".")
    log = spark.table(f"{database}.{UPLOAD_LOG}" if database else UPLOAD_LOG)
    return log.filter(F.col("table_name") == table.strip("`"))


def takes_uploads(spark: SparkSession, name: str) -> bool:
    return UPLOAD in spark.table(name).columns


def table_data(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by name, without pending uploads.

    The name is looked up, never spliced into SQL.
    """
    if not spark.catalog.tableExists(name):
        raise LookupError(f"no such table: {name}")
    rows = spark.table(name)
    if name.rpartition(".")[2] == UPLOAD_LOG or UPLOAD not in rows.columns:
        return rows
    pending = _log_of(spark, name).filter(F.col("status") == PENDING).select(UPLOAD)
    return rows.join(pending, UPLOAD, "left_anti").drop(UPLOAD)


def record_count(spark: SparkSession, name: str) -> int:
    return table_data(spark, name).count()


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a stored table, in its order and types; absent ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None))
            .cast(f.dataType).alias(f.name)
            for f in TABLE_SCHEMAS[table].fields
        ]
    )


def with_row_ids(
    df: DataFrame, columns: list[str], source: Column, look_first: bool = False
) -> DataFrame:
    """The columns, with `id`: the row's own, or a key made of its source and its cells.

    Equal rows of a source are told apart by their copy number, so ids are distinct, never
    null, and the same when an upload is repeated. With `look_first`, for rows that are kept
    and can be read twice, a job looks which rows repeat, and only those are shuffled.
    """
    own = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
    cells = [c for c in columns if c != "id"]
    rows = (numbered_few_copies if look_first else numbered_copies)(
        df.select(*cells, own.alias("id"), source.alias("_source")),
        [*cells, "id", "_source"], "_copy")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cells]
    digest = F.md5(F.concat_ws("\x1f", "_source", *text).cast("binary"))
    made = F.concat_ws("-", digest, F.col("_copy").cast("string"))
    return rows.select(F.coalesce("id", made).alias("id"), *cells)


def append(df: DataFrame, table: str, database: str = "default") -> None:
    """Add rows to an existing table, partitioned or not.

    Rows of a partitioned table are first gathered by partition value, so that each
    partition gets files of a fair size; adaptive execution splits the large ones.
    """
    name = f"{database}.{table}"
    stored = df.sparkSession.table(name)
    parts = [c.name for c in df.sparkSession.catalog.listColumns(name) if c.isPartition]
    rows = conform(df, table)
    if UPLOAD in stored.columns:  # rows of no upload
        rows = rows.withColumn(UPLOAD, F.lit(None).cast("string"))
    rows = rows.select(*stored.columns)
    if parts:
        rows = rows.hint("rebalance", *parts)
    with dropped_shuffles(df.sparkSession):
        rows.write.insertInto(name)


def upload_digest(df: DataFrame) -> list[Column]:
    """Aggregates that say whether two uploads hold the same rows, in whatever order."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns])
    return [F.count(F.lit(1)).alias("row_count"), F.bit_xor(row).alias("crossed"),
            F.sum(row.cast("decimal(38,0)")).alias("added")]


def _note(
    spark: SparkSession, table: str, database: str, upload: str, status: str, rows: int,
    digest: str,
) -> None:
    row = spark.createDataFrame(
        [(status, rows, digest)], "status string, row_count bigint, digest string").coalesce(1)
    _overwrite(row, f"{database}.{UPLOAD_LOG}", {"table_name": table, UPLOAD: upload}, [])


def _overwrite(
    rows: DataFrame, name: str, fixed: dict[str, str], by: list[str]
) -> None:
    """Replace the rows of a partition; the values of `fixed` are plain words."""
    spark = rows.sparkSession
    into = ", ".join([*(f"`{c}` = '{v}'" for c, v in fixed.items()), *(f"`{c}`" for c in by)])
    with dropped_shuffles(spark):
        spark.sql(
            f"INSERT OVERWRITE TABLE {name} PARTITION ({into}) SELECT * FROM {{rows}}", rows=rows)
    spark.catalog.refreshTable(name)


def is_committed(spark: SparkSession, name: str, upload: str, digest: str) -> bool:
    """Whether the rows of that digest are what is stored under the upload."""
    before = _log_of(spark, name).filter(F.col(UPLOAD) == upload).head()
    return before is not None and (before["status"], before["digest"]) == (COMMITTED, digest)


def store_upload(
    df: DataFrame, table: str, database: str, upload: str, rows: int, digest: str
) -> bool:
    """Make an upload's rows the content of its partition; False if they are already.

    Pending is noted before the first row is written and committed after the last, so a
    call that is cut short, or repeated, leaves no row that is read, or one copy.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]{1,100}", upload):
        raise ValueError(f"no id of an upload: {upload!r}")
    spark, name = df.sparkSession, f"{database}.{table}"
    if is_committed(spark, name, upload, digest):
        return False
    _note(spark, table, database, upload, PENDING, rows, digest)
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition and c.name != UPLOAD]
    kept = conform(df, table)
    plain = [c for c in kept.columns if c not in parts]
    _overwrite(kept.select(*plain, *parts), name, {UPLOAD: upload}, parts)
    _note(spark, table, database, upload, COMMITTED, rows, digest)
    return True


def other_rows(spark: SparkSession, name: str, upload: str) -> DataFrame:
    """`table_data` without the rows of one upload, whose partition is not read."""
    rows = spark.table(name).filter(~F.col(UPLOAD).eqNullSafe(upload))
    pending = _log_of(spark, name).filter(F.col("status") == PENDING).select(UPLOAD)
    return rows.join(pending, UPLOAD, "left_anti").drop(UPLOAD)


def upload_rows(spark: SparkSession, name: str, upload: str) -> DataFrame:
    """The stored rows of one upload: its partition alone is read."""
    return table_data(spark, name) if not takes_uploads(spark, name) else (
        spark.table(name).filter(F.col(UPLOAD) == upload).drop(UPLOAD))


def stored_ordered(df: DataFrame, table: str) -> DataFrame:
    """A whole stored table in its read-back order."""
    return ordered(df, READ_BACK_ORDER[table])


def jdbc_options(
    url: str, table: str, user: str, password: str,
    driver: str = "org.postgresql.Driver", fetch_size: int = 10_000,
    partition_column: str | None = None, lower: str | None = None, upper: str | None = None,
    partitions: int = 1,
) -> dict[str, str]:
    """Options for spark.read / df.write in "jdbc" format.

    With a partition column and its bounds, the table is read by that many connections.
    """
    options = {
        "url": url, "dbtable": table, "user": user, "password": password,
        "driver": driver, "fetchsize": str(fetch_size), "batchsize": str(fetch_size),
    }
    if partition_column:
        if lower is None or upper is None:
            raise ValueError("a partition column needs lower and upper bounds")
        options |= {
            "partitionColumn": partition_column, "lowerBound": lower,
            "upperBound": upper, "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def append_jdbc(df: DataFrame, table: str, options: dict[str, str]) -> None:
    conform(df, table).write.format("jdbc").options(**options).mode("append").save()
