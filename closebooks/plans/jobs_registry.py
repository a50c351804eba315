"""Files, stored tables, uploads and composite jobs as queries over the sample tables.

The sample rows are written as files (in layouts that differ) and go through the whole path
of an upload; a composite job gives its sections with their number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closebooks.plans import close
from closebooks.sources import csv_files, tables
from closebooks.sources.sample_views import SampleViews
from closebooks.sources.shared import dropped_shuffles, shared_folder
from closebooks.streaming.landing import ingest_files, stored_rows

PROVISION_DATE = date(2001, 6, 30)
FILES = 4  # that an upload is made of in the landing folder, at least
FILE_ROWS = 500_000  # of one of them, about
REVIEW = "Validated successfully.\nAction Items\n1. Chase the open items\n2. Close\n"


def _table_rows(v: SampleViews, table: str) -> DataFrame:
    frames: dict[str, Callable[[], DataFrame]] = {
        "journal_entries": lambda: v.journal_entries,
        "interco_reconciliation": lambda: v.interco_reconciliation,
        "gst_validation": lambda: v.gst_validation.withColumnRenamed("rid", "id"),
        "tds_validation": lambda: v.tds_validation.withColumnRenamed("rid", "id"),
        "provision_planning": lambda: v.provision_planning.withColumnRenamed("rid", "id"),
        "consolidation": lambda: v.consolidation.withColumnRenamed("rid", "id"),
    }
    return tables.conform(frames[table](), table)


def _spark(v: SampleViews) -> SparkSession:
    return v.spark


def _in_two_layouts(rows: DataFrame, split: str, folder: str) -> str:
    """CSV files in two orders of columns, and files of another kind, in one folder."""
    odd = F.pmod(F.xxhash64(split), F.lit(2)) == 1
    csv_files.write_csv(rows.filter(~odd), folder, "append")
    csv_files.write_csv(
        rows.filter(odd).select(*reversed(rows.columns)), folder, "append")
    csv_files.write_json(rows.limit(1), folder, "append")
    return folder


def csv_table_read(v: SampleViews) -> DataFrame:
    spark = _spark(v)
    folder = _in_two_layouts(
        _table_rows(v, "gst_validation"), "invoice_number", shared_folder(spark, "csv"))
    return csv_files.read_table_csv(spark, folder, "gst_validation")


def csv_named_read(v: SampleViews) -> DataFrame:
    spark = _spark(v)
    rows = v.trial_balance.toDF("Entity", "Account", "Debit", "Credit")
    folder = _in_two_layouts(rows, "Account", shared_folder(spark, "csv"))
    return csv_files.to_check_columns(
        csv_files.read_named_csv(spark, folder, "trial_balance"), "trial_balance")


def csv_journals_read(v: SampleViews) -> DataFrame:
    spark = _spark(v)
    rows = v.journals.select(
        F.col("journal_id").alias("journal_id"), F.col("entry_date").alias("date"), "account",
        F.col("type").alias("Entry Type"), "amount", "entity")
    folder = _in_two_layouts(rows, "journal_id", shared_folder(spark, "csv"))
    return csv_files.to_check_columns(csv_files.read_journals(spark, folder), "journals")


def _database(spark: SparkSession) -> str:
    path = shared_folder(spark, "books")
    name = path.rpartition("/")[2].replace("-", "_")
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{path}'")
    tables.create_tables(spark, name)
    return name


def table_append_read(v: SampleViews) -> DataFrame:
    """Rows appended in two steps to a new table, and read by its name."""
    spark = _spark(v)
    database = _database(spark)
    rows = _table_rows(v, "tds_validation")
    paid = F.col("status") == "PAID"
    tables.append(rows.filter(paid), "tds_validation", database)
    tables.append(rows.filter(~paid), "tds_validation", database)
    return tables.stored_ordered(
        tables.table_data(spark, f"{database}.tds_validation"), "tds_validation")


def _files(spark: SparkSession, folder: str) -> list[str]:
    return csv_files.paths_of(
        spark.read.option("pathGlobFilter", "*.csv").text(folder).inputFiles())


def _landing(v: SampleViews) -> tuple[SparkSession, str, str]:
    """Store and log after two batches: files of disjoint keys, then the same files again."""
    spark = _spark(v)
    home = shared_folder(spark, "landing")
    rows = _table_rows(v, "journal_entries")
    files = max(FILES, -(-v.raw("lineitem").count() // FILE_ROWS))
    csv_files.write_csv(rows.repartition(files, "journal_id"), f"{home}/in")
    paths = _files(spark, f"{home}/in")
    for batch in (0, 1):
        ingest_files(
            spark, paths, "journal_entries", f"{home}/store", f"{home}/log", batch)
    return spark, f"{home}/store", f"{home}/log"


def landing_rows(v: SampleViews) -> DataFrame:
    spark, store, _ = _landing(v)
    return stored_rows(spark, store, "journal_entries").drop("id")


def landing_outcomes(v: SampleViews) -> DataFrame:
    spark, _, log = _landing(v)
    return spark.read.parquet(log).groupBy("ingest_batch", "status", "reason").agg(
        F.sum("row_count").alias("row_count"))


def section_counts(sections: Mapping[str, DataFrame]) -> DataFrame:
    """section, row_count of every section but the cells that others are made of."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("section"), "row_count")
        for name, df in sections.items() if name != "cells"]
    return reduce(DataFrame.unionByName, counts)


def _upload(v: SampleViews, table: str) -> close.Outcome:
    """The second of two equal uploads: refused if its table has keys, or stored once."""
    spark = _spark(v)
    database = _database(spark)
    folder = shared_folder(spark, "upload")
    csv_files.write_csv(_table_rows(v, table).drop("id"), folder)
    first = close.process_upload(
        spark, folder, table, REVIEW, as_of=PROVISION_DATE, database=database)
    second = close.process_upload(
        spark, folder, table, REVIEW, as_of=PROVISION_DATE, database=database)
    if second.status == "error":
        return close.Outcome("success", None, {**first.sections, **second.sections})
    return second


def _uploaded(table: str) -> Callable[[SampleViews], DataFrame]:
    return lambda v: section_counts(_upload(v, table).sections)


def _audit_sources(v: SampleViews) -> dict[str, DataFrame]:
    names = ("journal_entries", "interco_reconciliation", "gst_validation", "tds_validation",
             "provision_planning", "consolidation")
    return {**{n: _table_rows(v, n) for n in names},
            "audit_log": tables.conform(v.audit_log, "audit_log")}


INTERCO = ["entity", "counterparty", "account", "amount", "journal_id"]  # of the close


def with_stored(v: SampleViews, **columns: list[str]) -> SampleViews:
    """The same views, but columns of the named ones stored as tables.

    They are joined once, however many sections read them.
    """
    out = SampleViews(v.spark, v.folder)
    for name, kept in columns.items():
        path = shared_folder(v.spark, name)
        rows = getattr(out, name).select(*kept)
        with dropped_shuffles(v.spark):
            rows.write.options(**close.LISTING_FILES).parquet(path)
        setattr(out, name, v.spark.read.schema(rows.schema).parquet(path))
    return out


def _stored_audit(v: SampleViews) -> DataFrame:
    # Three of the listings are of postings.
    kept = [c for c in v.postings.columns if c != "p_brand"]
    folder = shared_folder(_spark(v), "audit")
    return close.store_audit_data(
        _audit_sources(with_stored(v, postings=kept)), folder)["counts"]


def _consolidate(v: SampleViews) -> DataFrame:
    v = with_stored(v, interco=INTERCO)
    return section_counts(close.consolidate(v.trial_balance, v.interco))


def _close_report(v: SampleViews) -> DataFrame:
    v = with_stored(v, interco=INTERCO, postings=["*"])
    areas = close.close_report(
        v.journals, v.trial_balance, v.interco, v.gst_return, v.tds_validation,
        v.provision_planning, v.provision_history, PROVISION_DATE)
    return section_counts({
        f"{area}.{name}": df for area, parts in areas.items() for name, df in parts.items()
        if name != "cells"})


JOB_QUERIES: dict[str, Callable[[SampleViews], DataFrame]] = {
    "csv_table_read": csv_table_read,
    "csv_named_read": csv_named_read,
    "csv_journals_read": csv_journals_read,
    "table_append_read": table_append_read,
    "landing_rows": landing_rows,
    "landing_outcomes": landing_outcomes,
    "upload_journals": _uploaded("journal_entries"),
    "upload_journal_rows": lambda v: _upload(v, "journal_entries").sections["data"].drop("id"),
    "upload_interco": _uploaded("interco_reconciliation"),
    "upload_consolidation": _uploaded("consolidation"),
    "upload_gst": _uploaded("gst_validation"),
    "upload_tds": _uploaded("tds_validation"),
    "upload_provisions": _uploaded("provision_planning"),
    "job_validate_journals": lambda v: section_counts(close.validate_journals(v.journals)),
    "job_reconcile_interco": lambda v: section_counts(close.reconcile_interco(v.interco)),
    "job_validate_gst": lambda v: section_counts(
        close.validate_gst(v.gst_return, v.gst_validation)),
    "job_validate_tds": lambda v: section_counts(
        close.validate_tds(v.tds_validation, v.traces_data)),
    "job_analyze_provisions": lambda v: section_counts(close.analyze_provisions(
        v.provision_planning, v.provision_history, PROVISION_DATE)),
    "job_consolidate": _consolidate,
    "job_close_report": _close_report,
    "job_audit_trail": lambda v: section_counts(
        close.audit_trail(v.journals, v.audit_log, user="ENT015")),
    "job_financial_summary": lambda v: section_counts(close.financial_data_summary({
        "interco": v.interco, "provisions": v.provision_planning,
        "nothing": v.journals.filter("journal_id is null")})),
    "job_audit_summary": lambda v: section_counts(close.audit_data_summary(_audit_sources(v))),
    "job_store_audit": _stored_audit,
}
