"""Composite jobs: named report sections, one lazy DataFrame each."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from closebooks import fixed_values as V
from closebooks.operators import audit, consolidation, gst, interco, journals, provisions, tds
from closebooks.operators import reporting
from closebooks.operators.feedback import feedback_sections
from closebooks.operators.rows import row_documents
from closebooks.schemas import BATCH_KEYS, READ_BACK_ORDER, TABLE_SCHEMAS
from closebooks.sources import tables
from closebooks.sources.csv_files import BAD_ROW, read_table_csv
from closebooks.sources.shared import dropped_shuffles

Sections = dict[str, DataFrame]

LARGE_BATCH = 1_000_000  # rows of an upload whose keys are not sent to all tasks

# Sorted keys and texts made of them: a value is stored as what it adds to the one before.
LISTING_FILES = {"compression": "zstd", "parquet.writer.version": "v2"}


# -- reports over one uploaded table ----------------------------------------------

# The summaries of a report are sums over `cells`, the table summed once by the report's keys.
# The cells are cached when the first section is read; `cells.unpersist()` gives them back.
# `excluded_rows` says what each summary leaves out, because its key is missing.

def consolidation_report(c: DataFrame) -> Sections:
    cells = consolidation.position_cells(c).persist()
    return {
        "cells": cells, **consolidation.summaries_of_cells(cells),
        "intercompany_transactions": consolidation.interco_transactions(c),
        "elimination_entries": consolidation.elimination_entries(c),
    }


def gst_report(g: DataFrame) -> Sections:
    """`summaries` has all four levels in one frame; the other summaries are its parts."""
    cells = gst.gst_cells(g).persist()
    return {
        "cells": cells, **gst.summaries_of_cells(cells),
        "validation_issues": gst.gst_issues(g),
    }


def tds_report(t: DataFrame) -> Sections:
    cells = tds.tds_cells(t).persist()
    return {
        "cells": cells, **tds.summaries_of_cells(cells),
        "threshold_analysis": tds.tds_thresholds(t),
        "validation_issues": tds.tds_issues(t),
    }


def provision_report(p: DataFrame, as_of: date) -> Sections:
    cells = provisions.provision_cells(p).persist()
    return {
        "cells": cells, **provisions.summaries_of_cells(cells),
        "upcoming_provisions": provisions.provision_upcoming(p, as_of),
        "validation_issues": provisions.provision_issues(p),
    }


# -- uploads ------------------------------------------------------------------------

@dataclass(frozen=True)
class Outcome:
    """Result of an upload: status, error text, and the frames that came of it."""

    status: str
    error: str | None = None
    sections: Sections = field(default_factory=dict)
    upload_id: str | None = None


# --- Fixed values: error texts of an upload ------------------------------------
GATE_ERROR = "Validation issues found."
STORED_ERROR = "Duplicate {key}(s) found in DB"

_REPORTS: dict[str, Callable[[DataFrame, date | None], Sections]] = {
    "consolidation": lambda df, _: consolidation_report(df),
    "gst_validation": lambda df, _: gst_report(df),
    "tds_validation": lambda df, _: tds_report(df),
    "provision_planning": lambda df, as_of: provision_report(df, as_of),
}

_GATE_OF_TABLE = {
    "journal_entries": "journal", "interco_reconciliation": "interco",
    "consolidation": "consolidation", "gst_validation": "gst", "tds_validation": "tds",
    "provision_planning": "provision",
}


def passes_review(review: str, domain: str) -> bool:
    return any(p in review.lower() for p in V.GATE_PHRASES[domain])


def process_upload(
    spark: SparkSession, path: str, table: str, review: str | None = None,
    as_of: date | None = None, database: str = "default", multi_line: bool = False,
    upload_id: str | None = None,
) -> Outcome:
    """Read a CSV, check it, append it to its table, and hand back what is stored.

    `review` is a reviewer's text on the upload; without the phrases of its domain the
    upload is refused. Journals and intercompany uploads are refused as a whole when a
    key is stored already; `existing_keys` names those. An upload with a cell or row that
    cannot be read is refused as a whole. With `multi_line`, line breaks inside quotes are
    read.

    The upload is one unit of the table, known by `upload_id`: if none is given, by its file
    name and its rows. A call that fails leaves none of its rows to be read and may be
    repeated; rows that are stored under the id already are not stored twice. The check and
    the append are two steps: uploads of the same keys must not run at the same time.
    """
    if review is not None and not passes_review(review, _GATE_OF_TABLE[table]):
        return Outcome("error", GATE_ERROR)
    read = read_table_csv(spark, path, table, rejects="_unreadable", multi_line=multi_line)
    # The checks and the write share one parse of the text.
    read = read.persist(StorageLevel.DISK_ONLY)
    try:
        return _checked_upload(spark, read, path, table, review, as_of, database, upload_id)
    finally:
        read.unpersist()


def _checked_upload(
    spark: SparkSession, read: DataFrame, path: str, table: str, review: str | None,
    as_of: date | None, database: str, upload_id: str | None,
) -> Outcome:
    names = TABLE_SCHEMAS[table].names
    fields = sorted([*names, BAD_ROW])
    found = read.agg(
        *[F.bool_or(F.array_contains("_unreadable", f)).alias(f"bad{i}")
          for i, f in enumerate(fields)],
        *tables.upload_digest(read.drop("_unreadable"))).head()
    unreadable = [f for i, f in enumerate(fields) if found[f"bad{i}"]]
    if unreadable:
        return Outcome("error", f"Unreadable values in {path}: {', '.join(unreadable)}")
    source = os.path.basename(path.rstrip("/"))
    rows = found["row_count"]
    digest = hashlib.md5(
        f"{source}|{rows}|{found['crossed']}|{found['added']}".encode()).hexdigest()
    upload_id = upload_id or digest
    name = f"{database}.{table}"
    stored = tables.table_data(spark, name)
    key = BATCH_KEYS.get(table)
    if key and not stored.isEmpty():
        # Found once, for the answer and for the section; the keys outlive the parse.
        existing = journals.journal_existing_keys(
            read, stored, key, large=rows > LARGE_BATCH).persist(StorageLevel.DISK_ONLY)
        if not existing.isEmpty():
            error = STORED_ERROR.format(key=key)
            return Outcome("error", error, {"existing_keys": existing.orderBy(key)}, upload_id)
        existing.unpersist()
    whole = None
    if tables.takes_uploads(spark, name):
        if not tables.is_committed(spark, name, upload_id, digest):
            batch = tables.with_row_ids(
                read.drop("_unreadable"), names, F.lit(source), look_first=True)
            tables.store_upload(batch, table, database, upload_id, rows, digest)
        batch = whole = tables.upload_rows(spark, name, upload_id)
    else:  # a table of before uploads had ids
        batch = tables.with_row_ids(
            read.drop("_unreadable"), names, F.lit(source), look_first=True)
        tables.append(batch, table, database)
        spark.catalog.refreshTable(name)
    stored = tables.table_data(spark, name)
    if not key:
        report = _REPORTS[table](batch.withColumn("rid", _row_key(batch)), as_of)
        return Outcome(
            "success", None, {"data": tables.stored_ordered(stored, table), **report}, upload_id)
    order = tuple(c for c, _ in READ_BACK_ORDER[table].columns)
    if whole is not None:
        stored = tables.other_rows(spark, name, upload_id)
        # A partition that is empty is not worth a shuffle of the batch's keys.
        stored = None if stored.isEmpty() else stored
    sections = {"data": journals.read_back(batch, stored, key, order, whole)}
    if table == "interco_reconciliation" and review is not None:
        text = spark.createDataFrame([(1, review)], "id int, text string")
        sections["reconciliation_report"] = feedback_sections(text).drop("id")
    return Outcome("success", None, sections, upload_id)


def _row_key(df: DataFrame):
    """The row's own id, or a digest of its cells where it has none."""
    cells = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
                                  for c in df.columns])
    return F.coalesce(F.col("id"), F.md5(cells.cast("binary")))


# -- checks over the working files ------------------------------------------------------

def validate_journals(j: DataFrame) -> Sections:
    clean = journals.journal_dropna(j)
    return {
        "status": journals.journal_status(j),
        "validated_data": clean,
        "missing_fields": journals.journal_missing_fields(j),
        "unbalanced_journals": journals.journal_balance_by_id(clean),
        "duplicate_ids": journals.journal_duplicate_ids(clean),
        "documents": row_documents(clean, "journal_id"),
    }


def reconcile_interco(ic: DataFrame) -> Sections:
    return {
        "mismatches": interco.interco_mismatches(ic),
        "mismatch_journals": interco.interco_mismatch_journals(ic),
        "missing_counterparties": interco.interco_missing_counterparty(ic),
        "missing_counterparts": interco.interco_missing_counterpart(ic),
        "amount_mismatches": interco.interco_amount_mismatch(ic),
    }


def validate_gst(ret: DataFrame, register: DataFrame | None = None) -> Sections:
    out = {
        "mismatches": gst.gst_return_mismatches(ret),
        "missing_invoices": gst.gst_missing_invoices(ret),
        "excess_itc": gst.gst_excess_itc(ret),
    }
    if register is not None:
        out["register_vs_return"] = gst.gst_register_vs_return(register, ret)
    return out


def validate_tds(
    t: DataFrame, traces: DataFrame | None = None, base: str = "tds_amount"
) -> Sections:
    out = {
        "deduction_mismatches": tds.tds_group_check(t, base=base),
        "missing_challans": tds.tds_missing_challan(t),
        "missing_identifiers": tds.tds_missing_identifiers(t),
    }
    if traces is not None:
        out["traces_match"] = tds.traces_match(t, traces)
    return out


def analyze_provisions(p: DataFrame, history: DataFrame, as_of: date) -> Sections:
    return {
        "missing_provisions": provisions.provision_overdue(p, as_of),
        "amount_spikes": provisions.provision_spikes(history),
        "repeating_expenses": provisions.repeating_expenses(history),
    }


def consolidate(tb: DataFrame, ic: DataFrame, order: str | None = None) -> Sections:
    """All but the single eliminations follows from `cells`, cached when first read."""
    cells = consolidation.elimination_cells(tb, ic, order).persist()
    ctb = consolidation.tb_of_cells(cells)
    return {
        "cells": cells,
        "consolidated_trial_balance": ctb,
        "eliminations": consolidation.eliminations_of_cells(cells, ic),
        "elimination_totals": consolidation.totals_of_cells(cells),
        "balance_sheet": consolidation.balance_sheet(ctb),
        "profit_loss": consolidation.profit_loss(ctb),
        "cash_flow": consolidation.cash_flow(ctb),
        "balance": consolidation.bs_balance(ctb),
        "unclassified_accounts": consolidation.unclassified_accounts(ctb),
        "unlinked_entities": consolidation.unlinked_of_cells(cells),
    }


def close_report(
    j: DataFrame, tb: DataFrame, ic: DataFrame, ret: DataFrame, t: DataFrame,
    p: DataFrame, history: DataFrame, as_of: date,
) -> dict[str, Sections]:
    """Everything a close needs, by area; each section runs when it is asked for."""
    statements = consolidate(tb, ic)
    return {
        "journals": validate_journals(j),
        "consolidation": statements,
        "intercompany": reconcile_interco(ic),
        "gst": validate_gst(ret),
        "tds": validate_tds(t),
        "provisions": analyze_provisions(p, history, as_of),
        "summary": {
            "statement_totals": reporting.statement_totals(
                statements["consolidated_trial_balance"]
            ),
            "warnings": reporting.close_warnings(j, tb, ic, ret, t, p, history, as_of),
        },
    }


def audit_trail(
    j: DataFrame, evidence: DataFrame, entry_id: str | None = None, user: str | None = None,
    action: str | None = None,
) -> Sections:
    """Log, timeline and flags over the journals without nulls."""
    clean = journals.journal_dropna(j)
    logs = audit.audit_log_entries(clean, entry_id, user, action)
    return {
        "logs": logs,
        "timeline": audit.audit_timeline(logs),
        "flags": audit.audit_flags(logs, evidence),
        "missing_records": audit.audit_missing_record(clean, evidence),
    }


def financial_data_summary(sources: Mapping[str, DataFrame]) -> Sections:
    return {
        "counts": audit.source_counts(sources),
        "total": audit.total_entries(sources),
        "missing_sources": audit.missing_sources(sources),
    }


def audit_data_summary(sources: Mapping[str, DataFrame]) -> Sections:
    """Counts per source and each source in audit order, by table name."""
    listings = {name: audit.audit_sorted(df, name) for name, df in sources.items()}
    return {"counts": audit.source_counts(sources), **listings}


def store_audit_data(sources: Mapping[str, DataFrame], folder: str) -> Sections:
    """The listings of `audit_data_summary`, written below a folder and read back.

    The counts are observed on the rows as they are written, so each source is read once.
    They are taken after the sort, where a row that is computed again is not counted twice.
    """
    if not sources:
        raise ValueError("no tables given")
    counts, stored = [], {}
    for name, df in sources.items():
        seen = Observation()
        rows = audit.audit_sorted(df, name).observe(seen, F.count(F.lit(1)).alias("n"))
        with dropped_shuffles(df.sparkSession):
            rows.write.mode("overwrite").options(**LISTING_FILES).parquet(f"{folder}/{name}")
        counts.append((name, seen.get["n"], seen.get["n"] > 0))
        stored[name] = audit.audit_sorted(
            df.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}"), name)
    frame = next(iter(sources.values())).sparkSession.createDataFrame(
        counts, "source string, n bigint, has_data boolean")
    return {"counts": frame, **stored}
