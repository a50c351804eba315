"""Every operator as a query over the sample views, by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from closebooks import fixed_values as V
from closebooks.functions.exprs import dates_as_text, money_as_double
from closebooks.operators import audit, gst, interco, provisions, reporting, tds
from closebooks.operators import consolidation as con
from closebooks.operators import journals as jn
from closebooks.operators.feedback import feedback_gate, feedback_sections
from closebooks.operators.rows import row_documents, sample_rows, to_records
from closebooks.operators.vectors import vector_top_k_of, vector_top_k_rounds
from closebooks.plans.jobs_registry import JOB_QUERIES
from closebooks.sources import csv_files, tables
from closebooks.sources.sample_views import SampleViews

PROVISION_DATE = date(2001, 6, 30)
LEDGER_DATE = date(2002, 1, 15)  # after the last expense: monthly contracts are due
AUDIT_DATE = date(2024, 1, 31)

View = Callable[[SampleViews], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]


def _ctb(v: SampleViews) -> DataFrame:
    return con.consolidated_tb(v.trial_balance, v.interco)


def _statement_values(v: SampleViews) -> DataFrame:
    """Intercompany movements per entity, quarter and account, as statement input."""
    quarter = reporting.quarter_text("transaction_date").alias("period")
    return v.interco.groupBy("entity", quarter, "account").agg(
        F.sum("amount").alias("net_amount")
    )


def _ledger_of_interco(v: SampleViews) -> DataFrame:
    """Intercompany rows in the consolidation layout: their accounts have classes."""
    amount, zero = F.col("amount"), F.lit(0).cast("decimal(15,2)")
    return v.interco.select(
        F.col("entity").alias("entity_code"), F.col("account").alias("account_name"),
        F.when(amount > 0, amount).otherwise(zero).alias("debit_amount"),
        F.when(amount < 0, (-amount).cast("decimal(15,2)")).otherwise(zero)
        .alias("credit_amount"),
        "transaction_date",
    )


def _logs(v: SampleViews) -> DataFrame:
    return audit.audit_log_entries(jn.journal_dropna(v.journals))


def _sources(v: SampleViews) -> dict[str, DataFrame]:
    return {
        "provisions": v.provision_planning,
        "consolidation": v.consolidation,
        "journal_entries": v.journals,
        "interco_reconciliation": v.interco,
        "gst_validation": v.gst_validation,
        "tds_validation": v.tds_validation,
        "audit_logs": v.audit_log,
        "zero_amounts": v.interco.filter(F.col("amount") == 0),
    }


def _stored_with_key(v: SampleViews, table: str) -> DataFrame:
    """The sample view of a stored table, with the row key as its id."""
    frames = {
        "journal_entries": lambda: v.journal_entries,
        "interco_reconciliation": lambda: v.interco_reconciliation,
        "gst_validation": lambda: v.gst_validation.withColumnRenamed("rid", "id"),
        "tds_validation": lambda: v.tds_validation.withColumnRenamed("rid", "id"),
        "provision_planning": lambda: v.provision_planning.withColumnRenamed("rid", "id"),
        "consolidation": lambda: v.consolidation.withColumnRenamed("rid", "id"),
        "audit_log": lambda: v.audit_log,
    }
    return frames[table]()


def _questions(v: SampleViews, which: Column) -> DataFrame:
    """Question vectors: rows of the table itself, by key."""
    return v.embeddings.filter(which).select(F.col("vec_id").alias("question_id"), "embedding")


def _without(df: DataFrame, **gone: Column) -> DataFrame:
    """The frame with cells emptied where a condition holds: keys missing on purpose."""
    return df.withColumns({c: F.when(~on, F.col(c)) for c, on in gone.items()})


def _close(v: SampleViews, build: Callable[..., DataFrame]) -> DataFrame:
    return build(
        v.journals, v.trial_balance, v.interco, v.gst_return, v.tds_validation,
        v.provision_planning, v.provision_history, PROVISION_DATE,
    )


VIEW_QUERIES: dict[str, View] = {
    # GST
    "gst_vendor_summary": lambda v: gst.gst_vendor_summary(v.gst_validation),
    "gst_itc_summary": lambda v: gst.gst_itc_summary(v.gst_validation),
    "gst_tax_summary": lambda v: gst.gst_tax_summary(v.gst_validation),
    "gst_monthly_summary": lambda v: gst.gst_monthly_summary(v.gst_validation),
    "gst_summary_levels": lambda v: gst.gst_summary_levels(v.gst_validation),
    "gst_tax_mismatches": lambda v: gst.gst_tax_mismatches(v.gst_validation),
    "gst_invalid_gstin": lambda v: gst.gst_invalid_gstin(v.gst_validation),
    "gst_issues": lambda v: gst.gst_issues(v.gst_validation),
    "gst_return_mismatches": lambda v: gst.gst_return_mismatches(v.gst_return),
    "gst_missing_invoices": lambda v: gst.gst_missing_invoices(v.gst_return),
    "gst_excess_itc": lambda v: gst.gst_excess_itc(v.gst_return),
    "gst_return_counts": lambda v: gst.gst_return_counts(v.gst_return),
    "gst_register_vs_return": lambda v: gst.gst_register_vs_return(
        v.gst_validation, v.gst_return),
    # TDS
    "tds_vendor_summary": lambda v: tds.tds_vendor_summary(v.tds_validation),
    "tds_section_summary": lambda v: tds.tds_section_summary(v.tds_validation),
    "tds_status_summary": lambda v: tds.tds_status_summary(v.tds_validation),
    "tds_monthly_summary": lambda v: tds.tds_monthly_summary(v.tds_validation),
    "tds_summary_levels": lambda v: tds.tds_summary_levels(v.tds_validation),
    "tds_thresholds": lambda v: tds.tds_thresholds(v.tds_validation),
    "tds_invalid_pan": lambda v: tds.tds_invalid_pan(v.tds_validation),
    "tds_calc_mismatches": lambda v: tds.tds_calc_mismatches(v.tds_validation),
    "tds_issues": lambda v: tds.tds_issues(v.tds_validation),
    "tds_group_check": lambda v: tds.tds_group_check(v.tds_validation),
    "tds_group_check_payment": lambda v: tds.tds_group_check(
        v.tds_validation, base="payment_amount"),
    "tds_counts": lambda v: tds.tds_counts(v.tds_validation),
    "tds_missing_challan": lambda v: tds.tds_missing_challan(v.tds_validation),
    "tds_missing_identifiers": lambda v: tds.tds_missing_identifiers(v.tds_validation),
    "traces_match": lambda v: tds.traces_match(v.tds_validation, v.traces_data),
    # provisions
    "provision_category_summary": lambda v: provisions.provision_category_summary(
        v.provision_planning),
    "provision_vendor_summary": lambda v: provisions.provision_vendor_summary(
        v.provision_planning),
    "provision_vendor_categories": lambda v: provisions.provision_vendor_categories(
        v.provision_planning),
    "provision_frequency_summary": lambda v: provisions.provision_frequency_summary(
        v.provision_planning),
    "provision_confidence": lambda v: provisions.provision_confidence(v.provision_planning),
    "provision_upcoming": lambda v: provisions.provision_upcoming(
        v.provision_planning, PROVISION_DATE),
    "provision_overdue": lambda v: provisions.provision_overdue(
        v.provision_planning, PROVISION_DATE),
    "provision_issues": lambda v: provisions.provision_issues(v.provision_planning),
    "provision_spikes": lambda v: provisions.provision_spikes(v.provision_history),
    "provision_vs_actual": lambda v: provisions.provision_vs_actual(v.previous_provisions),
    "missing_regular": lambda v: provisions.missing_regular(
        v.vendor_info, v.expense_ledger, LEDGER_DATE),
    "repeating_expenses": lambda v: provisions.repeating_expenses(v.provision_history),
    # consolidation
    "entity_summary": lambda v: con.entity_summary(v.consolidation),
    "account_summary": lambda v: con.account_summary(v.consolidation),
    "interco_transactions": lambda v: con.interco_transactions(v.consolidation),
    "elimination_entries": lambda v: con.elimination_entries(v.consolidation),
    "elimination_mismatches": lambda v: con.elimination_mismatches(v.consolidation),
    "unbalanced_entities": lambda v: con.unbalanced_entities(v.consolidation),
    "tb_eliminations": lambda v: con.tb_eliminations(v.trial_balance, v.interco),
    "elimination_totals": lambda v: con.elimination_totals(v.trial_balance, v.interco),
    "consolidated_tb": _ctb,
    "balance_sheet": lambda v: con.balance_sheet(_ctb(v)),
    "profit_loss": lambda v: con.profit_loss(_ctb(v)),
    "cash_flow": lambda v: con.cash_flow(_ctb(v)),
    "bs_balance": lambda v: con.bs_balance(_ctb(v)),
    "unclassified_accounts": lambda v: con.unclassified_accounts(_ctb(v)),
    "unlinked_entities": lambda v: con.unlinked_entities(v.interco, v.trial_balance),
    "mapped_eliminations": lambda v: con.mapped_eliminations(v.interco, v.ic_mapping),
    # intercompany
    "interco_mismatches": lambda v: interco.interco_mismatches(v.interco),
    "interco_mismatch_journals": lambda v: interco.interco_mismatch_journals(v.interco),
    "interco_counts": lambda v: interco.interco_counts(v.interco),
    "interco_missing_counterparty": lambda v: interco.interco_missing_counterparty(v.interco),
    "interco_missing_counterpart": lambda v: interco.interco_missing_counterpart(v.interco),
    "interco_amount_mismatch": lambda v: interco.interco_amount_mismatch(v.interco),
    # journals
    "journal_null_rows": lambda v: jn.journal_null_rows(v.journals),
    "journal_dropna": lambda v: jn.journal_dropna(v.journals),
    "journal_duplicates": lambda v: jn.journal_duplicates(v.journals),
    "journal_balance": lambda v: jn.journal_balance(jn.journal_dropna(v.journals)),
    "journal_balance_by_id": lambda v: jn.journal_balance_by_id(v.journals),
    "journal_duplicate_ids": lambda v: jn.journal_duplicate_ids(v.journals),
    "journal_status": lambda v: jn.journal_status(v.journals),
    "journal_missing_fields": lambda v: jn.journal_missing_fields(v.journals),
    "journal_missing_field_rows": lambda v: jn.journal_missing_field_rows(v.journals),
    "journal_existing_keys": lambda v: jn.journal_existing_keys(v.journals, v.journals_stored),
    "journal_new_rows": lambda v: jn.journal_new_rows(v.journals, v.journals_stored),
    "read_back": lambda v: jn.read_back(v.journals_stored, v.journals),
    "journal_id_number": lambda v: jn.journal_id_number(v.journals),
    # audit
    "audit_log_entries": _logs,
    "audit_log_filtered": lambda v: audit.audit_log_entries(
        jn.journal_dropna(v.journals), user="ENT015", action="Debit"),
    "audit_timeline": lambda v: audit.audit_timeline(_logs(v)),
    "audit_flags": lambda v: audit.audit_flags(_logs(v), v.audit_log),
    "audit_stale_pending": lambda v: audit.audit_stale_pending(v.audit_log, AUDIT_DATE),
    "audit_missing_record": lambda v: audit.audit_missing_record(v.journals, v.audit_log),
    "source_counts": lambda v: audit.source_counts(_sources(v)),
    "missing_sources": lambda v: audit.missing_sources(_sources(v)),
    "total_entries": lambda v: audit.total_entries(_sources(v)),
    **{
        f"audit_sorted_{table}": (
            lambda v, table=table: audit.audit_sorted(_stored_with_key(v, table), table)
        )
        for table in (
            "journal_entries", "interco_reconciliation", "gst_validation", "tds_validation",
            "provision_planning", "consolidation", "audit_log",
        )
    },
    # reporting
    "statement_totals": lambda v: reporting.statement_totals(_ctb(v)),
    "quarterly_values": lambda v: reporting.quarterly_values(v.consolidation),
    "period_variance": lambda v: reporting.period_variance(
        reporting.quarterly_values(v.consolidation)),
    "statement_report": lambda v: reporting.statement_report(_statement_values(v)),
    "financial_report": lambda v: reporting.financial_report(_ledger_of_interco(v)),
    "empty_report_fields": lambda v: reporting.empty_report_fields(
        reporting.period_variance(reporting.quarterly_values(v.consolidation))),
    "close_checks": lambda v: _close(v, reporting.close_checks),
    "close_warnings": lambda v: _close(v, reporting.close_warnings),
    # text, records, vectors
    "row_documents": lambda v: row_documents(v.consolidation),
    "to_records": lambda v: to_records(v.audit_log),
    "sample_rows": lambda v: sample_rows(v.journals, 5, [
        "entry_date", "journal_id", "account", "type", "amount", "entity"]),
    "feedback_gate": lambda v: feedback_gate(
        v.conversations, V.GATE_PHRASES["journal"]).select("conv_id", "turn", "passed"),
    "feedback_gate_orders": lambda v: feedback_gate(
        v.feedback, V.GATE_PHRASES["journal"]).select("id", "passed"),
    "feedback_sections": lambda v: feedback_sections(v.feedback),
    "vector_top_k": lambda v: vector_top_k_of(
        v.embeddings, _questions(v, F.col("vec_id") == 0)).drop("question_id"),
    "vector_top_k_questions": lambda v: vector_top_k_rounds(
        v.embeddings, _questions(v, F.col("vec_id") % 50 == 7)),
    # rows that report sections leave out
    "gst_excluded_rows": lambda v: gst.gst_excluded_rows(_without(
        v.gst_validation, vendor_name=F.col("itc_eligible") == "N",
        invoice_date=F.col("igst_amount") > 0)),
    "tds_excluded_rows": lambda v: tds.tds_excluded_rows(_without(
        v.tds_validation, vendor_name=F.col("status") == "REJECTED",
        section_code=F.col("section_code") == "194Q")),
    "provision_excluded_rows": lambda v: provisions.provision_excluded_rows(_without(
        v.provision_planning, expense_category=F.col("frequency") == "Weekly",
        vendor_name=F.col("amount") < 0)),
    "position_excluded_rows": lambda v: con.position_excluded_rows(_without(
        v.consolidation, entity_code=F.col("interco_flag") == "Y",
        account_name=F.col("debit_amount") > 50000)),
}


def _order_text(v: SampleViews) -> DataFrame:
    """Orders as a CSV gives them: text under free headers, with cells that do not parse."""
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    return v.raw("orders").select(
        F.concat(F.lit(" "), key.cast("string")).alias(" Order ID "),
        F.when(key % 11 == 0, "2024-13-01").when(key % 13 == 0, "n/a")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Order Date"),
        F.when(key % 7 == 0, "abc").when(key % 5 == 0, " ").otherwise(price)
        .alias("Total Price"),
    )


def _typed_rejects(v: SampleViews) -> DataFrame:
    schema = (T.StructType().add("order_id", T.StringType()).add("order_date", T.DateType())
              .add("total_price", T.DecimalType(15, 2)).add("note", T.StringType()))
    rows = csv_files.typed(csv_files.normalize_headers(_order_text(v)), schema, "bad")
    return rows.withColumn("bad", F.array_join("bad", ","))


def _layouts_union(v: SampleViews) -> DataFrame:
    rows = csv_files.normalize_headers(_order_text(v))
    even = F.trim("order_id").cast("long") % 2 == 0
    return rows.filter(even).drop("total_price").unionByName(
        rows.filter(~even).drop("order_date"), allowMissingColumns=True)


def _stored_layout(v: SampleViews) -> DataFrame:
    """Rows with many equal ones, as an upload stores them: ids made, absent columns null."""
    rows = v.raw("lineitem").select(
        F.col("l_suppkey").cast("string").alias("journal_id"),
        F.col("l_returnflag").alias("description"))
    keyed = tables.with_row_ids(rows, ["journal_id", "description"], F.lit("upload.csv"))
    return tables.conform(keyed, "journal_entries").select(
        "id", "journal_id", "description", "debit_amount")


VIEW_QUERIES |= {
    "headers_normalized": lambda v: csv_files.normalize_headers(_order_text(v)),
    "journal_headers": lambda v: csv_files.normalize_journal_headers(
        _order_text(v).toDF("journal id", " ENTRY_TYPE", "amount")),
    "typed_rejects": _typed_rejects,
    "layouts_union": _layouts_union,
    "stored_layout": _stored_layout,
    **JOB_QUERIES,
}


def _registered(build: View) -> Query:
    """Money as double and dates as text, the form both engines can be compared in."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return dates_as_text(money_as_double(build(SampleViews(spark, folder))))

    return run


def queries() -> dict[str, Query]:
    return {name: _registered(build) for name, build in VIEW_QUERIES.items()}
