"""Explicit schemas of the stored tables, and the order each is read back in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "date": T.DateType(),
    "decimal(15,2)": T.DecimalType(15, 2), "decimal(10,2)": T.DecimalType(10, 2),
    "decimal(4,2)": T.DecimalType(4, 2),
}


def _schema(columns: str) -> T.StructType:
    """Schema of "name type, name type, ..." without needing a session."""
    pairs = (c.split(" ") for c in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# --- Fixed values: table layouts ---------------------------------------------
# `id` is a text key the caller derives from the row's own columns: a running number
# would need one task to hand it out.
TABLE_SCHEMAS: dict[str, T.StructType] = {
    "provision_planning": _schema(
        "id string, expense_category string, vendor_name string, amount decimal(15,2), "
        "frequency string, last_provision_date date, expected_date date, "
        "confidence_score decimal(4,2)"
    ),
    "expense_ledger": _schema(
        "expense_id string, expense_category string, vendor_name string, "
        "amount decimal(15,2), transaction_date date, payment_status string, "
        "recurring_flag string"
    ),
    "previous_provisions": _schema(
        "provision_id string, expense_category string, vendor_name string, "
        "amount decimal(15,2), provision_date date, actual_amount decimal(15,2), "
        "difference decimal(15,2), status string"
    ),
    "vendor_info": _schema(
        "vendor_id string, vendor_name string, contract_start_date date, "
        "contract_end_date date, payment_terms string, recurring_amount decimal(15,2), "
        "frequency string"
    ),
    "consolidation": _schema(
        "id string, entity_code string, account_code string, account_name string, "
        "debit_amount decimal(15,2), credit_amount decimal(15,2), transaction_date date, "
        "interco_flag string"
    ),
    "trial_balance": _schema(
        "entity_code string, account_code string, account_name string, "
        "opening_debit decimal(15,2), opening_credit decimal(15,2), "
        "current_debit decimal(15,2), current_credit decimal(15,2), "
        "closing_debit decimal(15,2), closing_credit decimal(15,2)"
    ),
    "ic_mapping": _schema(
        "entity_from string, entity_to string, account_from string, account_to string, "
        "elimination_account string, description string"
    ),
    "financial_report": _schema(
        "id string, report_type string, period string, entity string, metric string, "
        "value decimal(15,2), previous_value decimal(15,2), variance decimal(15,2), "
        "variance_percentage decimal(10,2)"
    ),
    "audit_log": _schema(
        "id string, journal_id string, transaction_date date, account_code string, "
        "amount decimal(15,2), user_id string, action_type string, change_details string, "
        "audit_status string"
    ),
    "journal_entries": _schema(
        "id string, journal_id string, transaction_date date, account_code string, "
        "account_name string, debit_amount decimal(15,2), credit_amount decimal(15,2), "
        "entity string, description string"
    ),
    "interco_reconciliation": _schema(
        "id string, transaction_id string, entity_from string, entity_to string, "
        "account_code string, amount decimal(15,2), transaction_date date, status string, "
        "reconciliation_id string"
    ),
    "gst_validation": _schema(
        "id string, invoice_number string, gstin string, vendor_name string, "
        "invoice_date date, taxable_amount decimal(15,2), cgst_amount decimal(15,2), "
        "sgst_amount decimal(15,2), igst_amount decimal(15,2), total_amount decimal(15,2), "
        "itc_eligible string"
    ),
    "tds_validation": _schema(
        "id string, challan_number string, pan string, vendor_name string, "
        "section_code string, tds_amount decimal(15,2), transaction_date date, "
        "payment_amount decimal(15,2), status string"
    ),
    "traces_data": _schema(
        "id string, challan_number string, pan string, vendor_name string, "
        "section_code string, tds_amount decimal(15,2), transaction_date date, "
        "status string, acknowledgement_number string"
    ),
}


@dataclass(frozen=True)
class ReadOrder:
    """Sort order of a table read: (column, descending) pairs, then a unique key."""

    columns: tuple[tuple[str, bool], ...]
    key: str = "id"


# --- Fixed values: order of the audit listing (newest first but for one) -----
AUDIT_ORDER = {
    "journal_entries": ReadOrder((("transaction_date", True),)),
    "interco_reconciliation": ReadOrder((("transaction_date", True),)),
    "gst_validation": ReadOrder((("invoice_date", True),)),
    "tds_validation": ReadOrder((("transaction_date", True),)),
    "provision_planning": ReadOrder((("expected_date", True),)),
    "consolidation": ReadOrder((("entity_code", False), ("account_code", False))),
    "audit_log": ReadOrder((("transaction_date", True),)),
}

# --- Fixed values: order in which rows just stored are handed back -----------
READ_BACK_ORDER = {
    "journal_entries": ReadOrder((("journal_id", False), ("transaction_date", False))),
    "interco_reconciliation": ReadOrder(
        (("transaction_id", False), ("transaction_date", False))
    ),
    "consolidation": ReadOrder((("entity_code", False), ("transaction_date", False))),
    "gst_validation": ReadOrder((("invoice_date", False), ("invoice_number", False))),
    "tds_validation": ReadOrder((("transaction_date", False), ("challan_number", False))),
    "provision_planning": ReadOrder((("expected_date", False), ("expense_category", False))),
}

# --- Fixed values: key by which an upload is refused if already stored -------
BATCH_KEYS = {"journal_entries": "journal_id", "interco_reconciliation": "transaction_id"}
