"""Values that results depend on and that are given, not derived.

Rates, thresholds, formats, word lists and message texts of the finance domain.
Everything here is a default: the operators take each of them as a parameter.
"""

from __future__ import annotations

from decimal import Decimal

# --- Fixed values: tolerances and horizons -----------------------------------
MONEY_TOLERANCE = Decimal("0.01")
COUNTERPART_TOLERANCE = Decimal("1")
SPIKE_PERCENT = 20
UPCOMING_DAYS = 30
STALE_QUERY_DAYS = 7
REPEATING_MIN_MONTHS = 3
RETRIEVAL_K = 4

# --- Fixed values: withholding tax (TDS) -------------------------------------
# Share of the payment due per section; any other section expects nothing.
TDS_PAYMENT_RATES = {
    "194C": Decimal("0.01"),
    "194D": Decimal("0.05"),
    "194H": Decimal("0.05"),
    "194I": Decimal("0.10"),
    "194J": Decimal("0.10"),
}

# Rates of the grouped PAN/section check. They differ from the table above.
TDS_GROUP_RATES = {
    "192": Decimal("0.10"),
    "194C": Decimal("0.02"),
    "194J": Decimal("0.10"),
    "194I": Decimal("0.10"),
}

# Payment from which the section applies.
TDS_THRESHOLDS = {
    "194C": 30000,
    "194D": 15000,
    "194H": 15000,
    "194I": 240000,
    "194J": 30000,
}

# --- Fixed values: formats ---------------------------------------------------
GSTIN_PATTERN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$"
PAN_PATTERN = "^[A-Z]{5}[0-9]{4}[A-Z]{1}$"

# --- Fixed values: codes -----------------------------------------------------
FREQUENCY_MONTHS = {"Monthly": 1, "Quarterly": 3, "Annual": 12}
TDS_STATUSES = ("PAID", "PENDING", "REJECTED")
CONFIDENCE_HIGH_ABOVE = Decimal("0.9")
CONFIDENCE_MEDIUM_FROM = Decimal("0.7")

# --- Fixed values: account classes, matched as case-sensitive substrings -----
BALANCE_SHEET_WORDS = ("Assets", "Liabilities", "Equity")
PROFIT_LOSS_WORDS = ("Revenue", "Expenses")
CASH_FLOW_WORDS = ("Operating", "Investing", "Financing")

# --- Fixed values: columns a check cannot do without -------------------------
# In the header vocabulary of the incoming files.
REQUIRED_COLUMNS = {
    "journals": ("Date", "Account", "Type", "Amount", "Entity", "Journal ID"),
    "interco": ("Entity", "Counterparty", "Account", "Amount", "Journal ID"),
    "gst": ("Invoice No", "GSTIN", "Invoice Date", "Tax Amount", "ITC Flag", "GSTR Summary"),
    "tds": ("PAN", "Section", "TDS Amount", "Challan No", "Date"),
    "provisions": (
        "Expense Ledger", "Period", "Vendor", "Frequency", "Last Provision Date", "Amount",
    ),
    "trial_balance": ("Account", "Debit", "Credit", "Entity"),
    "interco_matrix": ("Entity", "Counterparty", "Amount", "Account"),
}

# Alternate journal headers and the name they stand for.
JOURNAL_HEADER_ALIASES = {"Entry Type": "Type", "Journal Id": "Journal ID"}

# Tokens that count as a missing value in a CSV cell.
CSV_MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# --- Fixed values: phrases that let a reviewed upload pass, per domain -------
GATE_PHRASES = {
    "journal": (
        "no errors", "all entries are valid", "validated successfully",
        "no duplicate", "no missing data",
    ),
    "interco": (
        "no errors", "all entries are valid", "validated successfully",
        "reconciliation process", "mismatched transactions",
        "missing counterpart entries", "reconciliation report",
    ),
    "consolidation": (
        "no errors", "all entries are valid", "validated successfully",
        "consolidation process", "trial balance", "intercompany elimination",
        "consolidation report",
    ),
    "gst": (
        "no errors", "all entries are valid", "validated successfully",
        "gst validation", "itc analysis", "tax calculation", "gst compliance",
    ),
    "tds": (
        "no errors", "all entries are valid", "validated successfully",
        "tds validation", "tds compliance", "tds verification", "tds analysis",
    ),
    "provision": (
        "no errors", "all entries are valid", "validated successfully",
        "provision analysis", "expense patterns", "provision planning",
        "accrual entries",
    ),
}

# --- Fixed values: markers inside a reconciliation feedback text -------------
FEEDBACK_MISMATCHED = "Mismatched Transactions"
FEEDBACK_MISSING = "Missing Counterpart Entries"
FEEDBACK_ACTIONS = "Action Items"
FEEDBACK_SECTION_END = "###"
FEEDBACK_ACTION_PREFIXES = ("1.", "2.", "3.")

# --- Fixed values: issue labels ----------------------------------------------
ISSUE_TAX_MISMATCH = "Tax calculation mismatch"
ISSUE_GSTIN = "Invalid GSTIN format"
ISSUE_PAN = "Invalid PAN format"
ISSUE_TDS_MISMATCH = "TDS calculation mismatch"
ISSUE_DATES = "Missing date information"
ISSUE_FREQUENCY = "Invalid frequency"
ISSUE_AMOUNT = "Invalid amount"
ISSUE_CONFIDENCE = "Invalid confidence score"
ISSUE_UNBALANCED = "Unbalanced position"

# --- Fixed values: close warnings, check name -> text ({n} is the count) -----
WARNING_TEXTS = {
    "journal_null_fields": "Warning: {n} null fields found in journal entries",
    "journal_balance": "Warning: Debit-Credit balance mismatch in journal entries",
    "journal_duplicates": "Warning: {n} duplicate journal entries found",
    "balance_sheet": "Warning: Balance Sheet Mismatch - {detail}",
    "unclassified_accounts": "Warning: Unclassified Accounts - {detail}",
    "interco_mismatches": "Warning: {n} intercompany mismatches found",
    "interco_missing_counterparties": "Warning: {n} missing counterparties found",
    "gst_mismatches": "Warning: {n} GST mismatches found",
    "gst_missing_invoices": "Warning: {n} missing GST invoices found",
    "gst_excess_itc": "Warning: {n} excess ITC claims found",
    "tds_deduction_mismatches": "Warning: {n} TDS deduction mismatches found",
    "tds_missing_challans": "Warning: {n} missing TDS challans found",
    "provisions_missing": "Warning: {n} missing provisions found",
    "provision_spikes": "Warning: {n} provision amount spikes found",
}
