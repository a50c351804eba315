"""GST register summaries and checks, and the return/register comparison.

Register columns: invoice_number, gstin, vendor_name, invoice_date, taxable_amount,
cgst_amount, sgst_amount, igst_amount, total_amount, itc_eligible.
Return columns: invoice_no, gstr_summary, itc_flag.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks import fixed_values as V
from closebooks.functions.exprs import (
    count_rows, differs, exceeds, fails_pattern, month_text, summed_levels, total,
)
from closebooks.operators import cells as ce
from closebooks.operators.issues import Check, issue_rows
from closebooks.operators.skew import key_presence


def _itc(flag: str) -> Column:
    """Credit is counted on the invoice total, not on its tax."""
    return total(F.when(F.col("itc_eligible") == flag, F.col("total_amount")))


def _invoice_measures() -> list[Column]:
    return [
        count_rows().alias("total_invoices"),
        total("total_amount").alias("total_amount"),
        (total("cgst_amount") + total("sgst_amount") + total("igst_amount")).alias("total_tax"),
        _itc("Y").alias("eligible_itc"),
        _itc("N").alias("ineligible_itc"),
    ]


def gst_vendor_summary(gst: DataFrame) -> DataFrame:
    named = gst.filter(F.col("vendor_name").isNotNull())
    return named.groupBy("vendor_name").agg(*_invoice_measures())


def gst_monthly_summary(gst: DataFrame) -> DataFrame:
    dated = gst.filter(F.col("invoice_date").isNotNull())
    return dated.groupBy(month_text("invoice_date").alias("month")).agg(*_invoice_measures())


def gst_itc_summary(gst: DataFrame) -> DataFrame:
    """Invoices flagged neither Y nor N count in the total alone."""
    return gst.agg(
        _itc("Y").alias("eligible"), _itc("N").alias("ineligible"),
        total("total_amount").alias("total"),
    )


def gst_tax_summary(gst: DataFrame) -> DataFrame:
    return gst.agg(
        total("cgst_amount").alias("cgst"),
        total("sgst_amount").alias("sgst"),
        total("igst_amount").alias("igst"),
        (total("cgst_amount") + total("sgst_amount") + total("igst_amount")).alias("total_tax"),
    )


def gst_summary_levels(gst: DataFrame) -> DataFrame:
    """Vendor, month and overall figures from a single scan.

    level is vendor, month or all; key is the vendor or month, null for all. Rows are
    summed per vendor and month first; the grouping sets then copy only those sums.
    """
    return levels_of_cells(gst_cells(gst))


def gst_cells(gst: DataFrame) -> DataFrame:
    """Sums per vendor and month, from which every summary of the register follows."""
    keys = {"vendor": F.col("vendor_name"), "month": month_text("invoice_date")}
    return ce.cells_of(gst, keys, [
        *_invoice_measures(),
        total("cgst_amount").alias("cgst"),
        total("sgst_amount").alias("sgst"),
        total("igst_amount").alias("igst"),
    ])


def levels_of_cells(cells: DataFrame) -> DataFrame:
    measures = [c for c in cells.columns if c not in ("vendor", "month")]
    return summed_levels(cells, ["vendor", "month"], measures)


def summaries_of_cells(cells: DataFrame) -> dict[str, DataFrame]:
    """The summaries above by name, and the rows that each leaves out for want of its key."""
    invoices = ["total_invoices", "total_amount", "total_tax", "eligible_itc", "ineligible_itc"]
    every = ce.overall(cells, [c for c in cells.columns if c not in ("vendor", "month")])
    return {
        "summaries": levels_of_cells(cells),
        "vendor_summary": ce.section(cells, "vendor", invoices, "vendor_name"),
        "itc_summary": every.select(
            F.col("eligible_itc").alias("eligible"), F.col("ineligible_itc").alias("ineligible"),
            F.col("total_amount").alias("total")),
        "tax_summary": every.select("cgst", "sgst", "igst", "total_tax"),
        "monthly_summary": ce.section(cells, "month", invoices),
        "excluded_rows": ce.left_out(cells, ["vendor", "month"], "total_invoices", "total_amount"),
    }


def gst_excluded_rows(gst: DataFrame) -> DataFrame:
    """section, row_count, amount: invoices without a vendor, and without a date."""
    return summaries_of_cells(gst_cells(gst))["excluded_rows"]


def _calculated_total() -> Column:
    return (
        F.col("taxable_amount") + F.col("cgst_amount") + F.col("sgst_amount")
        + F.col("igst_amount")
    )


def _checks(tolerance: Decimal, pattern: str) -> tuple[Check, Check]:
    calculated = _calculated_total()
    return (
        Check(
            V.ISSUE_TAX_MISMATCH, exceeds(calculated - F.col("total_amount"), tolerance),
            expected=calculated, actual=F.col("total_amount"),
        ),
        Check(V.ISSUE_GSTIN, fails_pattern("gstin", pattern), value=F.col("gstin")),
    )


def gst_tax_mismatches(gst: DataFrame, tolerance: Decimal = V.MONEY_TOLERANCE) -> DataFrame:
    return gst.select(
        "invoice_number", _calculated_total().alias("calculated"),
        F.col("total_amount").alias("actual"),
    ).filter(exceeds(F.col("calculated") - F.col("actual"), tolerance))


def gst_invalid_gstin(gst: DataFrame, pattern: str = V.GSTIN_PATTERN) -> DataFrame:
    return gst.filter(fails_pattern("gstin", pattern)).select("invoice_number", "gstin")


def gst_issues(
    gst: DataFrame, tolerance: Decimal = V.MONEY_TOLERANCE, pattern: str = V.GSTIN_PATTERN
) -> DataFrame:
    key = F.col("invoice_number").alias("key")
    return issue_rows(gst, [key], list(_checks(tolerance, pattern)))


def gst_return_mismatches(ret: DataFrame) -> DataFrame:
    """Return line and invoice number differ; either or both missing counts too."""
    return ret.filter(differs(F.col("gstr_summary"), F.col("invoice_no"))).select(
        "invoice_no", "gstr_summary", "itc_flag"
    )


def gst_missing_invoices(ret: DataFrame) -> DataFrame:
    return ret.filter(F.col("invoice_no").isNull()).select("gstr_summary", "itc_flag")


def gst_excess_itc(ret: DataFrame, flag: str = "Excess") -> DataFrame:
    return ret.filter(F.col("itc_flag") == flag).select("invoice_no", "gstr_summary")


def gst_return_counts(ret: DataFrame) -> DataFrame:
    """The sizes of the three lists above, from one scan."""
    return ret.agg(
        F.count_if(differs(F.col("gstr_summary"), F.col("invoice_no"))).alias("mismatches"),
        F.count_if(F.col("invoice_no").isNull()).alias("missing_invoices"),
        F.count_if(F.col("itc_flag") == "Excess").alias("excess_itc"),
    )


def gst_register_vs_return(
    gst: DataFrame, ret: DataFrame, return_key: str = "gstr_summary"
) -> DataFrame:
    """Invoices found in only one of the two: invoice_number, missing_in."""
    key = "invoice_number"
    both = key_presence(
        gst.select(key).filter(F.col(key).isNotNull()),
        ret.select(F.col(return_key).alias(key)).filter(F.col(key).isNotNull()),
        [key],
    )
    return both.filter(F.col("in_left") != F.col("in_right")).select(
        key, F.when(F.col("in_left"), "return").otherwise("register").alias("missing_in")
    )
