from __future__ import annotations

from decimal import Decimal

import pytest

from closebooks.operators import gst, tds
from closebooks.schemas import TABLE_SCHEMAS
from tests.conftest import day, money, rows

D = Decimal


@pytest.fixture(scope="module")
def register(spark):
    data = [
        # id, invoice, gstin, vendor, date, taxable, cgst, sgst, igst, total, itc
        ("1", "A", "29AAAAA1234A1Z1", "V1", "2024-01-05", "100", "9", "9", "0", "118", "Y"),
        ("2", "B", "29AAAAA1234A0Z1", "V1", "2024-01-31", "100", "9", "9", "0", "118.01", "N"),
        ("3", "C", None, "V2", "2024-02-01", "100", "9", "9", "0", "118.02", "X"),
        ("4", "D", "29aaaaa1234A1Z1", None, None, None, "9", None, "0", "50", "Y"),
    ]
    typed = [
        (r[0], r[1], r[2], r[3], day(r[4]), *map(money, r[5:10]), r[10]) for r in data
    ]
    return spark.createDataFrame(typed, TABLE_SCHEMAS["gst_validation"])


def test_vendor_summary_drops_null_vendor_and_ignores_other_flags(register):
    assert rows(gst.gst_vendor_summary(register)) == [
        ("V1", 2, D("236.01"), D("36.00"), D("118.00"), D("118.01")),
        ("V2", 1, D("118.02"), D("18.00"), D("0.00"), D("0.00")),
    ]


def test_itc_total_includes_every_flag(register):
    assert rows(gst.gst_itc_summary(register)) == [(D("168.00"), D("118.01"), D("404.03"))]


def test_summaries_of_nothing_are_zero(register):
    empty = register.filter("false")
    assert rows(gst.gst_itc_summary(empty)) == [(D("0.00"),) * 3]
    assert rows(gst.gst_tax_summary(empty)) == [(D("0.00"),) * 4]
    assert rows(gst.gst_vendor_summary(empty)) == []


def test_a_cent_is_within_tolerance_and_null_is_not_a_mismatch(register):
    assert rows(gst.gst_tax_mismatches(register), "invoice_number") == [("C",)]


def test_missing_and_malformed_gstin(register):
    assert rows(gst.gst_invalid_gstin(register), "invoice_number") == [("B",), ("C",), ("D",)]


def test_issues_are_both_checks_together(register):
    got = rows(gst.gst_issues(register), "key", "issue")
    assert got == [
        ("B", "Invalid GSTIN format"), ("C", "Invalid GSTIN format"),
        ("C", "Tax calculation mismatch"), ("D", "Invalid GSTIN format"),
    ]


def test_levels_agree_with_the_single_summaries(register):
    levels = gst.gst_summary_levels(register)
    measures = ["total_invoices", "total_amount", "total_tax", "eligible_itc", "ineligible_itc"]
    vendor = levels.filter("level = 'vendor'")
    month = levels.filter("level = 'month'")
    assert rows(vendor, "key", *measures) == rows(gst.gst_vendor_summary(register))
    assert rows(month, "key", *measures) == rows(gst.gst_monthly_summary(register))
    overall = levels.filter("level = 'all'")
    assert rows(overall, "total_invoices", "total_amount") == [(4, D("404.03"))]
    assert rows(overall, "cgst", "sgst", "igst", "total_tax") == rows(
        gst.gst_tax_summary(register))


def test_return_lines_with_nulls_on_either_side_differ(spark):
    ret = spark.createDataFrame(
        [("A", "A", "Y"), ("B", "X", "Y"), (None, "C", "Excess"), ("D", None, "Y"),
         (None, None, "Y")],
        "invoice_no string, gstr_summary string, itc_flag string",
    )
    assert rows(gst.gst_return_mismatches(ret), "invoice_no", "gstr_summary") == [
        ("B", "X"), ("D", None), (None, "C"), (None, None)]
    assert rows(gst.gst_return_counts(ret)) == [(4, 2, 1)]


def test_register_against_return_both_ways(spark, register):
    ret = spark.createDataFrame([("A",), ("A",), ("Z",), (None,)], "gstr_summary string")
    assert rows(gst.gst_register_vs_return(register, ret)) == [
        ("B", "return"), ("C", "return"), ("D", "return"), ("Z", "register")]


TDS_COLUMNS = (
    "rid string, challan_number string, pan string, vendor_name string, section_code string, "
    "tds_amount decimal(15,2), transaction_date date, payment_amount decimal(15,2), "
    "status string"
)


@pytest.fixture(scope="module")
def deducted(spark):
    data = [
        ("1", "C1", "ABCDE1234F", "V1", "194C", "10", "2024-01-01", "1000", "PAID"),
        ("2", "C2", "ABCDE1234F", "V1", "194C", "10.02", "2024-01-31", "1000", "PENDING"),
        ("3", None, "ABCDE12345", "V2", "194Q", "0", "2024-02-01", "1000", "REJECTED"),
        ("4", " ", None, "V2", "194J", "4000", "2024-02-02", "30000", "PAID"),
        ("5", "C5", "ABCDE1234F", None, None, "5", None, None, "OPEN"),
    ]
    typed = [
        (*r[:5], money(r[5]), day(r[6]), money(r[7]), r[8]) for r in data
    ]
    return spark.createDataFrame(typed, TDS_COLUMNS)


def test_section_summary_counts_statuses(deducted):
    assert rows(tds.tds_section_summary(deducted)) == [
        ("194C", 2, D("20.02"), D("2000.00"), 1, 1, 0),
        ("194J", 1, D("4000.00"), D("30000.00"), 1, 0, 0),
        ("194Q", 1, D("0.00"), D("1000.00"), 0, 0, 1),
    ]
    assert rows(tds.tds_status_summary(deducted)) == [(2, 1, 1)]


def test_levels_agree_with_the_single_tds_summaries(deducted):
    levels = tds.tds_summary_levels(deducted).drop("level")
    singles = (
        rows(tds.tds_vendor_summary(deducted)) + rows(tds.tds_section_summary(deducted))
        + rows(tds.tds_monthly_summary(deducted))
    )
    assert sorted(map(str, rows(levels.filter("key is not null")))) == sorted(map(str, singles))


def test_threshold_is_strict_and_unknown_sections_are_left_out(deducted):
    assert rows(tds.tds_thresholds(deducted), "rid", "threshold", "side") == [
        ("1", 30000, "below"), ("2", 30000, "below"), ("4", 30000, "above")]


def test_expected_tax_by_section_with_zero_for_others(deducted):
    got = rows(tds.tds_calc_mismatches(deducted), "rid", "calculated", "actual")
    assert got == [
        ("2", D("10.0000"), D("10.02")), ("4", D("3000.0000"), D("4000.00")),
        ("5", D("0.0000"), D("5.00"))]


def test_pan_issues(deducted):
    assert rows(tds.tds_invalid_pan(deducted), "rid") == [("3",), ("4",)]
    assert rows(tds.tds_missing_challan(deducted), "rid") == [("3",)]
    assert rows(tds.tds_missing_identifiers(deducted), "rid") == [("3",), ("4",)]
    assert rows(tds.tds_issues(deducted), "key", "issue") == [
        ("2", "TDS calculation mismatch"), ("3", "Invalid PAN format"),
        ("4", "Invalid PAN format"), ("4", "TDS calculation mismatch"),
        ("5", "TDS calculation mismatch")]


def test_group_check_on_both_bases(deducted):
    got = rows(tds.tds_group_check(deducted), "pan", "section_code", "expected_tds",
               "actual_tds")
    assert got == [("ABCDE1234F", "194C", D("0.4004"), D("20.02"))]
    by_payment = rows(tds.tds_group_check(deducted, base="payment_amount"), "difference")
    assert by_payment == [(D("19.9800"),)]
    assert rows(tds.tds_counts(deducted)) == [(1, 1)]


def test_challans_against_external_records(spark):
    columns = "challan_number string, tds_amount decimal(15,2), transaction_date date"
    ours = [("a", "1", "2024-01-01"), ("b", "1", "2024-01-01"), ("c", "1", "2024-01-01"),
            ("d", "1", "2024-01-01"), ("e", "1", "2024-01-01"), (None, "1", "2024-01-01"),
            ("s", "1", "2024-01-01"), ("s", "2", "2024-01-02")]
    theirs = [("a", "1", "2024-01-01"), ("b", "2", "2024-01-01"), ("c", "1", "2024-01-02"),
              ("d", "2", "2024-01-02"), ("f", "1", "2024-01-01"), (None, "1", "2024-01-01"),
              ("s", "2", "2024-01-01"), ("s", "1", "2024-01-02")]
    def frame(data):
        return spark.createDataFrame([(c, money(a), day(t)) for c, a, t in data], columns)

    assert rows(tds.traces_match(frame(ours), frame(theirs))) == [
        ("a", "matched"), ("b", "amount_mismatch"), ("c", "date_mismatch"),
        ("d", "amount_and_date_mismatch"), ("e", "missing_in_traces"),
        ("f", "missing_in_tds"), ("s", "matched")]
