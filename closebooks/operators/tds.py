"""Withholding tax (TDS) summaries and checks, and the match with external records.

Columns: rid (row key), challan_number, pan, vendor_name, section_code, tds_amount,
transaction_date, payment_amount, status.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks import fixed_values as V
from closebooks.functions.exprs import (
    choose, count_rows, exceeds, fails_pattern, is_blank, month_text, summed_levels, total,
)
from closebooks.operators import cells as ce
from closebooks.operators.issues import Check, issue_rows


def _status_counts() -> list[Column]:
    return [
        F.count_if(F.col("status") == s).alias(s.lower()) for s in V.TDS_STATUSES
    ]


def _challan_measures() -> list[Column]:
    return [
        count_rows().alias("total_challans"),
        total("tds_amount").alias("total_tds"),
        total("payment_amount").alias("total_payment"),
        *_status_counts(),
    ]


def tds_vendor_summary(tds: DataFrame) -> DataFrame:
    named = tds.filter(F.col("vendor_name").isNotNull())
    return named.groupBy("vendor_name").agg(*_challan_measures())


def tds_section_summary(tds: DataFrame) -> DataFrame:
    coded = tds.filter(F.col("section_code").isNotNull())
    return coded.groupBy("section_code").agg(*_challan_measures())


def tds_status_summary(tds: DataFrame) -> DataFrame:
    return tds.agg(*_status_counts())


def tds_monthly_summary(tds: DataFrame) -> DataFrame:
    dated = tds.filter(F.col("transaction_date").isNotNull())
    return dated.groupBy(month_text("transaction_date").alias("month")).agg(
        *_challan_measures()
    )


def tds_summary_levels(tds: DataFrame) -> DataFrame:
    """Vendor, section, month and overall figures from a single scan.

    Summed per vendor, section and month first, then by grouping sets over the sums.
    """
    return levels_of_cells(tds_cells(tds))


_CELL_KEYS = ["vendor", "section", "month"]


def tds_cells(tds: DataFrame) -> DataFrame:
    """Sums per vendor, section and month, from which every summary follows."""
    values = (F.col("vendor_name"), F.col("section_code"), month_text("transaction_date"))
    return ce.cells_of(tds, dict(zip(_CELL_KEYS, values)), _challan_measures())


def levels_of_cells(cells: DataFrame) -> DataFrame:
    return summed_levels(cells, _CELL_KEYS, [c for c in cells.columns if c not in _CELL_KEYS])


def summaries_of_cells(cells: DataFrame) -> dict[str, DataFrame]:
    """The summaries above by name, and the rows that each leaves out for want of its key."""
    measures = [c for c in cells.columns if c not in _CELL_KEYS]
    return {
        "summaries": levels_of_cells(cells),
        "vendor_summary": ce.section(cells, "vendor", measures, "vendor_name"),
        "section_summary": ce.section(cells, "section", measures, "section_code"),
        "status_summary": ce.overall(cells, [s.lower() for s in V.TDS_STATUSES]),
        "monthly_summary": ce.section(cells, "month", measures),
        "excluded_rows": ce.left_out(cells, _CELL_KEYS, "total_challans", "total_payment"),
    }


def tds_excluded_rows(tds: DataFrame) -> DataFrame:
    """section, row_count, amount: challans without a vendor, a section, and a date."""
    return summaries_of_cells(tds_cells(tds))["excluded_rows"]


def tds_thresholds(
    tds: DataFrame, thresholds: Mapping[str, int] = V.TDS_THRESHOLDS
) -> DataFrame:
    """Payments below or from the section's threshold; unknown sections in neither."""
    known = tds.select(
        "rid", F.col("section_code").alias("section"), F.col("payment_amount").alias("payment"),
    ).withColumn("threshold", choose(F.col("section"), thresholds))
    side = F.when(F.col("payment") < F.col("threshold"), "below").otherwise("above")
    return known.filter(F.col("threshold").isNotNull()).withColumn("side", side)


def _expected(base: Column, rates: Mapping[str, Decimal]) -> Column:
    """base x rate; nothing is expected for a section without a rate."""
    known = F.col("section_code").isin(*rates)
    return F.when(known, base * choose(F.col("section_code"), rates)).otherwise(F.lit(0))


def _checks(
    rates: Mapping[str, Decimal], tolerance: Decimal, pattern: str
) -> tuple[Check, Check]:
    expected = _expected(F.col("payment_amount"), rates)
    return (
        Check(V.ISSUE_PAN, fails_pattern("pan", pattern), value=F.col("pan")),
        Check(
            V.ISSUE_TDS_MISMATCH, exceeds(expected - F.col("tds_amount"), tolerance),
            expected=expected, actual=F.col("tds_amount"),
        ),
    )


def tds_invalid_pan(tds: DataFrame, pattern: str = V.PAN_PATTERN) -> DataFrame:
    return tds.filter(fails_pattern("pan", pattern)).select("rid", "pan")


def tds_calc_mismatches(
    tds: DataFrame,
    rates: Mapping[str, Decimal] = V.TDS_PAYMENT_RATES,
    tolerance: Decimal = V.MONEY_TOLERANCE,
) -> DataFrame:
    return tds.select(
        "rid", _expected(F.col("payment_amount"), rates).alias("calculated"),
        F.col("tds_amount").alias("actual"),
    ).filter(exceeds(F.col("calculated") - F.col("actual"), tolerance))


def tds_issues(
    tds: DataFrame,
    rates: Mapping[str, Decimal] = V.TDS_PAYMENT_RATES,
    tolerance: Decimal = V.MONEY_TOLERANCE,
    pattern: str = V.PAN_PATTERN,
) -> DataFrame:
    key = F.col("rid").alias("key")
    return issue_rows(tds, [key], list(_checks(rates, tolerance, pattern)))


def tds_group_check(
    tds: DataFrame,
    rates: Mapping[str, Decimal] = V.TDS_GROUP_RATES,
    base: str = "tds_amount",
    tolerance: Decimal = V.MONEY_TOLERANCE,
) -> DataFrame:
    """Deducted tax per PAN and section against the rate applied to `base`.

    `base="tds_amount"` compares tax with a share of itself and so reports nearly
    every group; `base="payment_amount"` is the check a tax office would make.
    """
    sums = (
        tds.filter(F.col("pan").isNotNull() & F.col("section_code").isNotNull())
        .groupBy("pan", "section_code")
        .agg(total(base).alias("_base"), total("tds_amount").alias("actual_tds"))
    )
    expected = _expected(F.col("_base"), rates)
    return (
        sums.select("pan", "section_code", expected.alias("expected_tds"), "actual_tds")
        .withColumn("difference", F.col("expected_tds") - F.col("actual_tds"))
        .filter(exceeds(F.col("difference"), tolerance))
    )


def tds_counts(
    tds: DataFrame, rates: Mapping[str, Decimal] = V.TDS_GROUP_RATES,
    tolerance: Decimal = V.MONEY_TOLERANCE,
) -> DataFrame:
    """Sizes of the group check and of the missing challans, from one scan."""
    groups = tds.groupBy("pan", "section_code").agg(
        total("tds_amount").alias("tax"),
        F.count_if(F.col("challan_number").isNull()).alias("without"),
    )
    keyed = F.col("pan").isNotNull() & F.col("section_code").isNotNull()
    off = exceeds(_expected(F.col("tax"), rates) - F.col("tax"), tolerance)
    return groups.agg(
        F.count_if(keyed & off).alias("deduction_mismatches"),
        F.coalesce(F.sum("without"), F.lit(0)).alias("missing_challans"),
    )


def tds_missing_challan(tds: DataFrame) -> DataFrame:
    return tds.filter(F.col("challan_number").isNull()).select(
        "rid", "pan", "section_code", "tds_amount"
    )


def tds_missing_identifiers(tds: DataFrame) -> DataFrame:
    """PAN and challan are mandatory: null or blank in either is reported."""
    return tds.filter(is_blank("pan") | is_blank("challan_number")).select(
        "rid", "pan", "challan_number", "tds_amount"
    )


def _side_of_match(df: DataFrame, is_tds: bool) -> DataFrame:
    return df.filter(F.col("challan_number").isNotNull()).select(
        "challan_number", "tds_amount", "transaction_date", F.lit(is_tds).alias("is_tds")
    )


def traces_match(tds: DataFrame, traces: DataFrame) -> DataFrame:
    """Per challan: matched, amount_mismatch, date_mismatch, amount_and_date_mismatch,
    missing_in_traces or missing_in_tds.

    A challan used by several rows is compared by its total amount and by its first
    and last date. One aggregate over both tables: linear whatever the repetition.
    """
    ours, theirs = F.col("is_tds"), ~F.col("is_tds")
    sides = {"o": ours, "t": theirs}
    measures = []
    for name, on_side in sides.items():
        day = F.when(on_side, F.col("transaction_date"))
        measures += [
            F.count_if(on_side).alias(f"{name}_rows"),
            total(F.when(on_side, F.col("tds_amount"))).alias(f"{name}_amount"),
            F.min(day).alias(f"{name}_from"),
            F.max(day).alias(f"{name}_to"),
        ]
    per_challan = (
        _side_of_match(tds, True)
        .unionByName(_side_of_match(traces, False))
        .groupBy("challan_number")
        .agg(*measures)
    )
    amounts = F.col("o_amount") == F.col("t_amount")
    dates = F.col("o_from").eqNullSafe(F.col("t_from")) & F.col("o_to").eqNullSafe(F.col("t_to"))
    status = (
        F.when(F.col("t_rows") == 0, "missing_in_traces")
        .when(F.col("o_rows") == 0, "missing_in_tds")
        .when(amounts & dates, "matched")
        .when(dates, "amount_mismatch")
        .when(amounts, "date_mismatch")
        .otherwise("amount_and_date_mismatch")
    )
    return per_challan.select("challan_number", status.alias("match_status"))
