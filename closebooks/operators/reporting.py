"""Statement totals, variance against the preceding period, and close warnings."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from closebooks import fixed_values as V
from closebooks.functions.exprs import exceeds, percent_change, quarter_text, total
from closebooks.operators import consolidation as con
from closebooks.operators.gst import gst_return_counts
from closebooks.operators.issues import null_fields
from closebooks.operators.journals import journal_status
from closebooks.operators.provisions import provision_overdue, provision_spikes
from closebooks.operators.tds import tds_counts


def statement_totals(ctb: DataFrame) -> DataFrame:
    """Revenue and expenses within profit and loss, assets within the balance sheet."""
    net, account = F.col("net_amount"), F.col("account")

    def part(condition: Column) -> Column:
        return total(F.when(condition, net))

    return ctb.agg(
        part(con.in_profit_loss() & account.contains("Revenue")).alias("revenue"),
        F.abs(part(con.in_profit_loss() & account.contains("Expense"))).alias("expenses"),
        part(con.in_balance_sheet() & account.contains("Asset")).alias("assets"),
    )


def quarterly_values(c: DataFrame) -> DataFrame:
    """entity, period, metric, value: net movement per entity, account and quarter."""
    return (
        c.filter(
            F.col("entity_code").isNotNull() & F.col("account_name").isNotNull()
            & F.col("transaction_date").isNotNull()
        )
        .groupBy(
            F.col("entity_code").alias("entity"),
            quarter_text("transaction_date").alias("period"),
            F.col("account_name").alias("metric"),
        )
        .agg((total("debit_amount") - total("credit_amount")).alias("value"))
    )


def period_variance(f: DataFrame) -> DataFrame:
    """Each value against that of the preceding period of its entity and metric.

    The window runs over one row per period, so its groups stay small.
    """
    series = W.partitionBy("entity", "metric").orderBy("period")
    previous = F.col("previous_value")
    return f.select(
        "entity", "period", "metric", "value",
        F.lag("value").over(series).alias("previous_value"),
    ).select(
        "*", (F.col("value") - previous).alias("variance"),
        percent_change(F.col("value"), previous).alias("variance_percentage"),
    )


def financial_report(c: DataFrame) -> DataFrame:
    """Rows of the stored report: report type, period, entity, metric and variance.

    A percentage too large for its stored type is null rather than the end of the job.
    """
    metric = F.col("metric")
    kind = (
        F.when(con.contains_any(metric, V.BALANCE_SHEET_WORDS), "BS")
        .when(con.contains_any(metric, V.PROFIT_LOSS_WORDS), "PL")
        .when(con.contains_any(metric, V.CASH_FLOW_WORDS), "CF")
    )
    rows = period_variance(quarterly_values(c))
    return rows.select(
        F.concat_ws("|", "entity", "period", "metric").alias("id"),
        kind.alias("report_type"), "period", "entity", "metric",
        *[F.col(n).cast("decimal(15,2)").alias(n)
          for n in ("value", "previous_value", "variance")],
        F.round(F.col("variance_percentage").try_cast("decimal(24,6)"), 2)
        .try_cast("decimal(10,2)").alias("variance_percentage"),
    )


def statement_report(values: DataFrame) -> DataFrame:
    """Revenue, expenses and assets per entity and period against the period before.

    `values` has entity, period, account, net_amount.
    """
    net, account = F.col("net_amount"), F.col("account")
    metrics = {
        "Revenue": total(F.when(con.in_profit_loss() & account.contains("Revenue"), net)),
        "Expenses": F.abs(
            total(F.when(con.in_profit_loss() & account.contains("Expense"), net))
        ),
        "Assets": total(F.when(con.in_balance_sheet() & account.contains("Asset"), net)),
    }
    sums = values.groupBy("entity", "period").agg(*[c.alias(n) for n, c in metrics.items()])
    rows = sums.select(
        "entity", "period",
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics]
            )
        ),
    )
    return period_variance(rows)


def empty_report_fields(f: DataFrame) -> DataFrame:
    """Empty cells of a report as entity, period, metric, field."""
    keys = ["entity", "period", "metric"]
    return null_fields(f, keys, [c for c in f.columns if c not in keys])


def _text(check: str, n: Column, detail: Column) -> Column:
    """Fill {n} and {detail} of the check's text."""
    parts: list[Column] = []
    rest = V.WARNING_TEXTS[check]
    for mark, value in (("{n}", n), ("{detail}", detail)):
        if mark in rest:
            head, rest = rest.split(mark)
            parts += [F.lit(head), F.coalesce(value.cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def _warning(df: DataFrame, figures: dict[str, Column], **details: Column) -> DataFrame:
    """One-row frame of counts to rows check, n, message."""
    rows = [
        F.struct(
            F.lit(check).alias("check"), n.cast("bigint").alias("n"),
            _text(check, n, details.get(check, F.lit(None))).alias("message"),
        )
        for check, n in figures.items()
    ]
    return df.select(F.inline(F.array(*rows)))


def close_checks(
    journals: DataFrame, tb: DataFrame, interco: DataFrame, gst_return: DataFrame,
    tds: DataFrame, provisions: DataFrame, history: DataFrame, as_of: date,
) -> DataFrame:
    """check, n, message for every check of the close, zero counts included.

    All checks of a source are figures of one aggregate, so each source is scanned once;
    the intercompany table and the trial balance, which are compared, share theirs.
    """
    difference = F.col("difference")
    count = F.count(F.lit(1)).alias("n")
    frames = [
        _warning(journal_status(journals), {
            "journal_null_fields": F.col("null_fields"),
            "journal_balance": (~F.col("balanced")).cast("int"),
            "journal_duplicates": F.col("duplicates"),
        }),
        _warning(
            con.ledger_counts(tb, interco),
            {
                "balance_sheet": exceeds(difference, V.MONEY_TOLERANCE).cast("int"),
                "unclassified_accounts": F.col("unclassified"),
                "interco_mismatches": F.col("mismatches"),
                "interco_missing_counterparties": F.col("missing_counterparties"),
            },
            balance_sheet=difference.cast("decimal(38,2)"),
        ),
        _warning(gst_return_counts(gst_return), {
            "gst_mismatches": F.col("mismatches"),
            "gst_missing_invoices": F.col("missing_invoices"),
            "gst_excess_itc": F.col("excess_itc"),
        }),
        _warning(tds_counts(tds), {
            "tds_deduction_mismatches": F.col("deduction_mismatches"),
            "tds_missing_challans": F.col("missing_challans"),
        }),
        _warning(
            provision_overdue(provisions, as_of).agg(count), {"provisions_missing": F.col("n")}
        ),
        _warning(provision_spikes(history).agg(count), {"provision_spikes": F.col("n")}),
    ]
    return reduce(DataFrame.unionByName, frames)


def close_warnings(*args, **kwargs) -> DataFrame:
    """The checks that found something."""
    return close_checks(*args, **kwargs).filter(F.col("n") > 0)
