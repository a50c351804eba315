"""Intercompany reconciliation: open balances, missing and unequal counterparts.

Columns: entity, counterparty, account, amount, journal_id.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks import fixed_values as V
from closebooks.functions.exprs import exceeds, total
from closebooks.operators.skew import lookup_join


def _paired(ic: DataFrame) -> DataFrame:
    return ic.filter(F.col("entity").isNotNull() & F.col("counterparty").isNotNull())


def _per_journal(ic: DataFrame) -> DataFrame:
    """Sums per pair and journal: a busy pair is spread over its journals."""
    return (
        _paired(ic).groupBy("entity", "counterparty", "journal_id")
        .agg(total("amount").alias("amount"))
    )


def interco_mismatches(ic: DataFrame, tolerance: Decimal = V.MONEY_TOLERANCE) -> DataFrame:
    """Pairs whose amounts do not net to zero, with the number of journals involved."""
    return (
        _per_journal(ic).groupBy("entity", "counterparty")
        .agg(F.sum("amount").alias("total_amount"), F.count("journal_id").alias("journals"))
        .filter(exceeds(F.col("total_amount"), tolerance))
    )


def interco_mismatch_journals(
    ic: DataFrame, tolerance: Decimal = V.MONEY_TOLERANCE
) -> DataFrame:
    """The journals behind `interco_mismatches`, one row each, with their share.

    A list per pair would grow without bound in one cell, so it is laid out as rows.
    Both inputs of the join come from the same sums per journal, made once.
    """
    pairs = interco_mismatches(ic, tolerance).select("entity", "counterparty")
    return lookup_join(_per_journal(ic), pairs, ["entity", "counterparty"], "left_semi").select(
        "entity", "counterparty", "journal_id", "amount"
    )


def interco_missing_counterparty(ic: DataFrame) -> DataFrame:
    return ic.filter(F.col("counterparty").isNull()).select("journal_id").distinct()


def _direction() -> tuple[Column, Column, Column, Column]:
    """Unordered pair, and whether a row runs from its first to its second member."""
    low = F.least("entity", "counterparty").alias("low")
    high = F.greatest("entity", "counterparty").alias("high")
    up = (F.col("entity") <= F.col("counterparty")).alias("up")
    down = (F.col("entity") >= F.col("counterparty")).alias("down")
    return low, high, up, down


def interco_missing_counterpart(ic: DataFrame) -> DataFrame:
    """(entity, counterparty, journal) present in one direction only.

    Both directions of a pair fall into one group, where two flags tell them apart:
    one aggregate, no self join.
    """
    rows = _paired(ic).filter(F.col("journal_id").isNotNull())
    seen = (
        rows.select("journal_id", *_direction())
        .groupBy("journal_id", "low", "high")
        .agg(F.bool_or("up").alias("up"), F.bool_or("down").alias("down"))
    )
    up = F.col("up")
    return seen.filter(F.col("up") != F.col("down")).select(
        F.when(up, F.col("low")).otherwise(F.col("high")).alias("entity"),
        F.when(up, F.col("high")).otherwise(F.col("low")).alias("counterparty"),
        "journal_id",
    )


def interco_amount_mismatch(
    ic: DataFrame, tolerance: Decimal = V.COUNTERPART_TOLERANCE
) -> DataFrame:
    """Pairs with entries in both directions whose sums differ by more than `tolerance`.

    Reported from both sides.
    """
    sums = (
        _paired(ic).select(*_direction(), "amount")
        .groupBy("low", "high")
        .agg(
            F.bool_or("up").alias("up"), F.bool_or("down").alias("down"),
            total(F.when(F.col("up"), F.col("amount"))).alias("amount_up"),
            total(F.when(F.col("down"), F.col("amount"))).alias("amount_down"),
        )
        .filter(
            F.col("up") & F.col("down")
            & exceeds(F.col("amount_up") - F.col("amount_down"), tolerance)
        )
    )

    def side(entity: str, counterparty: str, amount: str, counter: str) -> Column:
        return F.struct(
            F.col(entity).alias("entity"), F.col(counterparty).alias("counterparty"),
            F.col(amount).alias("amount"), F.col(counter).alias("counter_amount"),
        )

    return sums.select(
        F.inline(
            F.array(
                side("low", "high", "amount_up", "amount_down"),
                side("high", "low", "amount_down", "amount_up"),
            )
        )
    )


def interco_counts(ic: DataFrame, tolerance: Decimal = V.MONEY_TOLERANCE) -> DataFrame:
    """Number of unbalanced pairs and of journals without a counterparty, from one scan.

    Rows with a counterparty are grouped by pair, those without by journal; rows without
    either are one journal, as in `interco_missing_counterparty`.
    """
    paired = F.col("counterparty").isNotNull()
    groups = ic.groupBy(
        F.when(paired, F.col("entity")).alias("entity"), "counterparty",
        F.when(~paired, F.col("journal_id")).alias("journal"),
    ).agg(total("amount").alias("amount"))
    open_pair = paired & F.col("entity").isNotNull() & exceeds(F.col("amount"), tolerance)
    return groups.agg(
        F.count_if(open_pair).alias("mismatches"),
        F.count_if(~paired).alias("missing_counterparties"),
    )
