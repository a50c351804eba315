"""Audit trail over journals, sorted audit listings, and open audit queries."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks import fixed_values as V
from closebooks.functions.exprs import all_of, count_rows
from closebooks.operators.skew import key_presence
from closebooks.schemas import AUDIT_ORDER, TABLE_SCHEMAS, ReadOrder


def audit_log_entries(
    j: DataFrame, entry_id: str | None = None, user: str | None = None,
    action: str | None = None,
) -> DataFrame:
    """A log line per journal row; an empty filter lets everything through.

    The user is the row's entity, or "system" when the journals carry no entity at all.
    """
    who = F.col("entity") if "entity" in j.columns else F.lit("system")
    logs = j.select(
        F.col("entry_date").alias("timestamp"), who.alias("user"),
        F.col("type").alias("action"), "amount", "account", "journal_id",
        F.concat(F.lit("Auto-log for "), F.coalesce("type", F.lit("None")),
                 F.lit(" entry.")).alias("comment"),
    )
    wanted = {"journal_id": entry_id, "user": user, "action": action}
    return logs.filter(all_of([F.col(c) == v for c, v in wanted.items() if v]))


def audit_timeline(logs: DataFrame) -> DataFrame:
    event = F.concat(
        F.coalesce("action", F.lit("None")), F.lit(" by "), F.coalesce("user", F.lit("None"))
    )
    return logs.select("timestamp", event.alias("event"))


def audit_flags(logs: DataFrame, evidence: DataFrame) -> DataFrame:
    """missing_log: nothing was logged; missing_document: no evidence for any of it.

    `evidence` is any table with a journal_id, such as the audit log.
    """
    seen = key_presence(logs.select("journal_id"), evidence.select("journal_id"), ["journal_id"])
    found = F.bool_or("in_left")
    backed = F.bool_or(F.col("in_left") & F.col("in_right") & F.col("journal_id").isNotNull())
    return seen.agg(
        (~F.coalesce(found, F.lit(False))).alias("missing_log"),
        (~F.coalesce(backed, F.lit(False))).alias("missing_document"),
    )


def ordered(df: DataFrame, order: ReadOrder) -> DataFrame:
    """Nulls come first when descending and last when ascending, as in PostgreSQL.

    The row key closes the order, so that one busy day does not fall to one task.
    """
    by = [
        F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_last()
        for c, descending in order.columns
    ]
    return df.orderBy(*by, F.col(order.key).asc_nulls_last())


def audit_sorted(df: DataFrame, table: str) -> DataFrame:
    """The columns of a stored table, in the order an auditor reads them."""
    return ordered(df.select(*TABLE_SCHEMAS[table].names), AUDIT_ORDER[table])


def audit_stale_pending(
    a: DataFrame, as_of: date, days: int = V.STALE_QUERY_DAYS
) -> DataFrame:
    age = F.datediff(F.lit(as_of), F.col("transaction_date"))
    return a.filter((F.col("audit_status") == "PENDING") & (age > days)).select(
        "id", "journal_id", age.alias("age_days")
    )


def audit_missing_record(j: DataFrame, a: DataFrame) -> DataFrame:
    """Journals without any audit record."""
    def ids(df: DataFrame) -> DataFrame:
        return df.select("journal_id").filter(F.col("journal_id").isNotNull())

    seen = key_presence(ids(j), ids(a), ["journal_id"])
    return seen.filter(F.col("in_left") & ~F.col("in_right")).select("journal_id")


def source_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """source, n, has_data: one row per table, each counted by its own scan."""
    def one(name: str, df: DataFrame) -> DataFrame:
        n: Column = count_rows()
        return df.agg(n.alias("n")).select(F.lit(name).alias("source"), "n")

    counts = None
    for name, df in tables.items():
        counts = one(name, df) if counts is None else counts.unionByName(one(name, df))
    if counts is None:
        raise ValueError("no tables given")
    return counts.withColumn("has_data", F.col("n") > 0)


def missing_sources(tables: Mapping[str, DataFrame]) -> DataFrame:
    return source_counts(tables).filter(~F.col("has_data")).select("source")


def total_entries(tables: Mapping[str, DataFrame]) -> DataFrame:
    return source_counts(tables).agg(F.sum("n").alias("total_entries"))
