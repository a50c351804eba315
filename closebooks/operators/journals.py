"""Journal batch checks: nulls, duplicates, balance, and keys already stored.

Columns: journal_id, entry_date, account, type (Debit/Credit), amount, entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks.functions.exprs import any_null, count_rows, total, trailing_number
from closebooks.operators.issues import null_field_counts, null_fields
from closebooks.operators.skew import key_presence, lookup_join

FIELDS = ["entry_date", "account", "type", "amount", "entity", "journal_id"]


def journal_null_rows(j: DataFrame) -> DataFrame:
    return j.agg(F.count_if(any_null(j)).alias("null_fields"))


def journal_dropna(j: DataFrame) -> DataFrame:
    return j.na.drop("any")


def _copies(j: DataFrame) -> DataFrame:
    """Each different row once, with its number of copies; nulls equal each other."""
    return j.groupBy(*j.columns).agg(count_rows().alias("_copies"))


def journal_duplicates(j: DataFrame) -> DataFrame:
    """Number of rows equal to an earlier one."""
    extra = F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0))
    return _copies(j).agg(extra.alias("duplicates"))


def _side(type_: str, amount: str | Column = "amount") -> Column:
    value = F.col(amount) if isinstance(amount, str) else amount
    return total(F.when(F.col("type") == type_, value))


def journal_balance(j: DataFrame) -> DataFrame:
    return j.agg(
        _side("Debit").alias("total_debit"), _side("Credit").alias("total_credit")
    ).withColumn("balanced", F.col("total_debit") == F.col("total_credit"))


def journal_balance_by_id(j: DataFrame) -> DataFrame:
    """Journals whose debits and credits differ."""
    return (
        j.filter(F.col("journal_id").isNotNull())
        .groupBy("journal_id")
        .agg(_side("Debit").alias("debit"), _side("Credit").alias("credit"))
        .filter(F.col("debit") != F.col("credit"))
    )


def journal_duplicate_ids(j: DataFrame) -> DataFrame:
    return (
        j.filter(F.col("journal_id").isNotNull())
        .groupBy("journal_id").agg(count_rows().alias("n")).filter(F.col("n") > 1)
    )


def journal_status(j: DataFrame) -> DataFrame:
    """null_fields, balanced, duplicates, status of a batch, from one scan.

    Balance and duplicates look at the rows without nulls. Rows are collapsed to
    (row, copies) first; the three figures are then sums over the collapsed rows.
    """
    whole = ~any_null(j)
    copies = F.col("_copies")
    amount = F.when(whole, F.col("amount") * copies.cast("decimal(18,0)"))
    figures = _copies(j).agg(
        F.coalesce(F.sum(F.when(~whole, copies)), F.lit(0)).alias("null_fields"),
        (_side("Debit", amount) == _side("Credit", amount)).alias("balanced"),
        F.coalesce(F.sum(F.when(whole, copies - 1)), F.lit(0)).alias("duplicates"),
    )
    passed = (F.col("null_fields") == 0) & F.col("balanced") & (F.col("duplicates") == 0)
    return figures.withColumn("status", F.when(passed, "PASS").otherwise("FAIL"))


def journal_missing_fields(j: DataFrame) -> DataFrame:
    """Number of nulls per mandatory field."""
    return null_field_counts(j, FIELDS)


def journal_missing_field_rows(j: DataFrame) -> DataFrame:
    """journal_id, field: one row per empty mandatory cell."""
    return null_fields(j, ["journal_id"], FIELDS)


def _keys(df: DataFrame, key: str, once: bool = True) -> DataFrame:
    keys = df.select(key).filter(F.col(key).isNotNull())
    return keys.distinct() if once else keys


def journal_existing_keys(
    batch: DataFrame, stored: DataFrame, key: str = "journal_id", large: bool = False
) -> DataFrame:
    """Keys of the batch that are stored already.

    The store is filtered by the keys of the batch, not the other way round: a batch of
    ordinary size is broadcast by Spark, and then the store is scanned but not shuffled.
    For a `large` one, the keys of both are shuffled once, by one aggregate.
    """
    if large:
        seen = key_presence(_keys(batch, key, False), _keys(stored, key, False), [key])
        return seen.filter(F.col("in_left") & F.col("in_right")).select(key)
    return lookup_join(stored.select(key), _keys(batch, key), [key], "left_semi").distinct()


def journal_new_rows(batch: DataFrame, stored: DataFrame, key: str = "journal_id") -> DataFrame:
    """Rows of the batch whose key is not stored yet."""
    existing = journal_existing_keys(batch, stored, key)
    return lookup_join(batch, existing, [key], "left_anti")


def read_back(
    batch: DataFrame, stored: DataFrame | None, key: str = "journal_id",
    order: tuple[str, ...] = ("journal_id", "entry_date"), whole: DataFrame | None = None,
) -> DataFrame:
    """Stored rows with a key of the batch, in ascending order, nulls last.

    The remaining columns close the sort order, so equal sort keys can be split. `whole` are
    the rows of the batch as they are stored, if they are not among `stored`: they have
    their own keys, so they are taken without a join. Without other rows, `stored` is None.
    """
    parts = [] if whole is None else [whole.filter(F.col(key).isNotNull())]
    if stored is not None:
        parts.insert(0, lookup_join(stored, _keys(batch, key), [key], "left_semi")
                     .select(*stored.columns))
    found = reduce(DataFrame.unionByName, parts)
    rest = [c for c in found.columns if c not in order]
    return found.orderBy(
        *[F.col(c).asc_nulls_last() for c in [*order, *rest]]
    )


def journal_id_number(j: DataFrame) -> DataFrame:
    return j.select("journal_id", trailing_number("journal_id").alias("number"))
