"""Column expressions: money, dates, headers. All run inside generated code."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(15,2)"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_zero() -> Column:
    return F.lit(Decimal("0.00"))


def total(c: str | Column) -> Column:
    """Sum that is 0, not null, over no rows or only nulls."""
    return F.coalesce(F.sum(col_of(c)), F.lit(0).cast(MONEY))


def count_rows() -> Column:
    return F.count(F.lit(1))


def exceeds(x: Column, tolerance: Decimal) -> Column:
    """|x| > tolerance; a null x does not exceed it."""
    return F.coalesce(F.abs(x) > F.lit(tolerance), F.lit(False))


def differs(a: Column, b: Column) -> Column:
    """a != b where any null on either side counts as a difference."""
    return F.coalesce(a != b, F.lit(True))


def fails_pattern(c: str | Column, pattern: str) -> Column:
    """Null counts as a failed match."""
    return ~F.coalesce(col_of(c).rlike(pattern), F.lit(False))


def is_blank(c: str | Column) -> Column:
    return col_of(c).isNull() | (F.trim(col_of(c)) == "")


def contains_any(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    return reduce(or_, [c.contains(w) for w in words])


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_null(df: DataFrame, columns: list[str] | None = None) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in (columns or df.columns)])


def choose(c: Column, table: Mapping[str, object], default: object = None) -> Column:
    """CASE over a small fixed table: a lookup without a join."""
    items = list(table.items())
    out = F.when(c == items[0][0], F.lit(items[0][1]))
    for key, value in items[1:]:
        out = out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def month_text(c: str | Column) -> Column:
    return F.date_format(col_of(c), "yyyy-MM")


def quarter_text(c: str | Column) -> Column:
    d = col_of(c)
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def percent_change(value: Column, previous: Column) -> Column:
    """((value - previous) / previous) * 100; 0 when previous is 0."""
    v, p = value.cast("double"), previous.cast("double")
    return F.when(p == 0, F.lit(0.0)).otherwise((v - p) / p * 100)


def trailing_number(c: str | Column) -> Column:
    """Digits at the end of an identifier as a number, 0 when there are none."""
    digits = F.regexp_extract(col_of(c), r"(\d+)$", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def summed_levels(cells: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums per single key and overall: level (a key's name or "all"), key, measures."""
    by = [F.col(k) for k in keys]
    level = F.when(F.grouping(keys[0]) == 0, keys[0])
    for k in keys[1:]:
        level = level.when(F.grouping(k) == 0, k)
    sums = cells.groupingSets([*[[c] for c in by], []], *by).agg(
        level.otherwise("all").alias("level"), *[F.sum(m).alias(m) for m in measures]
    )
    return (
        sums.withColumn("key", F.coalesce(*keys))
        .filter((F.col("level") == "all") | F.col("key").isNotNull())
        .select("level", "key", *measures)
    )


def money_as_double(df: DataFrame) -> DataFrame:
    """Cast every decimal column to double, the form results are compared in."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.date_format(F.col(f"`{f.name}`"), "yyyy-MM-dd").alias(f.name)
            if isinstance(f.dataType, T.DateType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
