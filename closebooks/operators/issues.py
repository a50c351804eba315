"""Several checks over one scan, each giving at most one issue row per input row."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks.functions.exprs import any_null


def _nothing() -> Column:
    return F.lit(None)


@dataclass(frozen=True)
class Check:
    """A named row check with the payload shown when it fails."""

    issue: str
    fails: Column
    expected: Column = field(default_factory=_nothing)
    actual: Column = field(default_factory=_nothing)
    value: Column = field(default_factory=_nothing)


def issue_rows(df: DataFrame, keys: list[str | Column], checks: list[Check]) -> DataFrame:
    """keys + issue, expected, actual, value; rows that pass all checks vanish early.

    Each remaining row is laid out once per check and the passed ones dropped. That
    stays in generated code, unlike thinning the array with a lambda.
    """
    found = [
        F.when(
            c.fails,
            F.struct(
                F.lit(c.issue).alias("issue"),
                c.expected.cast("decimal(20,4)").alias("expected"),
                c.actual.cast("decimal(20,4)").alias("actual"),
                c.value.cast("string").alias("value"),
            ),
        )
        for c in checks
    ]
    failing = df.filter(reduce(or_, [c.fails for c in checks]))
    return failing.select(*keys, F.inline(F.array(*found))).filter(F.col("issue").isNotNull())


def null_fields(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys + field: one row per null cell among `fields`, from one scan."""
    empty = [F.when(F.col(c).isNull(), F.lit(c)) for c in fields]
    some = df.filter(any_null(df, fields))
    return some.select(*keys, F.explode(F.array(*empty)).alias("field")).filter(
        F.col("field").isNotNull()
    )


def null_field_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n: number of nulls per column, all columns in one aggregate."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fields])
    return counts.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in fields])
        )
    )
