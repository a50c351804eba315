"""Joins and comparisons that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks.sources.shared import dropped_shuffles

_HASH = "_join_hash"
COPIES = 100_000  # of one row that a task writes out
REPEATED = 100_000  # digests of equal rows that are looked for one by one, at most


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner"
) -> DataFrame:
    """Join many fact rows to a lookup that has at most one row per key.

    Adaptive execution can split a hot fact key over many tasks, but only where
    both inputs of the join come straight from a shuffle. A lookup made by an
    aggregate on the same key would be joined in place instead. A hash of the key
    as an extra join column makes Spark shuffle the (small) lookup once more and
    so keeps the split possible. Below the broadcast size nothing is shuffled.
    `how` may be inner, left, left_semi or left_anti: all can split the fact side.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot split a hot key in a {how} join")
    left, right = dict(facts.dtypes), dict(lookup.dtypes)
    for c in on:
        if left[c] != right[c]:
            raise TypeError(f"join column {c}: {left[c]} and {right[c]}")
    key_hash = F.xxhash64(*[F.col(c) for c in on])
    return (
        facts.withColumn(_HASH, key_hash)
        .join(lookup.withColumn(_HASH, key_hash), [*on, _HASH], how)
        .drop(_HASH)
    )


def key_presence(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct key of either side, with in_left and in_right.

    A tagged union under one aggregate: a key is reduced to two flags before the
    shuffle, so no key is hot and no pair of rows is ever formed.
    """
    def tagged(df: DataFrame, is_left: bool) -> DataFrame:
        return df.select(
            *keys, F.lit(is_left).alias("in_left"), F.lit(not is_left).alias("in_right")
        )

    return (
        tagged(left, True)
        .unionByName(tagged(right, False))
        .groupBy(*keys)
        .agg(F.bool_or("in_left").alias("in_left"), F.bool_or("in_right").alias("in_right"))
    )


def first_per_key(
    df: DataFrame, keys: list[str], order: Column, columns: list[str]
) -> DataFrame:
    """The row with the smallest `order` per key, by partial aggregation."""
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*columns), order).alias("_first"))
        .select(*keys, *[F.col("_first")[c].alias(c) for c in columns])
    )


def counted_rows(df: DataFrame, columns: list[str], count: str) -> DataFrame:
    """Different rows of `columns` with how often each occurs; combines on the map side."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count))


def written_out(rows: DataFrame, count: str, number: str, most: int = COPIES) -> DataFrame:
    """Every row as often as its `count` says, with the numbers 1, 2, ... in place of it.

    A row with more than `most` copies is written out by many tasks.
    """
    columns = [c for c in rows.columns if c != count]
    n, part = F.col(count), F.col("_part")
    few = rows.filter(n <= most).select(
        *columns, F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias(number))
    parts = rows.filter(n > most).select(
        *columns, count,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(`{count}` - 1) div {most}")))
        .alias("_part"))
    # A number of tasks, as few rows that write out many would be put together by their size.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(tasks, F.xxhash64(*columns), part)
    many = dealt.select(
        *columns,
        F.explode(F.sequence(part * most + 1, F.least(n, (part + 1) * most))).alias(number))
    return few.unionByName(many)


def numbered_copies(
    df: DataFrame, columns: list[str], number: str, most: int = COPIES
) -> DataFrame:
    """Every row of `columns`, with the numbers 1, 2, ... among the rows equal to it.

    Equal rows cannot be told apart, so they are not ranked but counted, and written out.
    """
    return written_out(counted_rows(df, columns, "_copies"), "_copies", number, most)


def numbered_few_copies(
    df: DataFrame, columns: list[str], number: str, few: int = REPEATED
) -> DataFrame:
    """`numbered_copies` for rows that seldom repeat: only those that do are shuffled.

    A job looks for digests that occur twice, eight bytes a row. Rows of another digest are
    the only ones of their kind. Above `few` repeated digests, all rows are counted.
    """
    digest = F.xxhash64(*columns)
    repeated = counted_rows(df.select(digest.alias("_digest")), ["_digest"], "_rows").filter(
        F.col("_rows") > 1).select("_digest")
    with dropped_shuffles(df.sparkSession):
        found = repeated.limit(few + 1).count()
    if found > few:
        return numbered_copies(df, columns, number)
    one = F.lit(1).cast("bigint").alias(number)
    if not found:
        return df.select(*columns, one)
    rows, known = df.select(*columns, digest.alias("_digest")), F.broadcast(repeated)
    return rows.join(known, "_digest", "left_anti").select(*columns, one).unionByName(
        numbered_copies(rows.join(known, "_digest", "left_semi"), columns, number))
