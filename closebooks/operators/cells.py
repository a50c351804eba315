"""Report sections that share one pass over their table.

The rows are summed per combination of the report's keys; every section is then a sum over
these cells. A section leaves out the rows without its key; the cells know how many.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells_of(df: DataFrame, keys: Mapping[str, Column], measures: list[Column]) -> DataFrame:
    """Measures per combination of the keys; a null key is a key. Measures must add up."""
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*measures)


def _sums(names: list[str]) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def section(cells: DataFrame, key: str, names: list[str], label: str | None = None) -> DataFrame:
    """Measures per value of one key, rows without it left out."""
    known = cells.filter(F.col(key).isNotNull())
    return known.groupBy(F.col(key).alias(label or key)).agg(*_sums(names))


def overall(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row of measures over all rows; zeros over none."""
    zero = {f.name: F.lit(0).cast(f.dataType) for f in cells.schema.fields}
    return cells.agg(*[F.coalesce(F.sum(n), zero[n]).alias(n) for n in names])


def left_out(cells: DataFrame, keys: list[str], rows: str, amount: str) -> DataFrame:
    """section, row_count, amount: what each key's section leaves out, zero included."""
    sums = []
    for k in keys:
        gone = F.col(k).isNull()
        sums += [F.coalesce(F.sum(F.when(gone, F.col(rows))), F.lit(0)).alias(f"n_{k}"),
                 F.coalesce(F.sum(F.when(gone, F.col(amount))),
                            F.lit(0).cast(cells.schema[amount].dataType)).alias(f"a_{k}")]
    out = [F.struct(F.lit(k).alias("section"), F.col(f"n_{k}").cast("bigint").alias("row_count"),
                    F.col(f"a_{k}").alias("amount")) for k in keys]
    return cells.agg(*sums).select(F.inline(F.array(*out)))
