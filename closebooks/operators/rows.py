"""Rows as text or records, and ordered samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_documents(df: DataFrame, key: str = "rid") -> DataFrame:
    """key, document: "column: value, ..." over all columns but the key; null is nan."""
    cells = [
        F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("nan")))
        for c in df.columns if c != key
    ]
    return df.select(F.col(key), F.concat_ws(", ", *cells).alias("document"))


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, null fields kept."""
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.select(record.alias("record"))


def sample_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)
