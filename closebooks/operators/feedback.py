"""Reviewer feedback texts: pass/fail gate and extraction of listed sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks import fixed_values as V
from closebooks.functions.exprs import contains_any

_SPACE = " \t\r\n\f\v"


def feedback_gate(df: DataFrame, phrases: Sequence[str], text: str = "text") -> DataFrame:
    """Adds `passed`: the text holds any of the phrases, in any case."""
    hit = contains_any(F.lower(F.col(text)), list(phrases))
    return df.withColumn("passed", F.coalesce(hit, F.lit(False)))


def _after(text: Column, marker: str) -> Column:
    """What follows the marker, up to its next occurrence; null without the marker."""
    return F.get(F.split(text, marker), F.lit(1))


def _lines(block: Column) -> Column:
    return F.split(block, "\n")


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE))


def _entry(section: str, line: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), line.alias("line"))


def feedback_sections(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, section, line for mismatched, missing_counterparts and action_items.

    The three lists are built side by side from one pass over the text.
    """
    body = F.col(text)

    def before_end(marker: str) -> Column:
        return F.get(F.split(_after(body, marker), V.FEEDBACK_SECTION_END), F.lit(0))

    def reference(line: Column) -> Column:
        return F.get(F.split(_trim(line), " - "), F.lit(0))

    def listed(section: str, lines: Column, keep, shown) -> Column:
        kept = F.filter(F.coalesce(lines, F.array().cast("array<string>")), keep)
        return F.transform(kept, lambda line: _entry(section, shown(line)))

    def is_action(line: Column) -> Column:
        starts = [_trim(line).startswith(p) for p in V.FEEDBACK_ACTION_PREFIXES]
        return starts[0] | starts[1] | starts[2]

    found = F.concat(
        listed(
            "mismatched_transactions", _lines(before_end(V.FEEDBACK_MISMATCHED)),
            lambda line: line.contains("IC") & line.contains("UNMATCHED"), reference,
        ),
        listed(
            "missing_counterparts", _lines(before_end(V.FEEDBACK_MISSING)),
            lambda line: line.contains("UNMATCHED"), reference,
        ),
        listed("action_items", _lines(_after(body, V.FEEDBACK_ACTIONS)), is_action, _trim),
    )
    return df.select(F.col(key), F.inline(found))
