"""Mixing sources to target weights by the cube method.

Each source has a target of words. A document is taken floor(m) times, and once more with
probability frac(m), where m is its source's target over its source's size (3 at most).
The cube method turns these probabilities into 0 or 1: three undecided documents at a time
move along the direction that leaves their words and their number unchanged, until one of
them lands on 0 or 1. At most two documents of a group stay undecided. Groups are blocks of
a source, cut by a hash; what they leave is grouped again, until a source has one group;
its last two documents are the landing problem, solved by the outcome nearest in words,
where one document of that group may be turned over as well.

Defined cases: a null text has no words, is kept whole in the counts, and taken 0; the null
source is a source, the last one; repeated rows are documents of their own; without any
words all targets are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closebooks.llm.common import WORD, stored, word_count
from closebooks.operators.skew import numbered_copies

MOST = 3  # no document is taken more often
BLOCK = 1000  # documents of a source that one group decides on, on average
TINY = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per source: number, rows, size and target.

    The targets are least(MOST * size, level * weight) with one level for all, the one at
    which they add up to all words. The table has one row per source.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    cycle = F.array(*(F.lit(w) for w in weights))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("src", nth).withColumn(
        "weight", F.element_at(cycle, (F.col("src") % len(weights) + 1).cast("int")))
    cap = (MOST * F.col("source_size")).cast("double")
    order = Window.orderBy((cap / F.col("weight")), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", left / share)
    fits = F.when(F.col("level") <= cap / F.col("weight"), F.col("level"))
    return level.withColumn("level", F.max(fits).over(everything)).select(
        "source", "src", "source_rows", "source_size",
        F.least(cap, F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _decide(size: np.ndarray, chance: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Flight phase over the rows in order; all but two of them end at 0 or 1."""
    p, z, u = chance.tolist(), size.tolist(), luck.tolist()
    pool: list[int] = []
    for k in range(len(p)):
        if p[k] <= TINY or p[k] >= 1 - TINY:
            p[k] = float(round(p[k]))
            continue
        pool.append(k)
        while len(pool) == 3:
            a, b, c = pool
            d = [z[b] - z[c], z[c] - z[a], z[a] - z[b]]
            if not any(d):
                d = [1, -1, 0]
            up = down = math.inf
            for i, x in zip(pool, d, strict=True):
                if x > 0:
                    up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
                elif x < 0:
                    up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
            step = up if u[k] * (up + down) < down else -down
            u[k] = (u[k] * 7919.0 + 0.5) % 1.0
            for i, x in zip(pool, d, strict=True):
                p[i] += step * x
                if p[i] <= TINY or p[i] >= 1 - TINY:
                    p[i] = float(round(p[i]))
            pool = [i for i in pool if 0 < p[i] < 1]
    return np.array(p)


def _land(size: np.ndarray, p: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The undecided rows' outcome, with one decided row turned over, nearest in words.

    free: rows that had a chance; only these may be turned over.
    """
    open_rows = np.flatnonzero((p > 0) & (p < 1))
    turn = np.flatnonzero(free & ((p == 0) | (p == 1)))
    change = np.append(np.where(p[turn] == 0, size[turn], -size[turn]), 0)  # the last: none
    best, out = math.inf, p
    for bits in range(1 << len(open_rows)):
        off = sum(((bits >> j & 1) - p[i]) * size[i] for j, i in enumerate(open_rows))
        error = np.abs(change + off)
        k = int(np.argmin(error))
        if error[k] < best:
            best, out = error[k], p.copy()
            for j, i in enumerate(open_rows):
                out[i] = bits >> j & 1
            if k < len(turn):
                out[turn[k]] = 1 - out[turn[k]]
    return out


def _group(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: the two that stay undecided are then short ones.
        rows = rows.sort_values(["size", "rank", "doc_id"], ascending=[False, True, True],
                                kind="stable", ignore_index=True)
        luck = (rows["rank"].to_numpy().astype(np.uint64) >> np.uint64(11)) / float(1 << 53)
        size = rows["size"].to_numpy()
        chance = rows["chance"].to_numpy()
        p = _decide(size, chance, luck)
        rows["chance"] = _land(size, p, (chance > 0) & (chance < 1)) if last else p
        return rows

    return run


def mixed(docs: DataFrame) -> DataFrame:
    """Every document with its size, its source's size and target, copies and words taken."""
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")),
                   "mix-sizes")
    goal = stored(targets(sizes), "mix-targets")
    # Rows alike are told apart by a number, so that they fall into different blocks.
    sizes = numbered_copies(sizes, ["doc_id", "source", "size"], "nth")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sizes.join(goal, sizes["source"].eqNullSafe(goal["source"]))
        .drop(goal["source"])
        .withColumn("base", F.floor(share).cast("int"))
        .withColumn("chance", share - F.floor(share))
        .withColumn("rank", F.xxhash64("doc_id", "size", "nth", F.lit("mix")))
        .withColumn("block", F.pmod(
            F.xxhash64("doc_id", "size", "nth", F.lit("block")),
            F.ceil(F.col("source_rows") / BLOCK)).cast("long"))
    )
    keep = ["doc_id", "source", "size", "source_size", "target", "base", "chance", "rank",
            "src", "block"]
    rows = rows.select(*keep)
    blocks = goal.agg(F.max(F.ceil(F.col("source_rows") / BLOCK))).head()[0] or 1
    undecided = (F.col("chance") > 0) & (F.col("chance") < 1)
    parts = []
    while True:
        last = blocks <= 1
        done = rows.groupBy("src", "block").applyInPandas(_group(last), rows.schema)
        if last:
            parts.append(done)
            break
        done = stored(done, "mix-level")
        parts.append(done.where(~undecided))
        # Two rows a block stay at most; so many blocks make a group of the next level.
        fan = BLOCK // 2
        blocks = math.ceil(blocks / fan)
        rows = done.where(undecided).withColumn("block", F.floor(F.col("block") / fan))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    copies = F.col("base") + F.col("chance").cast("int")
    return out.select(
        "doc_id", "size", "source_size", "target",
        (copies * F.col("size")).cast("long").alias("taken"),
        "source", copies.alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, all its columns unchanged.

    Documents without words are no part of the balance and stay once.
    """
    id_keys = ["doc_id", "source", "size"]
    plan = mixed(docs).groupBy(*(F.col(c).alias(f"of_{c}") for c in id_keys)).agg(
        F.min("copies").alias("least"), F.sum("copies").alias("sum"), F.count("copies").alias("n"))
    # A text without words is known by its first word: words are counted in the others alone.
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # The row is packed, so that no column of the caller's meets one of these names.
    rows = docs.where(worded).select(
        F.struct(*docs.columns).alias("row"), "doc_id", "source",
        word_count(F.col("text")).alias("size"))
    nth = F.row_number().over(Window.partitionBy(*id_keys).orderBy("row.text"))
    same = [rows[c].eqNullSafe(plan[f"of_{c}"]) for c in id_keys]
    # Rows alike in id, source and size differ by one copy at most: the first ones get more.
    more = F.col("nth") <= F.col("sum") - F.col("n") * F.col("least")
    times = F.col("least") + more.cast("int")
    return (
        rows.withColumn("nth", nth).join(plan, same[0] & same[1] & same[2])
        .select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
        .select("row.*").unionByName(docs.where(~worded))
    )
