"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebooks.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("least"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    return both.join(least, both["u"] == least["of"]).where("v > u").select(
        F.col("v").alias("u"), F.least("u", "least").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them; u > v in all edges."""
    least = _least(edges)
    joined = edges.join(least, edges["u"] == least["of"])
    return joined.select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
        F.struct(F.col("u").alias("u"), F.col("least").alias("v")))).alias("e")
    ).select("e.*").where("u > v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).head())


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of all nodes with an edge; a component's name is its least node.

    edges: columns u and v, long. Each round is stored; the rounds end when the edges repeat,
    which are then stars around the least nodes.
    """
    clean = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(clean, f"{name}-edges")
    before, state = None, _state(now)
    while state != before:
        now = stored(small_star(large_star(now)).distinct(), f"{name}-edges")
        before, state = state, _state(now)
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)
