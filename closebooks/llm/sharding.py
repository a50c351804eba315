"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row starts at the root and descends. At each node every child draws
-ln(u) / weight, where u is a uniform hash of the row's id and the child's name, and the
smallest draw wins. A child's draw depends on nothing but the id, its name and its weight,
so a change of weights moves rows only into or out of the subtrees whose weights changed.
A shard added as a region of its own takes rows only into itself.

Defined cases: a row without doc_id is drawn by its text (both null: one fixed draw);
a null text has size 1 and the checksum of the empty text; repeated rows share a shard and
get slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closebooks.operators.skew import counted_rows, written_out

#: Slots are counted in so many parts a shard, so that no task numbers a whole shard.
SLOT_PARTS = 4096


@dataclass(frozen=True)
class Node:
    """A shard (with its number) or a region or rack (with children)."""

    name: str
    weight: float = 0.0
    shard: int = -1
    children: tuple[Node, ...] = ()

    def total(self) -> float:
        return sum(c.total() for c in self.children) if self.children else self.weight


def tree(weights: list[float], racks: int = 2, shards: int = 2) -> Node:
    """Shards 0.. with these weights, `shards` to a rack and `racks` to a region."""
    leaves = [Node(f"shard{i}", w, i) for i, w in enumerate(weights)]
    for level, size in (("rack", shards), ("region", racks)):
        leaves = [
            Node(f"{level}{k // size}", children=tuple(leaves[k:k + size]))
            for k in range(0, len(leaves), size)
        ]
    return Node("root", children=tuple(leaves))


def grown(root: Node, weight: float, shard: int) -> Node:
    """The tree with one more shard, in a region of its own."""
    leaf = Node(f"shard{shard}", weight, shard)
    region = Node(f"region+{shard}", children=(Node(f"rack+{shard}", children=(leaf,)),))
    return Node(root.name, children=(*root.children, region))


def _draw(key: Column, node: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(node.total()))


def shard_of(key: Column, node: Node) -> Column:
    """The shard that a key reaches by descending from a node."""
    alive = [c for c in node.children if c.total() > 0]
    if not node.children:
        return F.lit(node.shard)
    if len(alive) == 1:
        return shard_of(key, alive[0])
    if not alive:
        raise ValueError(f"no weight below {node.name}")
    draws = F.least(*(F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child"))
                      for i, c in enumerate(alive)))
    # A one-element array binds the winner to a variable, so it is drawn once a level.
    return F.transform(F.array(draws["child"]), lambda won: _chosen(key, alive, won))[0]


def _chosen(key: Column, alive: list[Node], won: Column) -> Column:
    out = shard_of(key, alive[-1])
    for i in range(len(alive) - 2, -1, -1):
        out = F.when(won == i, shard_of(key, alive[i])).otherwise(out)
    return out


def slots(rows: DataFrame, group: str, part: str, order: list[str]) -> DataFrame:
    """Column `slot`: gapless numbers from 0 within each value of `group`.

    Equal rows are counted first, and take a run of numbers together; rows that repeat without
    end so are no task's work. Rows are numbered within (group, part), and the counts of the
    parts before are added. The table of counts has one row per group and part: broadcast, as
    both are bounded.
    """
    counted = counted_rows(rows, rows.columns, "copies")
    counts = counted.groupBy(group, part).agg(F.sum("copies").alias("part_rows"))
    ahead = Window.unboundedPreceding, -1
    before = F.sum("part_rows").over(Window.partitionBy(group).orderBy(part).rowsBetween(*ahead))
    starts = counts.select(group, part, F.coalesce(before, F.lit(0)).alias("start"))
    within = F.sum("copies").over(Window.partitionBy(group, part).orderBy(*order)
                                  .rowsBetween(*ahead))
    placed = counted.withColumn("nth", F.coalesce(within, F.lit(0))).join(
        F.broadcast(starts), [group, part])
    return written_out(placed, "copies", "copy").withColumn(
        "slot", (F.col("start") + F.col("nth") + F.col("copy") - 1).cast("long")
    ).drop("start", "nth", "copy")


def sharded(docs: DataFrame, root: Node, bigger: Node) -> DataFrame:
    """Every document's size, checksum, shard and slot, and its shard in a bigger tree."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, root).cast("int").alias("shard"),
        shard_of(key, bigger).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(SLOT_PARTS)).cast("int").alias("part"),
    )
    return slots(rows, "shard", "part", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
