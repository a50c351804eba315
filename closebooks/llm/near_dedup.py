"""Near-duplicate documents: MinHash, banding, signature check, exact confirmation.

1. A document's set of word shingles gives MINIMA universal-hash minima. Equal sets are one
   node from here on, so exact copies cost nothing further.
2. BANDS bands of minima put nodes into buckets. Two sets of similarity 0.8 share no bucket
   with probability (1 - 0.8 ** 4) ** 32 < 5e-8.
3. Inside a bucket, nodes whose signatures agree are joined by a search that visits each node
   once and leaves a spanning forest, not all pairs. Large buckets are cut into blocks, each
   searched together with the first; of a bucket that this leaves in several components, the
   largest is then searched against the rest, and the rest against itself, block by block.
   The signatures' slack is 4.5 standard deviations.
4. Components of that forest hold every link. Their nodes bring their full sets, and the
   same search, now on exact similarities, leaves a spanning forest of the confirmed links;
   large components are cut into blocks again.
5. Components of the confirmed links are the result.

Defined cases: a text without words (null, empty, white space) has the empty set and is
linked with nothing; a text with fewer words than a shingle is one shingle; rows that repeat
a doc_id are linked by their own texts; a row without doc_id is linked with nothing and has no
component; an empty table gives an empty result; other columns are ignored or, by
`deduplicated`, returned unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks.llm.common import sorted_groups, stored
from closebooks.llm.components import components

BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
PERCENT = 80
SLACK = 0.18  # of a signature's agreement below the wanted similarity
BUCKET_BLOCK = 1024  # nodes
SET_BLOCK = 1 << 20  # shingles of a component's block, on average
WORDS = 300_000  # word hashes that a worker remembers

_random = np.random.default_rng(20)
FACTORS = _random.integers(0, 2**63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 2**63, MINIMA, np.uint64)
WEIGHTS = _random.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_words = _WordHashes()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of k words; fewer words are one run."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    run = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        run = _scramble(run + hashes[i:len(words) - k + 1 + i] * WEIGHTS[i])
    return np.unique(run)


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over the set."""
    least = np.full(MINIMA, 2**32 - 1, np.uint32)
    for at in range(0, len(found), 256):
        part = found[at:at + 256]
        values = (FACTORS[:, None] * part[None, :] + TERMS[:, None]) >> np.uint64(32)
        least = np.minimum(least, values.min(axis=1).astype(np.uint32))
    return least


def name(found: np.ndarray) -> int:
    """The node of a set: a 64-bit hash of it."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def _signatures(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            size, node, bands, light = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_buffer().to_pybytes() if text.is_valid else b"", k)
                size.append(len(found))
                node.append(name(found))
                if not len(found):
                    bands.append(None)
                    light.append(None)
                    continue
                least = minima(found)
                rows = least.reshape(BANDS, ROWS).astype(np.uint64)
                key = turn
                for i in range(ROWS):
                    key = _scramble(key * WEIGHTS[8] + rows[:, i])
                bands.append(key.view(np.int64))
                light.append((least & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(node, pa.int64()),
                 batch.column(2), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(light, pa.binary())],
                names=["doc_id", "n", "node", "mark", "bands", "light"])

    return run


def _forest(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest; near(i, others) tells which others are linked with i."""
    edges, left = [], np.arange(count)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            linked = near(at, left)
            if linked.any():
                new = left[linked]
                edges += [(at, int(x)) for x in new]
                queue += new.tolist()
                left = left[~linked]
    return edges


def _agree(size: np.ndarray, light: np.ndarray, at: int, others: np.ndarray) -> np.ndarray:
    """Whether sizes and signatures allow the wanted similarity."""
    a, b = size[at], size[others]
    fits = 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
    if fits.any():
        alike = (light[others[fits]] == light[at]).sum(axis=1)
        fits[fits] = alike >= MINIMA * (PERCENT / 100 - SLACK)
    return fits


def _light(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("light").to_pylist()), np.uint8).reshape(-1, MINIMA)


def _edge_batch(u: list[int], v: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _search_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for _, table in sorted_groups(batches, 3):
        if table.num_rows < 2:
            continue
        node, size = table.column("node").to_numpy(), table.column("n").to_numpy()
        light = _light(table)
        for a, b in _forest(len(node), lambda i, left: _agree(size, light, i, left)):  # noqa: B023
            u.append(int(node[a]))
            v.append(int(node[b]))
        if len(u) > 50_000:
            yield _edge_batch(u, v)
            u, v = [], []
    yield _edge_batch(u, v)


def _search_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, table in sorted_groups(batches, 3):
        if table.num_rows < 2:
            continue
        node, light = table.column("node").to_numpy(), _light(table)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        size = np.array(list(map(len, sets)))

        def near(i: int, left: np.ndarray) -> np.ndarray:
            fits = _agree(size, light, i, left)  # noqa: B023
            mine = sets[i]  # noqa: B023
            for k in np.flatnonzero(fits):
                other = sets[left[k]]  # noqa: B023
                at = np.searchsorted(mine, other)
                at[at == len(mine)] = 0
                both = int((mine[at] == other).sum())
                fits[k] = 100 * both >= PERCENT * (len(mine) + len(other) - both)
            return fits

        edges = _forest(len(node), near)
        yield _edge_batch([int(node[a]) for a, _ in edges], [int(node[b]) for _, b in edges])


def _with_sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found, own = [], []
            for i, (node, text) in enumerate(zip(
                    batch.column(0).to_pylist(), batch.column(2), strict=True)):
                # Rows of one id are neighbours: of rows that repeat it, one stands for the node.
                x = shingles(text.as_buffer().to_pybytes(), k) if node != last else None
                found.append(x)
                # Where another row repeats the id with another text, that is not the node's.
                if x is not None and name(x) == node:
                    own.append(i)
                    last = node
            batch, found = batch.take(pa.array(own, pa.int64())), [found[i] for i in own]
            light = [(minima(x) & np.uint32(255)).astype(np.uint8).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([x.tobytes() for x in found], pa.binary()),
                 pa.array(light, pa.binary())], names=["node", "group", "set", "light"])

    return run


def _in_blocks(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows sorted into (group, block, block): row of block `own` meets blocks `lo` to `hi`."""
    return (
        rows.withColumn("met", F.explode(F.sequence("lo", "hi")))
        .select("g", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), *keep)
        .repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "node")
    )


def _block(count: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit("block")), F.col(count)).cast("int")


def _by_first(rows: DataFrame, group: str) -> DataFrame:
    """Every block of a group meets the first, which so is the one that is sent often."""
    last = (F.col("blocks") - 1).cast("int")
    return rows.withColumns({"g": F.col(group), "own": _block("blocks")}).withColumns({
        "lo": F.when(F.col("own") == 0, F.least(F.lit(1), last)).otherwise(0),
        "hi": F.when(F.col("own") == 0, last).otherwise(0)})


def _still_open(rows: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """Meetings of the groups that are in several components: g, node, own, lo, hi.

    rows: g, node, weight. The blocks of a group's largest component meet those of the others,
    which meet all blocks.
    """
    placed = rows.join(parts.select(F.col("node").alias("of"), "component"),
                       F.col("node") == F.col("of"), "left").select(
        "g", "node", "weight", F.coalesce("component", "node").alias("part"))
    most = placed.groupBy("g", "part").agg(F.sum("weight").alias("size")).groupBy(
        F.col("g").alias("group")).agg(
        F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("all")).where(
        F.col("all") > F.col("top.size")).select(
        "group", F.col("top.part").alias("largest"),
        F.ceil(F.col("top.size") / block).alias("inner"),
        F.ceil((F.col("all") - F.col("top.size")) / block).alias("outer"))
    inside = F.col("part") == F.col("largest")
    last = (F.col("inner") + F.col("outer") - 1).cast("int")
    return placed.join(most.hint("merge"), F.col("g") == F.col("group")).select(
        "g", "node",
        F.when(inside, _block("inner")).otherwise(F.col("inner").cast("int") + _block("outer"))
        .alias("own"),
        F.when(inside, F.col("inner").cast("int")).otherwise(0).alias("lo"), last.alias("hi"))


def _closed(first: DataFrame, rows: DataFrame, block: int, name: str,
            search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) over the first edges and those that `search` finds in open groups.

    rows: those of groups with several blocks.
    """
    parts = stored(components(first, name), f"{name}-parts")
    still = stored(_still_open(rows, parts, block), f"{name}-open")
    if still.isEmpty():
        return parts
    known = parts.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return stored(components(known.unionByName(search(still)), name), f"{name}-parts")


def signed(docs: DataFrame, words: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", _mark()).mapInArrow(
        _signatures(words),
        "doc_id long, n long, node long, mark long, bands array<long>, light binary")


def _mark() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text").alias("mark")


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """Components of nodes whose signatures agree, over all buckets of two nodes or more."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = stored(
        rows.join(shared.withColumnRenamed("key", "k").hint("merge"), F.col("key") == F.col("k"))
        .select("node", "key", F.ceil(F.col("members") / BUCKET_BLOCK).alias("blocks")),
        "near-members")

    def search(meetings: DataFrame) -> DataFrame:
        signs = nodes.select(F.col("node").alias("of"), "n", "light")
        return _in_blocks(
            meetings.join(signs, F.col("node") == F.col("of")), ["node", "n", "light"]
        ).mapInArrow(_search_buckets, "u long, v long")

    return _closed(
        search(_by_first(members, "key").drop("key", "blocks")),
        members.where("blocks > 1").select(
            F.col("key").alias("g"), "node", F.lit(1).cast("long").alias("weight")),
        BUCKET_BLOCK, "near-candidate", search)


def confirmed_groups(docs: DataFrame, nodes: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """Components of exact links inside the candidate groups (node, component)."""
    wanted = stored(
        groups.join(nodes.select(F.col("node").alias("of"), "n", "first"),
                    F.col("node") == F.col("of"))
        .select("node", "component", "n", "first"), "near-wanted")
    # One document stands for a node.
    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long"), "text")

    def sets(of: DataFrame) -> DataFrame:
        # Sort-merge joins at every size: each moves its rows once, and splits hot keys.
        return texts.join(of.hint("merge"), F.col("doc_id") == F.col("first")).select(
            "node", F.col("component").alias("group"), "text").mapInArrow(
            _with_sets(words), "node long, group long, set binary, light binary")

    def linked_in(rows: DataFrame) -> DataFrame:
        return _in_blocks(rows, ["node", "set", "light"]).mapInArrow(
            _search_sets, "u long, v long")

    size = wanted.groupBy(F.col("component").alias("of")).agg(
        F.ceil(F.sum("n") / SET_BLOCK).alias("blocks"))

    def search(meetings: DataFrame) -> DataFrame:
        met = meetings.select(F.col("node").alias("at"), "g", "own", "lo", "hi")
        again = sets(wanted.join(met.select(F.col("at").alias("x")).hint("merge"),
                                 F.col("node") == F.col("x")))
        return linked_in(again.join(met.hint("merge"), F.col("node") == F.col("at")))

    return _closed(
        linked_in(_by_first(sets(wanted).join(size, F.col("group") == F.col("of")), "group")),
        wanted.join(size.where("blocks > 1"), F.col("component") == F.col("of")).select(
            F.col("component").alias("g"), "node", F.col("n").alias("weight")),
        SET_BLOCK, "near-link", search)


def _placed(docs: DataFrame, words: int) -> DataFrame:
    """Per document: doc_id, n, node, mark; its component's node and least doc_id."""
    signs = stored(signed(docs, words), "near-signatures")
    nodes = stored(
        signs.where("n > 0 and doc_id is not null").groupBy("node").agg(
            F.min("doc_id").alias("first"), F.first("n").alias("n"),
            F.first("bands").alias("bands"), F.first("light").alias("light")),
        "near-nodes")
    parts = confirmed_groups(docs, nodes, candidate_groups(nodes), words)
    member = nodes.select(F.col("node").alias("of"), "first").join(
        parts, F.col("of") == F.col("node"), "left").select(
        "of", "first", F.coalesce("component", "of").alias("component"))
    least = member.groupBy(F.col("component").alias("part")).agg(F.min("first").alias("least"))
    named = member.join(least, F.col("component") == F.col("part")).select("of", "part", "least")
    return signs.join(named, F.col("node") == F.col("of"), "left").select(
        "doc_id", "n", "node", "mark", "part", "least")


def linked(docs: DataFrame, words: int) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return _placed(docs, words).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = 5) -> DataFrame:
    """One document of each component, with all its columns; the one with the least doc_id.

    Rows that share a doc_id are documents of their own where their texts are not linked. Of
    equal rows by doc_id and text one stays; all rows without doc_id stay.
    """
    # A text without words has no component: it is one of its own for each doc_id.
    kept = stored(
        _placed(docs, words).where("doc_id is not null and doc_id = coalesce(least, doc_id)")
        .groupBy(F.col("doc_id").alias("id"), "part")
        .agg(F.min(F.struct("node", "mark")).alias("first"))
        .select("id", F.col("first.mark").alias("kept_mark")).distinct(), "near-kept")
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("of"), _mark(), F.struct(*docs.columns).alias("row"))
    found = rows.join(kept.hint("merge"), (F.col("of") == F.col("id"))
                      & (F.col("mark") == F.col("kept_mark")))
    # Maps have no order; their text has.
    least = F.min_by("row", F.to_json("row")) if "map<" in docs.schema.simpleString() else F.min(
        "row")
    one = found.groupBy("id", "mark").agg(least.alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))
