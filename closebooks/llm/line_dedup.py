"""Line dedup by probing a sharded minimal perfect hash.

1. Every document gives the distinct keys of its lines as 128-bit hashes; an aggregate keeps
   the keys of two documents or more, with their count and smallest doc_id.
2. The kept keys are cut into shards by hash. Each shard becomes a minimal perfect hash
   (levels of bit arrays; a key's index is the rank of its bit) that indexes three flat
   arrays: fingerprint, document count, owner.
3. Documents send (hash, doc_id) probes to the shards. A probe whose fingerprint is found
   and whose owner is another document comes back as a drop; all others end there. Shards
   with many probes are repeated over several tasks, in proportion to the probes their
   count arrays announce, so a line in a third of all documents has no task of its own.
4. The drops of a document meet its text, which is split again.

Defined cases: a null or empty text is one empty line; a row without doc_id keeps all its
lines and counts for none; rows that share a doc_id are one document; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebooks.llm.common import SPACE_BYTES, stored

LEAST_CHARS = 10
KEYS_PER_SHARD = 8192  # on average
PROBES_PER_TASK = 200_000
HOT_SHARDS = 1024  # shards repeated over tasks, at most: a task's share grows beyond that
GAMMA = 2  # bits a key in a level


def line_keys(line: bytes) -> bytes | None:
    """The 16-byte hash of a line's key, or None for a key that is too short to count."""
    key = line.strip(SPACE_BYTES)
    if len(key) < LEAST_CHARS:
        return None
    if not key.isascii() and len(key.decode("utf-8", "replace")) < LEAST_CHARS:
        return None
    return xxhash.xxh3_128_digest(key.lower())  # bytes.lower() changes A-Z alone


def _keys_of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids: list[int] = []
        found: list[bytes] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys = set(map(line_keys, text.as_buffer().to_pybytes().split(b"\n")))
            keys.discard(None)
            found += keys
            ids += [doc_id] * len(keys)
        halves = np.frombuffer(b"".join(found), dtype=">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
            names=["doc_id", "h1", "h2"])


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finalizer, another one for each level."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key owns the first bit that no other key of its level hits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sums = []
        total = 0
        for bits in levels:
            self.sums.append(total + np.cumsum(bits) - 1)
            total += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            at = _mix(keys, len(levels)) % np.uint64(max(2, GAMMA * len(keys)))
            alone = np.bincount(at.astype(np.int64), minlength=max(2, GAMMA * len(keys))) == 1
            levels.append(alone)
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or some other key's index for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, (bits, sums) in enumerate(zip(self.levels, self.sums, strict=True)):
            at = (_mix(keys[todo], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = sums[at[hit]]
            todo = todo[~hit]
        return out

    def dump(self) -> bytes:
        head = struct.pack(f"<{len(self.levels) + 1}q", len(self.levels), *map(len, self.levels))
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = struct.unpack_from("<q", data)[0]
        sizes, at, levels = struct.unpack_from(f"<{n}q", data, 8), 8 * (n + 1), []
        for size in sizes:
            packed = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    hashes = PerfectHash.build(rows["h1"].to_numpy())
    order = np.argsort(hashes.index(rows["h1"].to_numpy()))
    arrays = [rows[c].to_numpy(np.int64)[order].tobytes() for c in ("h2", "docs", "owner")]
    return pd.DataFrame({
        "shard": rows["shard"].iloc[:1], "index": [hashes.dump()], "prints": [arrays[0]],
        "counts": [arrays[1]], "owners": [arrays[2]], "probes": [int(rows["docs"].sum())]})


SHARD = ("shard long, index binary, prints binary, counts binary, owners binary, probes long")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, salt), the shard's arrays before its probes."""
    now, hashes, prints, owners = None, None, None, None
    for batch in batches:
        shard, salt = (batch.column(i).to_numpy() for i in (0, 1))
        index = batch.column(5)
        kept_ids, kept_h1, kept_h2 = [], [], []
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(shard)], strict=True):
            if hi == lo:
                continue
            first = lo
            if index[int(lo)].is_valid:
                now = (shard[lo], salt[lo])
                hashes = PerfectHash.load(index[int(lo)].as_py())
                prints, owners = (
                    np.frombuffer(batch.column(c)[int(lo)].as_py(), np.int64) for c in (6, 7))
                first += 1
            if first == hi or now != (shard[lo], salt[lo]):
                continue
            doc_id, h1, h2 = (
                batch.column(c).slice(first, hi - first).to_numpy() for c in (2, 3, 4))
            at = hashes.index(h1)
            drop = (at >= 0) & (prints[at] == h2) & (owners[at] != doc_id)
            kept_ids.append(doc_id[drop])
            kept_h1.append(h1[drop])
            kept_h2.append(h2[drop])
        if kept_ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x), pa.int64()) for x in (kept_ids, kept_h1, kept_h2)],
                names=["doc_id", "h1", "h2"])


def kept_text(text: bytes, drop: set[bytes]) -> tuple[bytes, int, int]:
    """Text without the dropped keys' lines, number of lines, number of dropped lines."""
    lines = text.split(b"\n")
    if not drop:
        return text, len(lines), 0
    kept = [x for x in lines if line_keys(x) not in drop]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, drop in zip(batch.column("text"), batch.column("drops"), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            gone = {x["h1"].to_bytes(8, "big", signed=True) + x["h2"].to_bytes(8, "big", signed=True)
                    for x in drop.as_py() or ()}
            new, n, m = kept_text(data, gone)
            texts.append(new)
            lines.append(n)
            dropped.append(m)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string()),
             pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            names=["row", "kept_text", "n_lines", "n_dropped"])


def shared_line_index(keys: DataFrame) -> DataFrame:
    """One row a shard: the perfect hash and its arrays, from (doc_id, h1, h2) rows."""
    repeated = stored(
        keys.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"),
            F.count(F.lit(1)).alias("docs"))
        .where("owner < last").drop("last"), "line-keys")
    shards = max(1, -(-repeated.count() // KEYS_PER_SHARD))
    return stored(
        repeated.withColumn("shard", _shard(F.col("h1"), shards))
        .groupBy("shard").applyInPandas(_build_shard, SHARD), "line-index"), shards


def _shard(h1: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(h1), F.lit(shards)).cast("long")


def line_drops(docs: DataFrame) -> DataFrame:
    """Per document that loses lines: doc_id and the keys it loses."""
    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long"), "text")
    keys = texts.mapInArrow(_keys_of_docs, "doc_id long, h1 long, h2 long")
    index, shards = shared_line_index(keys)
    total = index.agg(F.sum("probes")).head()[0] or 0
    share = max(PROBES_PER_TASK, total // HOT_SHARDS)
    salts = F.ceil(F.col("probes") / share).cast("int")
    # Fewer than HOT_SHARDS shards can have more probes than the share: a bounded broadcast.
    hot = index.where(F.col("probes") > share).select(F.col("shard").alias("hot"), salts.alias("n"))
    probes = keys.withColumn("shard", _shard(F.col("h1"), shards)).join(
        F.broadcast(hot), F.col("shard") == F.col("hot"), "left").select(
        "shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("n", F.lit(1))).cast("int").alias("salt"),
        "doc_id", "h1", "h2", F.lit(None).cast("binary").alias("index"),
        F.lit(None).cast("binary").alias("prints"), F.lit(None).cast("binary").alias("owners"))
    arrays = index.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(
        "shard", "salt", F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"),
        "index", "prints", "owners")
    drops = (
        probes.unionByName(arrays).repartition("shard", "salt")
        .sortWithinPartitions("shard", "salt", F.col("doc_id").asc_nulls_first())
        .mapInArrow(_probe, "doc_id long, h1 long, h2 long")
    )
    return drops.groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def with_kept_lines(docs: DataFrame) -> DataFrame:
    """Each row packed as `row`, with kept_text, n_lines and n_dropped beside it."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    drops = stored(line_drops(docs), "line-drops")
    joined = packed.join(drops, F.col("row.doc_id") == drops["doc_id"], "left").select(
        "row", F.col("row.text").alias("text"), "drops")
    row = packed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        _drop_lines, f"row {row}, kept_text string, n_lines long, n_dropped long")


def line_digest(docs: DataFrame) -> DataFrame:
    """Per document: lines, dropped lines, and the digest of what stays."""
    return with_kept_lines(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with their kept lines as text; all other columns unchanged."""
    kept = with_kept_lines(docs)
    cells = [F.col("kept_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c)
             for c in docs.columns]
    return kept.select(*cells)
