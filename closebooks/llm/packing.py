"""Packing of token sequences: first-fit decreasing in randomised groups of documents.

Documents are encoded (each ends in one more id) and dealt by hash into groups of about
GROUP_BYTES of text; a group is packed by one task, whatever the table's size. There a document
gives whole sequences as long as it has them, and what is left of it goes by falling length into
the first sequence with room, which a tournament tree of the sequences' free room finds in a
step per level. Documents may be cut, so what first-fit leaves open is closed: the emptiest
sequences are taken apart and fill the gaps of the fullest. Gaps below LEAST_PIECE stay, as
padding. One sequence a group stays part-filled; it is cut at powers of two, which need no
padding.

Defined cases: null and empty texts are the closing id alone; a text of any length is encoded
whole; a null id is an id; repeated rows are packed each, those of one input partition in one
group (groups depend on the hash of the row and on its input partition, so that rows that repeat
without end do not meet in one group); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from closebooks.llm.bpe import byte_letters, read_spec

GROUP_BYTES = 2 << 20  # of text, on average
TASK_GROUPS = 8  # that a task packs one after the other, on average
ROW_BYTES = 16  # that a document counts besides its text
LEAST_PIECE = 8  # shorter gaps are left to padding
CLOSING = 1  # the id after each document
SLICE = 256  # texts encoded at a time

# The pattern that cuts text before the merges of a byte-level tokenizer.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

PIECE = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
         "sequence_id long, offset long")


class Encoder:
    """Token ids of a tokenizer file, by the rank encoder where the file is of that kind.

    A byte-level file whose merges are numbered in order says the same as a table of ranks; all
    other files, and texts that the rank encoder refuses, go to the library of the file.
    """

    def __init__(self, spec: bytes):
        self.library = Tokenizer.from_str(spec.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.ranks = self._ranks(json.loads(spec))

    @staticmethod
    def _ranks(data: dict) -> tiktoken.Encoding | None:
        model, before = data["model"], data.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get(
            "use_regex", True) and not before.get("add_prefix_space") and not data.get("normalizer")
        odd = any(model.get(x) for x in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
            "ignore_merges"))
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        if not plain or odd or any(x["lstrip"] or x["rstrip"] or x["single_word"]
                                   for x in data["added_tokens"]):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m)
                  for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()
                 if token not in special}
        return tiktoken.Encoding(
            "file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.ranks is not None:
            try:
                return self.ranks.encode_to_numpy(text, allowed_special="all").astype("<u4")
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # its regex gives up on some endless runs
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


_loaded: dict[str, Encoder] = {}


def loaded(spec: bytes) -> Encoder:
    """The tokenizer of a file's content, built once a worker."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(spec)
    return _loaded[key]


class Room:
    """Tournament tree over sequences: each node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first sequence with room for `size`, which it takes."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        found = at - self.leaves
        most[at] -= size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


Part = tuple[int, int, int]  # document, start, length


def _cut(parts: list[Part], length: int) -> tuple[list[Part], list[Part]]:
    """The first `length` tokens of a sequence, and the rest."""
    head: list[Part] = []
    for k, (doc, start, n) in enumerate(parts):
        if n > length:
            if length:
                head.append((doc, start, length))
            return head, [(doc, start + length, n - length), *parts[k + 1:]]
        head.append((doc, start, n))
        length -= n
    return head, []


def _close_gaps(bins: list[list[Part]], capacity: int) -> list[list[Part]]:
    """The emptiest sequences, taken apart into the gaps of the fullest."""
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-fill[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        gap = capacity - fill[order[low]]
        if gap < LEAST_PIECE:
            low += 1
            continue
        donor = order[high]
        moved, bins[donor] = _cut(bins[donor], gap)
        size = sum(p[2] for p in moved)
        bins[order[low]] += moved
        fill[order[low]] += size
        fill[donor] -= size
        if not fill[donor]:
            high -= 1
    return [bins[b] for b in order if fill[b]]


def pack(sizes: list[int], capacity: int) -> list[list[Part]]:
    """Sequences of (document, start, length), every token of every document in one."""
    out = [[(doc, start, capacity)] for doc, size in enumerate(sizes)
           for start in range(0, size - capacity + 1, capacity)]
    rest = [(size % capacity, doc) for doc, size in enumerate(sizes) if size % capacity]
    # First-fit leaves no two sequences whose contents fit in one.
    room = Room(2 * math.ceil(sum(n for n, _ in rest) / capacity) + 1, capacity)
    bins: list[list[Part]] = []
    for n, doc in sorted(rest, key=lambda x: (-x[0], x[1])):
        at = room.first(n)
        if at == len(bins):
            bins.append([])
        bins[at].append((doc, sizes[doc] - n, n))
    bins = _close_gaps(bins, capacity)
    if bins:
        last = bins.pop()
        used = sum(p[2] for p in last)
        if used <= capacity - LEAST_PIECE:
            for bit in range(used.bit_length() - 1, -1, -1):
                if used >> bit & 1:
                    head, last = _cut(last, 1 << bit)
                    bins.append(head)
        else:
            bins.append(last)
    return out + bins


def _encode(spec, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (doc_id, text) to doc_id, ids, mark (a checksum of the ids) and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = loaded(spec.value), TaskContext.get().partitionId()
        closing = np.array([CLOSING], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [encoder.encode(text.as_py() or "").tobytes() + closing
                       for text in part.column(1)]
                marks = [zlib.crc32(x) for x in ids]
                keys = zip(part.column(0).to_pylist(), marks, strict=True)
                group = [int.from_bytes(hashlib.blake2b(
                    f"{doc}/{mark}/{place}".encode(), digest_size=8).digest()) % groups
                    for doc, mark in keys]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(marks, pa.int64()),
                     pa.array(group, pa.int64())], names=["doc_id", "ids", "mark", "group"])

    return run


def _pack_group(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("mark", "ascending")])
        docs, ids = rows["doc_id"].to_pylist(), rows["ids"].to_pylist()
        first = rows["group"][0].as_py() << 32
        out: list[tuple] = []
        for number, parts in enumerate(pack([len(x) // 4 for x in ids], capacity)):
            offset = 0
            for doc, start, length in parts:
                out.append((docs[doc], start, length, ids[doc][4 * start:4 * (start + length)],
                            len(ids[doc]) // 4, first + number, offset))
                offset += length
        long = pa.int64()
        types = [long, long, long, pa.binary(), long, long, long]
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
            names=[c.split(" ")[0] for c in PIECE.split(", ")])

    return run


def packed(docs: DataFrame, path: str, capacity: int = 2048,
           group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every piece: its document, place and tokens there, and its place in a sequence.

    `ids` holds the piece's ids as little-endian unsigned 32-bit numbers. A sequence_id is the
    group's number times 2^32 plus the sequence's number in it.
    """
    size = docs.agg(F.sum(
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).head()[0] or 0
    groups = max(1, math.ceil(size / group_bytes))
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    tokens = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _encode(spec, groups), "doc_id long, ids binary, mark long, group long")
    # The number of tasks follows the text, whatever the session's number of shuffle partitions.
    dealt = tokens.repartition(math.ceil(groups / TASK_GROUPS), "group")
    return dealt.groupBy("group").applyInArrow(_pack_group(capacity), PIECE)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the pieces of a sequence joined in their order."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("p", F.lit(b""), lambda out, x: F.concat(out, x["ids"]))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda out, x: out + x["length"])
    return pieces.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", total.alias("length"), joined.alias("ids"))
