"""BPE encoding by backtracking over longest matches, decoding by an offset table.

A word is encoded left to right: Aho-Corasick gives the longest token at each place; a token
may follow another only if merging their joined text keeps them apart, which a table of pairs
answers (filled as pairs turn up). If no token fits, the last one is taken back and a shorter
one tried; places that led nowhere are marked, so the work is linear. The result equals
merging by rank. Texts are cut as the tokenizer file says: special tokens in the raw text,
NFC, lower case, white space dropped, then runs of letters, single digits, runs of the rest.

Defined cases: null and empty texts have no tokens and decode to nothing; repeated rows are
encoded each; a text without white space is one long piece, encoded whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_END = "</w>"
CACHE = 100_000  # pieces that a worker remembers, and as many older ones
SLICE = 256  # texts encoded at a time
PAIRS = 250_000  # of the pair table
STOPS = frozenset(".,!?;:")  # pieces of their own after a word
CACHED_CHARS = 64  # longer pieces are not remembered

# White space of the tokenizer's patterns, its contractions, the byte alphabet.
WHITE = "\t-\r \x85\xa0  -     　"
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+")
SPLIT = regex.compile(f"[{WHITE}]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")  # str.split() cuts here, the tokenizer does not


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class OffsetTable:
    """Byte strings by number, one after the other in a buffer, with their offsets."""

    def __init__(self, strings: list[bytes]):
        self.buffer = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(self.start[ids] - ends + length, length)
        return self.buffer[at].tobytes()


class Bpe(dict):
    """A tokenizer. As a dict: pieces between white space to their ids, as int32 bytes."""

    def __init__(self, spec: bytes):
        super().__init__()
        self.older: dict[str, bytes] = {}
        data = json.loads(spec)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters = byte_letters()
        names = letters + [x + WORD_END for x in letters]
        # Own numbers: the letters, the letters at a word's end, then the merges by rank.
        number = {x: i for i, x in enumerate(names)}
        self.split = [(i, i) for i in range(len(names))]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            name = a + b
            if name not in number:
                number[name] = len(names)
                names.append(name)
                self.split.append((number[a], number[b]))
            self.pairs.setdefault((number[a], number[b]), number[name])
        # A token as a string with one character per byte, moved up by 256 at a word's end.
        self.strings = [chr(i) for i in range(512)]
        for a, b in self.split[512:]:
            self.strings.append(self.strings[a] + self.strings[b])
        self.ids = np.array([vocab[x] for x in names], np.int32)
        known = {s: i for i, s in enumerate(self.strings) if self._reached(i)}
        self.automaton = ahocorasick.Automaton()
        for s, i in known.items():
            self.automaton.add_word(s[::-1], i)
        self.automaton.make_automaton()
        self.shorter = [
            next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), -1)
            for s in self.strings
        ]
        self.lengths = list(map(len, self.strings))
        self.compatible: dict[int, bool] = {}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.special_at = regex.compile("|".join(
            map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        content = {i: x for x, i in [*vocab.items(), *self.special.items()]}
        size = max(content) + 1
        shown = [content.get(i, "").encode() + b" " for i in range(size)]
        self.texts = OffsetTable(shown)
        self.numbers = OffsetTable([b"%d " % i for i in range(size)])

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether merges below `limit` never join across the border of tokens a and b.

        Undo the later of the two border tokens' merges, step by step; at each step the pair
        that then met at the border must not have a merge that came before.
        """
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a < 512 and b < 512:
                return True
            if a > b:
                limit, a = a, self.split[a][1]
            else:
                limit, b = b + 1, self.split[b][0]

    def _reached(self, token: int) -> bool:
        """Whether merging the token's own text ends in the token."""
        if token < 512:
            return True
        a, b = self.split[token]
        return self._apart(a, b, token)

    def _judge(self, key: int) -> bool:
        """Fill the table of pairs for a << 20 | b."""
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        fits = self.compatible[key] = self._apart(key >> 20, key & 0xFFFFF, 1 << 40)
        return fits

    def encode_word(self, word: str) -> list[int]:
        """Own numbers of a piece's tokens."""
        data = word.encode()
        text = data[:-1].decode("latin-1") + chr(256 + data[-1])
        n = len(text)
        # Matches come by their end in the reversed text, the longest first; it stays.
        longest = dict(list(self.automaton.iter(text[::-1]))[::-1])
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        dead: set[int] = set()
        out: list[int] = []
        pos, last, token = 0, -1, longest[n - 1]
        while True:
            end = pos + lengths[token]
            if end not in dead:
                if last < 0:
                    fits = True
                else:
                    key = last << 20 | token
                    fits = compatible.get(key)
                    if fits is None:
                        fits = self._judge(key)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    pos, last, token = end, token, longest[n - 1 - end]
                    continue
            token = shorter[token]
            while token < 0:
                dead.add(pos)
                pos -= lengths[last]
                token = shorter[out.pop()]
                last = out[-1] if out else -1

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if piece.isalpha():
                ids = self.ids[self.encode_word(piece)].tobytes()
            elif piece[-1:] in STOPS and piece[:-1].isalpha():  # a word and its stop
                return self[piece[:-1]] + self[piece[-1]]
            else:
                found = [t for word in PIECES.findall(piece) for t in self.encode_word(word)]
                ids = self.ids[found].tobytes() if found else b""
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        cut = SPLIT.split(text) if ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.__getitem__, cut))

    def encode(self, text: str) -> np.ndarray:
        if "<" not in text:
            return np.frombuffer(self._plain(text), np.int32)
        parts, at = [], 0
        for found in self.special_at.finditer(text):
            parts.append(self._plain(text[at:found.start()]))
            parts.append(np.int32(self.special[found.group()]).tobytes())
            at = found.end()
        parts.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.texts.join(ids)[:-1]


_loaded: dict[str, Bpe] = {}


def loaded(spec: bytes) -> Bpe:
    """The tokenizer of a file's content, built once a worker.

    Workers are used again; what an earlier step left in one is given back first.
    """
    key = hashlib.sha256(spec).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def _digest(bpe: Bpe, ids: np.ndarray) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(bpe.numbers.join(ids)[:-1]).hexdigest(),
            hashlib.sha256(bpe.decode(ids)).hexdigest())


def _encode(spec, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (doc_id, text) to doc_id, the digests, and the ids if asked for.

    Batches are cut, so that the ids of a few texts at a time are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [bpe.encode(text.as_py() or "") for text in part.column(1)]
                count, ids_sha, text_sha = zip(*(_digest(bpe, x) for x in ids), strict=True)
                cells = [part.column(0), pa.array(count, pa.int64()),
                         pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = np.cumsum([0, *count]).astype(np.int32)
                    cells.append(pa.ListArray.from_arrays(
                        offsets, pa.array(np.concatenate(ids), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cells, names=names)
                del cells, ids, part
            del batch  # before the next one is read

    return run


def _decode(spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["doc_id", "decoded"])

    return run


def read_spec(path: str) -> bytes:
    """The tokenizer file, read by the driver and sent to the workers (a few MB)."""
    with open(path, "rb") as f:
        return f.read()


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of tokens, digests of its ids and of the decoded text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _encode(spec, False), DIGEST)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The digest's columns, and the token ids."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _encode(spec, True), f"{DIGEST}, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    spec = tokens.sparkSession.sparkContext.broadcast(read_spec(path))
    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(
        _decode(spec), "doc_id long, decoded string")
