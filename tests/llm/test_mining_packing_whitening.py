"""Hard negatives, packing and whitening against plain versions, and their odd cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from closebooks.llm import hard_negatives, packing, queries, whitening
from tests.conftest import SF_DIR

VECTORS = "vec_id long, embedding array<float>, label int, v string, leaf string, x int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "v", "leaf", 1, 2) for r in rows], VECTORS)


ODD = [
    (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.75, 0.0], 2),
    (4, [0.75, 0.0], 2), (5, [0.75, 0.0], 2), (6, [0.75], 2), (8, [0.5, 9.0], 2),
    (9, [0.49, 0.0], 2), (None, [0.9, 0.0], 2), (10, None, 2), (11, [0.9, None], 2),
    (12, [0.9, float("nan")], 2), (13, [float("inf"), 0.0], 2), (15, [0.9, 0.0], None),
    (16, [], 1), (50, [-1.0, 0.0], 1), (200, [0.0, 1.0], 7),
]


def plain_negatives(rows):
    """(anchor, positive, rank, negative, scores) by sorting all rows for each anchor."""
    good = [(i, np.pad(np.floor(256 * np.array(v, np.float32).astype(float)), (0, 2 - len(v)))
             if len(v) < 2 else np.floor(256 * np.array(v, np.float32).astype(float)), y)
            for i, v, y in rows if i is not None and v is not None and y is not None
            and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for a, q, y in good:
        if a % 50:
            continue
        ranked = sorted((-int(q @ v), i, z) for i, v, z in good if i != a)
        for s, p, z in [r for r in ranked if r[2] == y][:5]:
            hard = [r for r in ranked if r[2] != y and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("leaf_rows", [2048, 2])
def test_negatives_of_odd_rows(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", leaf_rows)
    got = hard_negatives.mined(vectors(spark, ODD)).collect()
    assert sorted(map(tuple, got)) == plain_negatives(ODD)
    assert {r.negative_id for r in got if r.anchor_id == 100} >= {3, 4, 5}
    assert hard_negatives.mined(vectors(spark, [])).count() == 0
    assert hard_negatives.mined(vectors(spark, ODD[9:15])).count() == 0


def test_negatives_with_a_tree_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 100)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 2))
    rows = [(i, (centres[i % 12] + 0.05 * rng.standard_normal(2)).tolist(), i * i % 3)
            for i in range(1500)]
    rows += [(2000 + i, [0.5, 0.5], i % 2) for i in range(700)]
    frame = vectors(spark, rows).repartition(7)
    tree, indexed = hard_negatives._index(hard_negatives.prepared(frame))
    assert len(tree.nodes) > 8 and indexed.select("leaf").distinct().count() > 50
    parts = hard_negatives.Searcher(tree, indexed).rows.groupBy("leaf", "part").count()
    assert parts.agg(F.max("count")).head()[0] < 200
    assert sorted(map(tuple, hard_negatives.mined(frame).collect())) == plain_negatives(rows)


def test_subtrees_are_left_out_but_no_row_of_a_window(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 16)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(2) * 3).tolist(), 0) for i in range(1200)]
    tree, indexed = hard_negatives._index(hard_negatives.prepared(vectors(spark, rows)))
    held = indexed.toPandas()
    whole = np.array([np.frombuffer(v, tree.dtype) for v in held["vec"]], np.int64)
    queries_ = whole[::40]
    score = queries_ @ whole.T
    low = np.sort(score, axis=1)[:, -30:-29]
    high = np.sort(score, axis=1)[:, -20:-19]
    pairs = {tuple(p) for p in tree.visits(queries_, low, high).tolist()}
    wanted = {(int(q), int(held["leaf"][r])) for q, r in zip(
        *np.nonzero((score >= low) & (score <= high)), strict=True)}
    assert wanted <= pairs
    assert len(pairs) < 0.5 * len(queries_) * tree.leaves


def test_negatives_beyond_exact_doubles():
    big = np.array([[2**30, 3], [2**30, 4]], np.int64)
    assert hard_negatives._scores(big, big).tolist() == [
        [2**60 + 9, 2**60 + 12], [2**60 + 12, 2**60 + 16]]
    with pytest.raises(OverflowError):
        hard_negatives._scores(big * 4, big * 4)
    score = np.array([[2**60, 2**60 + 1, 2**60, 5]], np.int64)
    q, r = hard_negatives._best(score, np.array([[True, True, True, False]]), 2)
    assert sorted(r.tolist()) == [0, 1]


def test_negatives_of_the_given_rows(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    got = queries.queries()["op11_hard_negatives"](spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows) and got


# -- packing --------------------------------------------------------------------------

DOCS = "doc_id long, text string, ids string, mark string, group int, start int, length int"
TEXTS = [
    (1, "A first text, with some words."), (2, ""), (3, None), (None, "no id"), (None, None),
    (4, "x" * 30_000 + " and <|endoftext|> é🙂\n" * 2000), (5, "word " * 2047),
    *[(6, "the same row again")] * 50, (7, " \n\t "),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.BYTE_TOKENIZER)


def expected_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(pieces, texts, library, capacity=2048):
    """Each document's pieces are its ids, once; each sequence has no gap and fits."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {i for i, _ in texts}
    for doc, parts in by_doc.items():
        want = sorted(expected_ids(library, t) for i, t in texts if i == doc)
        assert sum(p.length for p in parts) == sum(map(len, want))
        assert {p.doc_tokens for p in parts} == set(map(len, want))
        for p in parts:
            ids = np.frombuffer(p.ids, "<u4").tolist()
            assert len(ids) == p.length and any(
                w[p.start:p.start + p.length] == ids and p.doc_tokens == len(w) for w in want)
    waste = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= capacity
        waste += capacity - at if at & (at - 1) else 0
    return waste


def test_packing_of_odd_texts(spark, library):
    frame = spark.createDataFrame([(i, t, "a", "b", 1, 2, 3) for i, t in TEXTS], DOCS)
    pieces = packing.packed(frame, queries.BYTE_TOKENIZER).collect()
    assert check_pieces(pieces, TEXTS, library) < packing.LEAST_PIECE * len(pieces)
    whole = packing.sequences(packing.packed(frame, queries.BYTE_TOKENIZER)).collect()
    assert sum(r.length for r in whole) == sum(p.length for p in pieces)
    assert all(len(r.ids) == 4 * r.length for r in whole)
    empty = frame.where("false")
    assert packing.packed(empty, queries.BYTE_TOKENIZER).count() == 0


def test_packing_of_documents(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    pieces = packing.packed(docs, queries.BYTE_TOKENIZER, group_bytes=100_000).collect()
    assert len({p.sequence_id >> 32 for p in pieces}) > 3
    used = sum(p.length for p in pieces)
    assert check_pieces(pieces, texts, library) < 0.01 * used
    digest = {(r.doc_id, r.start, r.length): r.ids_crc32 for r in
              queries.queries()["op12_packing"](spark, SF_DIR).collect()}
    ids = {i: np.array(expected_ids(library, t), "<u4") for i, t in texts}
    assert all(zlib.crc32(ids[d][s:s + n].tobytes()) == crc for (d, s, n), crc in digest.items())


def test_rows_that_repeat_without_end_are_dealt_over_groups(spark):
    rows = spark.range(4000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("again and again").alias("text"))
    pieces = packing.packed(rows.repartition(16), queries.BYTE_TOKENIZER, group_bytes=8000)
    groups = [r["count"] for r in pieces.groupBy(
        F.shiftright("sequence_id", 32).alias("g")).count().collect()]
    assert len(groups) > 4 and max(groups) <= 2000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=50), st.sampled_from([8, 16, 32]))
def test_packing_of_any_lengths(sizes, capacity):
    taken = [[] for _ in sizes]
    open_ = 0
    for parts in packing.pack(sizes, capacity):
        used = sum(p[2] for p in parts)
        assert 0 < used <= capacity
        open_ += used <= capacity - packing.LEAST_PIECE and used & (used - 1) != 0
        for doc, start, n in parts:
            taken[doc].append((start, n))
    for size, parts in zip(sizes, taken, strict=True):
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == size
    assert open_ == 0


def test_first_fit_finds_the_leftmost_room():
    room, plain = packing.Room(9, 10), [10] * 9
    for n in (7, 4, 4, 6, 3, 2, 9, 1, 5, 5, 8, 2, 10):
        want = next(i for i, r in enumerate(plain) if r >= n)
        plain[want] -= n
        assert room.first(n) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([
    *"abcdehinorstABÉéß'’ \t\n\x1c\x85\xa001½!?.,-<|>🙂中", "<|endoftext|>", "'re", "the", " ing"]),
    max_size=60).map("".join))
def test_rank_encoder_says_what_the_library_says(library, text):
    encoder = packing.loaded(packing.read_spec(queries.BYTE_TOKENIZER))
    assert encoder.ranks is not None
    assert [*encoder.encode(text).tolist(), 1] == expected_ids(library, text)


def test_other_tokenizer_files_use_the_library():
    encoder = packing.Encoder(packing.read_spec(queries.TOKENIZER))
    want = Tokenizer.from_file(queries.TOKENIZER).encode("Some text", add_special_tokens=False)
    assert encoder.ranks is None and encoder.encode("Some text").tolist() == want.ids


# -- whitening ------------------------------------------------------------------------

def plain_whitening(x, keep=8):
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
    return centred @ u / np.sqrt(e), ((n * x - sums) ** 2).sum(axis=1), e / np.trace(v)


def test_whitening_of_the_given_rows(spark):
    rows = queries.queries()["op13_whitening"](spark, SF_DIR).toPandas()
    given_rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas()
    x = np.floor(1024 * np.array(given_rows["embedding"].tolist(), float)).astype(int) + 100_000
    z, deviation, explained = plain_whitening(x)
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[
        given_rows["vec_id"]].to_numpy()
    assert np.abs(np.abs(got) - np.abs(z)).max() < 1e-9
    assert (np.sign((got * z).sum(axis=0)) * got * np.sign(z) >= -1e-9).all()
    first = rows.groupby("vec_id").first().loc[given_rows["vec_id"]]
    assert (first["deviation"].to_numpy() == deviation).all()
    assert (rows["n"] == len(x)).all() and rows["identity_error"].nunique() == 1
    assert rows["identity_error"][0] < 1e-10
    assert np.allclose(rows.groupby("component")["explained"].first(), explained, rtol=1e-10)


def test_whitening_of_odd_rows(spark):
    odd = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [0.5, -2.0], 0), (2, [0.25], 0),
           (3, [], 0), (4, None, 0), (5, [1.0, None], 0), (6, [float("nan"), 1.0], 0),
           (7, [1.0, float("-inf")], 0)]
    rows = whitening.whitened(vectors(spark, odd)).collect()
    x = np.array([[1024, 2048], [1024, 2048], [512, -2048], [256, 0], [0, 0]]) + 100_000
    z, deviation, explained = plain_whitening(x, 2)
    assert len(rows) == 10 and {r.component for r in rows} == {1, 2} and {r.n for r in rows} == {5}
    assert sorted(int(r.deviation) for r in rows) == sorted(np.repeat(deviation, 2).tolist())
    assert sorted(abs(r.whitened) for r in rows) == pytest.approx(sorted(np.abs(z).ravel()))
    assert sum(r.vec_id is None for r in rows) == 2
    assert {round(r.explained, 9) for r in rows} == set(np.round(explained, 9))
    same = vectors(spark, [(i, [1.0, 2.0], 0) for i in range(4)])
    assert whitening.whitened(same).count() == 0
    assert whitening.whitened(vectors(spark, odd[:1])).count() == 0
    assert whitening.whitened(vectors(spark, [])).count() == 0
    line = vectors(spark, [(i, [float(i), 2.0 * i], 0) for i in range(9)])
    assert {r.component for r in whitening.whitened(line).collect()} == {1}


def test_deviations_beyond_long(spark):
    far = vectors(spark, [(i, [float(i * 2**20), 1.0], 0) for i in range(40)])
    rows = whitening.whitened(far).collect()
    x = [1024 * i * 2**20 + 100_000 for i in range(40)]
    want = {i: (40 * x[i] - sum(x)) ** 2 for i in range(40)}
    assert {r.vec_id: int(r.deviation) for r in rows} == want and max(want.values()) > 2**63


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 24), st.integers(0, 5), st.integers(0, 10_000))
def test_spectral_split_gives_eigenvectors(size, kind, seed):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = [rng.standard_normal(size), np.ones(size), np.repeat([2.0, 1.0], size)[:size],
              2.0 ** -np.arange(size), np.arange(size) % 3 * 1.0,
              1 + 1e-9 * np.arange(size)][kind]
    a = turn @ np.diag(values) @ turn.T
    a = (a + a.T) / 2
    e, u = whitening.eigen_components(a)
    scale = max(float(np.abs(values).max()), 1e-300)
    assert np.abs(e - np.sort(values)[::-1]).max() <= 1e-13 * size * scale
    assert np.abs(u.T @ u - np.eye(size)).max() <= 1e-13 * size
    assert np.abs(a @ u - u * e).max() <= 1e-13 * size * scale


def test_polar_factor_is_the_sign(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a += a.T
    e, u = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - (u * np.sign(e)) @ u.T).max() < 1e-12
