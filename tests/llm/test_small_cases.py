"""Nulls, empty and long texts, ties, repeats, empty tables and clashing names, by operator."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from closebooks.llm import bpe, line_dedup, mixing, near_dedup, quality, sharding
from closebooks.llm import html_text, suffix_dedup, topk, toxicity
from closebooks.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int"
LONG = "\n".join(f"line number {i} of the long one" for i in range(20_000))
ROWS = [
    (1, "A shared line here\nown line\n\tA SHARED line HERE ", "en", "a", 1, 9, 9),
    (2, "a shared line here\nshort\nother text that stays", None, "a", None, 9, 9),
    (3, None, None, None, None, None, None),
    (4, "", "de", None, 0, None, None),
    (5, LONG, "en", "b", 1, 9, 9),
    (5, LONG, "en", "b", 1, 9, 9),
    (6, "é" * 9 + "\n" + "É" * 10, "fr", "b", 1, 9, 9),
    (7, "É" * 10 + "\n" + "é" * 9 + "\n", "fr", "é", 1, 9, 9),
    (None, "a shared line here", "en", "a", 1, 9, 9),
    (None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_line_dedup(docs, empty):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256)
           for r in line_dedup.line_digest(docs).collect()}
    assert got == {
        (1, 3, 0, sha(ROWS[0][1])), (2, 3, 1, sha("short\nother text that stays")),
        (3, 1, 0, sha("")), (4, 1, 0, sha("")), (5, 20_000, 0, sha(LONG)),
        (6, 2, 0, sha(ROWS[6][1])), (7, 3, 1, sha("é" * 9 + "\n")),
        (None, 1, 0, sha("a shared line here")), (None, 1, 0, sha("")),
    }
    assert line_dedup.line_digest(docs).count() == len(ROWS)
    assert line_dedup.line_digest(empty).count() == 0
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_sharding(docs, empty):
    root = sharding.tree([1.0] * 8)
    rows = sharding.sharded(docs, root, sharding.grown(root, 1.0, 8)).collect()
    assert len(rows) == len(ROWS)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    sizes = sorted((r["size"], r.text_crc32) for r in rows)
    assert sizes == sorted((len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode()))
                           for x in ROWS)
    assert sharding.sharded(empty, root, root).count() == 0


def test_weights_move_rows_only_where_they_change(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    before = sharding.tree([1.0] * 8)
    after = sharding.tree([1.0] * 7 + [3.0])
    rows = sharding.sharded(ids, before, after).toPandas()
    moved = rows[rows["shard"] != rows["grown_shard"]]
    # Rows that change region go to the heavier one; inside it, none leaves the heavier rack.
    assert ((moved["shard"] // 4 == 1) | (moved["grown_shard"] // 4 == 1)).all()
    assert not ((rows["shard"] // 2 == 3) & (rows["grown_shard"] // 2 != 3)).any()
    share = rows["grown_shard"].value_counts(normalize=True)
    assert abs(share[7] - 0.3) < 0.02 and abs(share[0] - 0.1) < 0.02


def test_mixing(docs, empty):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in rows)
    assert mixing.mixed(empty).count() == 0
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(r.copies if r["size"] else 1 for r in rows)
    assert mixing.mix_documents(empty).count() == 0


def test_mixing_comes_near_its_targets(spark):
    sizes = [(i, " ".join(["w"] * (1 + (i * 37) % 101)), "abc"[i % 3] if i % 7 else None)
             for i in range(3000)]
    frame = spark.createDataFrame(sizes, "doc_id long, text string, source string")
    first = mixing.mixed(frame).toPandas()
    sums = first.groupby("source", dropna=False).agg(
        taken=("taken", "sum"), target=("target", "first"))
    assert ((sums["taken"] - sums["target"]).abs() <= 101).all()
    assert abs(sums["target"].sum() - first["size"].sum()) < 1e-6 * first["size"].sum()
    again = mixing.mixed(frame.repartition(5)).toPandas()
    assert sorted(map(tuple, first[["doc_id", "taken"]].values)) == sorted(
        map(tuple, again[["doc_id", "taken"]].values))


def test_target_level_by_hand(spark):
    sizes = spark.createDataFrame(
        [("a", 100), ("b", 10), (None, 90)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # Weights 1, 2, 3 of 200: b stops at 30, a and null share 170 by 1 and 3.
    assert got == pytest.approx({"a": 42.5, "b": 30.0, None: 127.5})


def test_near_dedup(docs, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept)
                  for r in near_dedup.linked(docs, 4).collect()), key=str)
    words = LONG.split()
    n = len({tuple(words[i:i + 4]) for i in range(len(words) - 3)})
    assert got == sorted([
        (1, 6, 1, True), (2, 6, 2, True), (3, 0, 3, True), (4, 0, 4, True),
        (5, n, 5, True), (5, n, 5, True), (6, 1, 6, True), (7, 1, 7, True),
        (None, 1, None, True), (None, 0, None, True)], key=str)
    assert near_dedup.linked(empty, 4).count() == 0
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1  # 5 twice
    assert near_dedup.deduplicated(empty).count() == 0


def test_deduplicated_keeps_unlinked_texts_of_one_doc_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, b + " more"), (2, b), (0, a), (3, c), (3, c), (4, ""), (4, c)]
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((r.doc_id, r.text) for r in kept.collect())
    assert found in ([(0, a), (1, b), (3, c), (4, "")], [(0, a), (1, b + " more"), (3, c), (4, "")])


def test_near_dedup_sends_a_large_group_about_twice(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 2000)
    sent, deal = [], type(spark.range(0)).repartition

    def repartition(frame, *by):
        if by == ("g", "i", "j"):
            sent.append((frame.count(), frame.select("g", "node").distinct().count()))
        return deal(frame, *by)

    monkeypatch.setattr(type(spark.range(0)), "repartition", repartition)

    def linked(texts):
        frame = spark.createDataFrame(texts, "doc_id long, text string")
        return {r.doc_id: r.component_id for r in near_dedup.linked(frame, 2).collect()}

    body = [f"w{k}" for k in range(100)]
    family = [(i, " ".join([*body, f"own{i}"])) for i in range(300)]
    assert set(linked(family).values()) == {0}
    assert len(sent) >= 2 and all(rows <= 3 * met for rows, met in sent)
    # A chain: only near neighbours are linked, mostly not with the first block.
    chain = [(i, " ".join(f"c{k}" for k in range(2 * i, 2 * i + 100))) for i in range(150)]
    apart = [(1000 + i, " ".join(f"x{i}y{k}" for k in range(60))) for i in range(20)]
    found = linked(chain + apart + [(2000 + i, text) for i, text in family])
    assert found == {**dict.fromkeys(range(150), 0), **{i: i for i, _ in apart},
                     **dict.fromkeys(range(2000, 2300), 2000)}


def test_suffix_dedup(spark, docs, empty):
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.passage_digest(docs).collect()}
    assert got == {(i, len((t or "").encode()), 0, 0, sha(t or "")) for i, t, *_ in ROWS}
    assert suffix_dedup.passage_digest(empty).count() == 0
    line = "".join(chr(97 + (i * i) % 23) for i in range(60))
    rows = [(1, "x" + line), (2, line + "é" + line), (None, line), (3, line[:49]), (4, "a" * 500),
            (5, "a" * 70 + "b"), (4, "a" * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans)
                 for r in suffix_dedup.passage_digest(frame).collect())
    assert got == [(0, 60, 0, 0), (1, 61, 0, 0), (2, 122, 120, 2), (3, 49, 0, 0), (4, 60, 0, 0),
                   (4, 500, 0, 0), (5, 71, 70, 1)]


def test_quality(docs, empty):
    rows = quality.verdicts(docs).collect()
    assert len(rows) == len(ROWS)
    long = next(r for r in rows if r.doc_id == 5)
    assert (long.n_words, long.n_repeat_words, long.n_dup_lines, long.base_failed) == (
        140_000, 119_998, 0, True)
    first = next(r for r in rows if r.doc_id == 1)
    assert (first.n_words, first.word_chars, first.n_symbols, first.n_dup_lines,
            first.n_repeat_words, first.base_failed, first.kept) == (10, 37, 0, 0, 0, True, False)
    assert quality.verdicts(empty).count() == 0
    assert quality.passed(docs).columns == docs.columns


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame(
        [(1, 0), (2, None), (3, 1), (5, 0), (5, 1), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.scored(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.doc_id for r in rows if r.held_out} == {
        i for i in range(1, 8) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert toxicity.scored(empty, labels).count() == 0
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}


def test_bpe(docs, empty):
    rows = bpe.encoded(docs, TOKENIZER).collect()
    assert len(rows) == len(ROWS)
    assert all((r.n_tokens, r.ids) == (0, []) for r in rows if r.doc_id in (3, 4))
    assert bpe.token_digest(empty, TOKENIZER).count() == 0
    back = {(r.doc_id, sha(r.decoded)) for r in bpe.decoded(
        bpe.encoded(docs, TOKENIZER), TOKENIZER).collect()}
    assert back == {(r.doc_id, r.decoded_sha256) for r in rows}


def test_html(spark):
    pages = [(1, "u", None, 5), (2, None, "", 5), (None, "u", "<p>a, b</p>", 5),
             (4, "u", "<div>" * 5000 + "deep", 5), (5, "u", "no markup &lt;here&gt;", 5),
             (5, "u", "no markup &lt;here&gt;", 5), (6, "u", "<script>only()</script>", 5)]
    schema = "page_id long, url string, html string, n_chars int"
    rows = html_text.main_texts(spark.createDataFrame(pages, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [
        (0, "a, b", 4), (1, "", 0), (2, "", 0), (4, "deep", 4), (5, "no markup <here>", 16),
        (5, "no markup <here>", 16), (6, "", 0)]
    assert html_text.main_texts(spark.createDataFrame([], schema)).count() == 0


def test_html_keeps_what_only_sounds_like_an_advert():
    said = "Prices rose again on Monday, traders said, and the market closed well above its mark."
    page = f"""<html><body><article><h1>Markets</h1><p>{said} One.</p>
        <h2 id="share-prices-fell">Share prices fell</h2><p id="notice-1">{said} Two.</p>
        <section id="search-and-rescue"><p>{said} Three.</p></section>
        <section id="advertising-revenue"><p>{said} Four.</p></section>
        <section class="social"><p>{said} Five.</p></section>
        <h2 id="comments">Comments of the chair</h2><p>{said} Six.</p>
        <div class="share"><a href="/f">Share this</a></div>
        <div class="ad">Buy now.</div><div id="comments"><p>{said} A reader.</p></div>
        </article><div class="sidebar"><p>{said} Beside.</p></div></body></html>"""
    numbers = ["One", "Two", "Three", "Four", "Five", "Six"]
    want = ["Markets", *(f"{said} {x}." for x in numbers)]
    want.insert(2, "Share prices fell")
    want.insert(7, "Comments of the chair")
    assert html_text.extract(page).split("\n\n") == want


def test_top_k(spark):
    schema = "vec_id long, embedding array<float>, score int"
    rows = [(0, [1.0, 2.0], 1), (50, [0.5], 2), (1, [float("nan"), 1.0], 1), (2, None, 1),
            (None, [1.0, 1.0], 1), (3, [None, 1.0], 0), (50, [0.25], 2), (5, [], 3),
            (7, [0.0, 0.0], 3), (6, [float("inf")], 3)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, schema)).orderBy(
        "query_id", "rank").collect()]
    assert got == [(0, 1, 50, 128 * 256), (0, 2, 50, 64 * 256), (0, 3, 5, 0), (0, 4, 7, 0),
                   (50, 1, 0, 128 * 256), (50, 2, 5, 0), (50, 3, 7, 0)]
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
