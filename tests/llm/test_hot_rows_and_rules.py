"""Rows that repeat without end, draws and thresholds recomputed, templates of pages."""

from __future__ import annotations

import math
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from closebooks.llm import html_text, mixing, near_dedup, quality, sharding, suffix_dedup, toxicity
from tests.conftest import SF_DIR

DOCS = "doc_id long, text string, lang string, source string"


# -- sharding -------------------------------------------------------------------------

def plain_shard(key, node):
    """The shard of a key, by drawing at every child of every level."""
    while node.children:
        def draw(child):
            seed = xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
            bits = xxhash.xxh64(child.name.encode(), seed=seed).intdigest() >> 11
            return -math.log((bits + 0.5) / 2**53) / child.total()
        node = min(node.children, key=draw)
    return node.shard


def test_sharding_against_plain_draws(spark):
    root = sharding.tree([1.0, 2.0, 0.5, 1.0, 1.0, 3.0, 1.0, 1.0])
    bigger = sharding.grown(root, 1.0, 8)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = sharding.sharded(docs, root, bigger).collect()
    for r in rows:
        assert (r.shard, r.grown_shard) == (
            plain_shard(r.doc_id, root), plain_shard(r.doc_id, bigger))


def test_sharding_of_rows_that_repeat(spark):
    same = spark.range(30_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    some = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    root = sharding.tree([1.0] * 8)
    out = sharding.sharded(same.unionByName(some).repartition(9), root, root)
    slots = {}
    for r in out.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(map(len, slots.values())) == 30_500
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # The windows run over counted rows: what they number is a sum of counts.
    assert "row_number" not in plan and "copies" in plan


# -- mixing ---------------------------------------------------------------------------

def test_mixing_of_rows_that_repeat(spark):
    same = spark.range(6000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"),
        F.lit("a").alias("source"))
    some = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), 5)).alias("text"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    docs = same.unionByName(some)
    rows = mixing.mixed(docs.repartition(6))
    taken = rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    assert all(abs(r.t - r.g) <= 10 for r in taken.collect())
    again = mixing.mixed(docs.repartition(3))
    count = ["doc_id", "source", "copies"]
    assert {tuple(r) for r in rows.groupBy(*count).count().collect()} == {
        tuple(r) for r in again.groupBy(*count).count().collect()}
    numbered = mixing.numbered_copies(
        docs.select("doc_id", "source", F.lit(3).alias("size")), ["doc_id", "source", "size"],
        "nth")
    blocks = numbered.where("doc_id is null").select(F.pmod(
        F.xxhash64("doc_id", "size", "nth", F.lit("block")), F.lit(8)).alias("b"))
    sizes = [r["count"] for r in blocks.groupBy("b").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.3 * 6000 / 8


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=60), st.integers(0, 10**6),
       st.floats(0.05, 0.95))
def test_flight_moves_in_the_null_space(sizes, seed, chance):
    size = np.array(sizes, float)
    luck = np.random.default_rng(seed).random(len(sizes))
    p = mixing._decide(size, np.full(len(sizes), chance), luck)
    assert ((p >= 0) & (p <= 1)).all() and ((p > 0) & (p < 1)).sum() <= 2
    assert abs(p.sum() - chance * len(sizes)) < 1e-6
    assert abs((p * size).sum() - chance * size.sum()) < 1e-5 * size.sum()


# -- near duplicates ------------------------------------------------------------------

TEXT = " ".join(f"word{i}" for i in range(60))


def test_map_columns_and_repeated_rows(spark):
    rows = [(i, TEXT + f" end{i}", {"k": str(i)}) for i in range(4)]
    rows += [(0, TEXT + " end0", {"k": "0"})] * 50 + [(9, "something else entirely here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, about map<string,string>")
    kept = near_dedup.deduplicated(docs.repartition(4)).collect()
    assert sorted((r.doc_id, r.about) for r in kept) == [(0, {"k": "0"}), (9, None)]
    linked = near_dedup.linked(docs, 4).collect()
    assert Counter(r.component_id for r in linked) == {0: 54, 9: 1}


def test_one_of_the_rows_that_repeat_an_id_has_its_set_sent(spark):
    name = near_dedup.name
    node = name(near_dedup.shingles(TEXT.encode(), 4))
    rows = spark.createDataFrame(
        [(node, 1, TEXT)] * 40 + [(node, 1, "another text of that id, of some words")] +
        [(node, 1, TEXT)] * 3, "node long, group long, text string").coalesce(1)
    sets = rows.mapInArrow(
        near_dedup._with_sets(4), "node long, group long, set binary, light binary").collect()
    assert [r.node for r in sets] == [node]


# -- quality --------------------------------------------------------------------------

def plain_limits(values, groups):
    """Thresholds of one measure by sorting weighted bins, in whole numbers."""
    def low_end(v):
        cut = max(v.bit_length() - 6, 0)
        return v >> cut << cut

    bins = [low_end(v) for v in values]
    out = {}
    for lang, source in set(groups):
        n_all, n_lang, n = Counter(bins), Counter(), Counter()
        for b, (g, s) in zip(bins, groups, strict=True):
            n_lang[b] += g == lang
            n[b] += (g, s) == (lang, source)
        rows_all, rows_lang = sum(n_all.values()), sum(n_lang.values())
        weight = {b: n[b] * rows_lang * rows_all + quality.PRIOR * (
            n_lang[b] * rows_all + n_all[b] * rows_lang) for b in n_all}
        total = sum(weight.values())

        def quantile(percent, weight=weight, total=total):
            below = 0
            for b in sorted(weight):
                below += weight[b]
                if 100 * below >= percent * total:
                    return b
            raise AssertionError

        out[lang, source] = quantile
    return out


def test_thresholds_against_plain_quantiles(spark):
    rng = np.random.default_rng(7)
    rows = []
    for lang, source, n, scale in (("a", "x", 300, 4), ("a", "y", 20, 40), ("b", None, 90, 9),
                                   (None, "x", 1, 3)):
        rows += [(lang, source, int(v), int(w), int(v) // 2, 400 + int(w), False)
                 for v, w in rng.integers(0, 25 * scale, (n, 2))]
    frame = spark.createDataFrame(rows + [("z", "z", 9, 9, 9, 9, True)], (
        "lang string, source string, symbol_share long, dup_line_share long, "
        "repeat_share long, word_length long, base_failed boolean"))
    got = {(r.of_lang, r.of_source): r for r in quality.thresholds(frame).collect()}
    groups = [r[:2] for r in rows]
    assert set(got) == set(groups)
    for i, (measure, (low, high, times)) in enumerate(quality.RULES.items()):
        for group, quantile in plain_limits([r[2 + i] for r in rows], groups).items():
            top, middle = quantile(high), quantile(50)
            assert got[group][f"{measure}_hi"] == top + times * max(top - middle, quality.STEP)
            if low is not None:
                end = quantile(low)
                assert got[group][f"{measure}_lo"] == end - times * max(
                    middle - end, quality.STEP)
    assert len({tuple(r)[2:] for r in got.values()}) > 2


def test_no_size_at_which_thresholds_jump(spark):
    def limit(n):
        rows = [("a", "big", i % 7, 0, i % 9, 450 + i % 60, False) for i in range(2000)]
        rows += [("a", "small", 40 + i % 50, 0, i % 9, 300 + i % 60, False) for i in range(n)]
        frame = spark.createDataFrame(rows, (
            "lang string, source string, symbol_share long, dup_line_share long, "
            "repeat_share long, word_length long, base_failed boolean"))
        return next(r for r in quality.thresholds(frame).collect() if r.of_source == "small")

    small, near, over, large = (limit(n) for n in (2, 99, 101, 1500))
    for name in ("symbol_share_hi", "word_length_lo", "word_length_hi"):
        assert abs(near[name] - over[name]) <= 2 * quality.STEP  # a bin or two, not a jump
    assert small.symbol_share_hi < over.symbol_share_hi
    assert small.word_length_lo > large.word_length_lo


# -- toxicity, suffixes ----------------------------------------------------------------

def test_sentences_with_their_places():
    text = "  First one, here!\n\nThen İstanbul two. ... 123 ? last ΑΣ"
    placed = list(toxicity.placed_sentences(text))
    assert [text[a:b] for a, b, _ in placed] == [
        "First one, here", "Then İstanbul two", "last ΑΣ"]
    assert [w for _, _, w in placed] == toxicity.sentences(text)
    assert list(toxicity.placed_sentences("")) == []


def test_buckets_in_parts_stay_few(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_LARGE", 4)
    rows = [(b, p, 10 * (b + 1), b"x") for b in range(40) for p in range(5)]
    segments = spark.createDataFrame(
        rows, "bucket long, pack long, weight long, bundle binary")
    parts = suffix_dedup.in_parts(segments, 20)
    assert parts.count() == len(rows)
    large = parts.where("parts > 1").select("bucket").distinct().count()
    assert large <= 4
    monkeypatch.setattr(suffix_dedup, "MOST_LARGE", 1_000_000)
    assert suffix_dedup.in_parts(segments, 20).where("parts > 1").select(
        "bucket").distinct().count() > 30


# -- pages ----------------------------------------------------------------------------

LONG = ("The council met on Monday, and, after a long debate, agreed on the plan for the old "
        "harbour, which had been closed, as many recalled, for nine years.")
LINKS = "".join(f"<li><a href='/{i}'>Another headline of the day {i}</a></li>" for i in range(12))
TEMPLATES = {
    # No article element, no names: points and link density alone.
    "plain boxes": (
        f"<div><div><a href=1>Home</a> <a href=2>World</a> <a href=3>Sport</a></div>"
        f"<div><h1>Harbour</h1><p>{LONG}</p><p>{LONG} It was late.</p></div>"
        f"<div><ul>{LINKS}</ul></div></div>",
        ["Harbour", LONG, f"{LONG} It was late."]),
    "two articles": (
        f"<article><h2>Teaser</h2><p>Read more on this.</p></article>"
        f"<article><h1>Harbour</h1><p>{LONG}</p><p>{LONG}</p></article>",
        ["Harbour", LONG, LONG]),
    "an article of links beside the text": (
        f"<article><ul>{LINKS}</ul></article><div><p>{LONG}</p><p>{LONG}</p></div>",
        [LONG, LONG]),
    "nested containers": (
        f"<div><div><div><p>{LONG}</p></div><div><p>{LONG} Yes.</p></div>"
        f"<div><p>Tiny end.</p></div></div><div><ul>{LINKS}</ul></div></div>",
        [LONG, f"{LONG} Yes.", "Tiny end."]),
    "long comments": (
        f"<div class=story><p>{LONG}</p><p>{LONG}</p></div><div class=comments>"
        + "".join(f"<p>I think, well, no, yes, maybe, and so on, {i}.</p>" for i in range(30))
        + "</div>", [LONG, LONG]),
    "link list of another kind": (
        f"<section><p>{LONG}</p><p>{LONG}</p></section><div><p><a href=1>See</a> "
        f"<a href=2>also</a></p><ul>{LINKS}</ul></div>", [LONG, LONG]),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_templates(name):
    page, want = TEMPLATES[name]
    assert html_text.extract(f"<html><body>{page}</body></html>").split("\n\n") == want


def test_points_decide(monkeypatch):
    monkeypatch.setattr(html_text, "REACH", 0)
    wrong = [n for n, (page, want) in TEMPLATES.items() if html_text.extract(
        f"<html><body>{page}</body></html>").split("\n\n") != want]
    assert {"plain boxes", "two articles", "an article of links beside the text",
            "nested containers", "link list of another kind"} <= set(wrong)


def test_very_long_page():
    page = "<html><body><article>" + f"<p>{LONG}</p>" * 20_000 + "</article></body></html>"
    assert html_text.extract(page).count("\n\n") == 19_999


def test_stretches_of_a_pack_go_as_one_row():
    packs, nth = np.array([5, 5, -2, 5]), np.array([0, 3, 1, 2])
    lo, length = np.array([7, 0, 9, 2**31 - 99]), np.array([50, 60, 70, 80])
    batch = suffix_dedup._spans_by_pack(packs, nth, lo, length)
    assert batch.column(0).to_pylist() == [5, -2, 5]
    bodies = batch.column(1).to_pylist()
    assert suffix_dedup._spans(bodies[:2]).tolist() == [[0, 3, 1], [7, 0, 9], [50, 60, 70]]
    assert suffix_dedup._spans(bodies[2:]).tolist() == [[2], [2**31 - 99], [80]]
