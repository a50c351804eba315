"""Each operator on the sample documents against a plain version or a model of its results."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from closebooks.llm import bpe, html_text, queries, suffix_dedup, toxicity
from closebooks.llm.components import components
from tests.conftest import SF_DIR
from tests.test_oracle import TABLES, canonical

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def run(spark, name):
    return queries.queries()[name](spark, SF_DIR).collect()


def test_registered():
    names = entry_point.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == [
        *range(1, 14)]
    assert "pipeline" in names and set(entry_point.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    got = queries.queries()[name](spark, SF_DIR)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(
        want.fetchall(), columns)


def test_line_dedup(spark, texts):
    holders = defaultdict(set)
    for i, text in texts.items():
        for line in text.split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= 10:
                holders[key].add(i)
    want = set()
    for i, text in texts.items():
        lines = text.split("\n")
        kept = [x for x in lines if min(holders.get(x.strip(SPACE).translate(LOWER), {i})) == i]
        want.add((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    rows = run(spark, "op1_line_dedup")
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == want
    assert any(r.n_dropped for r in rows)


def test_sharding(spark, texts):
    rows = run(spark, "op2_sharding")
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert all(r.grown_shard in (r.shard, 8) for r in rows)


def test_near_dedup(spark, texts):
    sets = {}
    for i, text in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", text.translate(LOWER))
        sets[i] = {tuple(words[k:k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    least = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(pairs)):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    rows = run(spark, "op3_near_dedup")
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == {
        (i, len(s), least[i], least[i] == i) for i, s in sets.items()}
    assert pairs


def test_html_blocks_of_every_article(spark):
    import html as references

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in run(spark, "op4_html_text"):
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S).group(1)
        blocks = (references.unescape(re.sub(r"<[^>]*>", " ", x))
                  for x in re.split(r"</?(?:p|h1)>", article))
        blocks = [re.sub(r"[\x20\x09-\x0d]+", " ", x).strip(" ") for x in blocks]
        assert r.text == "\n\n".join(x for x in blocks if x)
        assert r.n_chars == len(r.text)


PAGE = """<html><body class="has-sidebar"><div class="wrap with-sidebar">
<header class="site"><a href=/>Home</a><p>Tagline of the site, welcome.</p></header>
<div id="cookie-notice"><p>We use cookies, lots of them, to improve, really, everything.</p></div>
<div class="content"><h1>Head &amp; line</h1><p>First paragraph, with some commas, and text.
<p>Second one, also long enough, with <a href=x>a link</a> in it, <b>and</b> so on.
<ul><li>item one<li>item two</ul><form><input><p>Sign up, please</p></form>
<script>var t = "</p>";</script><!-- gone --></div>
<div class="sidebar"><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div>
<section id="comments"><p>Nice post, thanks, a lot, really, a long comment, so many, commas.</p>
</section><footer>bye</footer></div></body></html>"""


def test_html_without_article_element():
    assert html_text.extract(PAGE).split("\n\n") == [
        "Head & line", "First paragraph, with some commas, and text.",
        "Second one, also long enough, with a link in it, and so on.", "item one", "item two"]


def test_html_article_head_and_silent_parts():
    page = """<body><div class="page-header"><h1>Site</h1></div><article>
    <div class="article-header"><h1>Title</h1><p>by someone, yesterday</p></div>
    <p>Text <button>Share</button>with <span class="ad">Buy!</span>a <i title="a hidden gem">gem</i>
    <span hidden>secret</span>in it.</p><p hidden>no</p><table><tr><th class="header">One</th>
    <td>Two</td></tr></table></article></body>"""
    assert html_text.extract(page).split("\n\n") == [
        "Title", "Text with a gem in it.", "One", "Two"]


def test_suffix_dedup(spark, texts, monkeypatch):
    owner = {}
    for i in sorted(texts):
        data = texts[i].encode()
        for p in range(len(data) - 49):
            owner.setdefault(data[p:p + 50], i)
    want = set()
    for i, text in texts.items():
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if owner[data[p:p + 50]] < i:
                gone[p:p + 50] = True
        spans = int((np.diff(gone, prepend=False) & gone).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        want.add((i, len(data), int(gone.sum()), spans, sha(kept)))
    rows = run(spark, "op6_suffix_dedup")
    assert {tuple(r) for r in rows} == want and any(r.n_removed for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(2, 255))
def test_suffix_array_and_prefixes(raw, letters):
    data = np.frombuffer(bytes(x % letters for x in raw + raw[:70]), np.uint8)
    text = data.tobytes()
    order = suffix_dedup.suffix_array(data)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    shared = suffix_dedup.common_prefixes(data, order)
    for k in range(1, len(text)):
        a, b = text[order[k]:][:50], text[order[k - 1]:][:50]
        n = min(len(a), len(b))
        assert shared[k] == next((i for i in range(n) if a[i] != b[i]), n)


def test_runs_merge_like_one():
    rng = np.random.default_rng(5)
    base = bytes(rng.integers(97, 100, 400).astype(np.uint8))
    parts = [base[a:a + 90] for a in rng.integers(0, 300, 40).tolist()]
    owners = rng.integers(0, 1000, 40)
    whole = suffix_dedup.Run(parts, owners)
    halves = [suffix_dedup.Run(parts[:13], owners[:13]), suffix_dedup.Run(parts[13:], owners[13:])]
    suffix_dedup.merge(halves)
    best = np.concatenate([r.owner[r.group] for r in halves])
    for k, start in enumerate(whole.start.tolist()):
        inside = slice(start, start + whole.length[k] - 49)
        assert (whole.owner[whole.group][inside] == best[inside]).all()


def test_a_passage_of_many_documents_is_dealt_over_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    passage = bytes(rng.integers(97, 123, 120).astype(np.uint8)).decode()

    def noise(n):
        return "".join(map(chr, rng.integers(97, 123, n)))

    texts = {i: noise(60) + passage + noise(60) for i in range(1500)}
    texts |= {2000 + i: noise(2) + passage + noise(2) for i in range(600)}
    owner, want, loads = {}, set(), []
    for i, text in texts.items():
        for p in range(len(text) - 49):
            owner.setdefault(text[p:p + 50], i)
    for i, text in texts.items():
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 49):
            if owner[text[p:p + 50]] < i:
                gone[p:p + 50] = True
        want.add((i, int(gone.sum()), "".join(c for c, g in zip(text, gone, strict=True) if not g)))

    def in_parts(*given):
        out = dealt(*given)
        loads.append(out.groupBy("bucket", "part").agg(F.sum("weight").alias("n")).collect())
        return out

    dealt = suffix_dedup.in_parts
    monkeypatch.setattr(suffix_dedup, "in_parts", in_parts)
    frame = spark.createDataFrame(texts.items(), "doc_id long, text string").repartition(40)
    rows = suffix_dedup.without_repeats(frame, 20_000).collect()
    assert {(r.doc_id, r.n_removed, bytes(r.kept).decode()) for r in rows} == want
    assert len(loads) == 1 and max(r.part for r in loads[0]) > 5
    whole = max(sum(r.n for r in loads[0] if r.bucket == b) for b in {r.bucket for r in loads[0]})
    assert whole > 100_000 and max(r.n for r in loads[0]) < 40_000


def test_toxicity_on_held_out_labels(spark):
    words = ["ape", "bat", "cat", "dog", "eel", "fox", "gnu", "hen"]
    rng = np.random.default_rng(3)
    docs, marks = [], []
    for i in range(1200):
        body = [" ".join(rng.choice(words, 6)) for _ in range(int(rng.integers(1, 6)))]
        bad = i % 5 == 0
        if bad:
            body[int(rng.integers(len(body)))] += " vermin" if i % 2 else " scoundrels"
        docs.append((i, ". ".join(body)))
        marks.append((i, int(bad)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    rows = toxicity.scored(frame, labels).collect()
    truth = dict(marks)
    assert all(r.predicted == truth[r.doc_id] for r in rows if r.held_out)
    found = toxicity.offending(frame, toxicity.train(frame, labels)).collect()
    assert found and all("vermin" in r.words or "scoundrels" in r.words for r in found)


@pytest.fixture(scope="module")
def both():
    return bpe.Bpe(bpe.read_spec(queries.TOKENIZER)), Tokenizer.from_file(queries.TOKENIZER)


def test_bpe_on_documents(spark, texts, both):
    for r in run(spark, "op9_bpe"):
        ids = both[1].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids))),
            sha(both[1].decode(ids, skip_special_tokens=False)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    *"abcdehinorstABÉéßΣσİ'’ \t\n\x1c\x85\xa001½!?.,-<|>🙂中", "<|endoftext|>", "'re", "the", "ing",
    "tion"]), max_size=60).map("".join))
def test_bpe_on_any_text(both, text):
    want = both[1].encode(text, add_special_tokens=False).ids
    got = both[0].encode(text)
    assert got.tolist() == want
    assert both[0].decode(got).decode() == both[1].decode(want, skip_special_tokens=False)


def test_components(spark):
    rng = np.random.default_rng(11)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [
        (1000 + i, 1001 + i) for i in range(40)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame(edges, "u long, v long"), "test").collect()
    assert {(r.node, r.component) for r in got} == set(least.items())
    none = spark.createDataFrame([], "u long, v long")
    assert components(none, "test").count() == 0


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), "test")
        assert docs.columns == columns
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    want = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in
                  corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect())
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in rows) == want
    assert left and left < set(texts)
