"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's score is a logistic function of its words and of their beginnings. Sentence scores are combined by
noisy-or, 1 - prod(1 - s), and the weights are trained from document labels alone, by
following the gradient of that combined likelihood. The same weights then score single
sentences, which locates the offending ones.

The classifier is fitted on SAMPLE labelled documents at most (those with the smallest hash
of the id, among the ones that are not held out); every document is scored whole.

Defined cases: a null or empty text has no sentences and gets the model's base score;
labels that are null or not of a document teach nothing; a document with several labels
teaches its greatest; rows that share a doc_id are scored each; without any label of either
kind the score is the share of toxic labels (0 if none); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 10_000  # labelled documents to learn from, at most
FEATURES = 4096  # words and beginnings with a weight, at most
LEAST_DOCS = 4  # sampled documents that a feature needs
STEPS = 300
RATE = 0.1
DECAY = 2e-4  # of squared weights
PREFIXES = (4, 5, 6, 7, 8)  # lengths of beginnings that are features beside the word
CACHE = 300_000  # words whose features a worker remembers
TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]+")
STOP = frozenset(".!?\n")


def held_out(doc_id: Column) -> Column:
    """The fifth of documents whose labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, lower case."""
    out: list[list[str]] = [[]]
    for token in TOKENS.findall(text.lower()):
        if token[0] in STOP:
            out.append([])
        else:
            out[-1].append(token)
    return [s for s in out if s]


def placed_sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start and end in the text, and words, of each sentence that has words."""
    start = 0
    for end in [m.start() for m in re.finditer(r"[.!?\n]", text)] + [len(text)]:
        part = text[start:end]
        words = sentences(part)
        if words:
            lead = len(part) - len(part.lstrip())
            yield start + lead, start + len(part.rstrip()), words[0]
        start = end + 1


def features(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


class Model:
    """Weights of features, the bias of a sentence, and the base rate of a document."""

    def __init__(self, weights: dict[str, float], bias: float, base: float):
        self.weights, self.bias, self.base = weights, bias, base
        self.known: dict[str, tuple[str, ...]] = {}

    def known_features(self, word: str) -> tuple[str, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = tuple(f for f in features(word) if f in self.weights)
            self.known[word] = found
        return found

    def logit(self, words: list[str]) -> float | None:
        """Of a sentence; None if no feature of it has a weight."""
        found = {f for w in words for f in self.known_features(w)}
        return self.bias + sum(self.weights[f] for f in sorted(found)) if found else None

    def score(self, text: str) -> float:
        """1 - (1 - base) * prod(1 - sentence score), over sentences with a known feature."""
        logits = [x for s in sentences(text) if (x := self.logit(s)) is not None]
        loud = float(np.logaddexp(0.0, logits).sum()) if logits else 0.0
        return float(-np.expm1(np.log1p(-self.base) - loud))


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Train by gradient steps on the likelihood of the document labels."""
    n, positive = len(texts), int(toxic.sum())
    if not 0 < positive < n:
        return Model({}, -20.0, min(0.999, positive / n if n else 0.0))
    split = [sentences(t) for t in texts]
    seen, seen_toxic = Counter(), Counter()
    for doc, y in zip(split, toxic, strict=True):
        words = {f for w in {w for s in doc for w in s} for f in features(w)}
        seen.update(words)
        if y:
            seen_toxic.update(words)
    rate = positive / n
    # Deviation of a feature's toxic documents from chance, in standard deviations.
    lean = {w: (seen_toxic[w] - m * rate) / (m * rate * (1 - rate)) ** 0.5
            for w, m in seen.items() if m >= LEAST_DOCS}
    words = sorted(lean, key=lambda w: (-abs(lean[w]), w))[:FEATURES]
    number = {w: i for i, w in enumerate(words)}
    doc_of, sent_of, word_of = [], [], []
    for d, doc in enumerate(split):
        for s in doc:
            known = {number[f] for w in s for f in features(w) if f in number}
            if known:
                sent_of += [len(doc_of)] * len(known)
                word_of += known
                doc_of.append(d)
    doc_of, sent_of, word_of = (np.array(x, np.int64) for x in (doc_of, sent_of, word_of))
    w, bias, leak = np.zeros(len(words)), -4.0, np.log(rate / 2)
    m1, m2 = np.zeros(len(words) + 2), np.zeros(len(words) + 2)
    for step in range(1, STEPS + 1):
        logit = bias + np.bincount(sent_of, w[word_of], len(doc_of))
        quiet = np.bincount(doc_of, np.logaddexp(0, logit), n) - np.log1p(-np.exp(leak))
        pull = np.where(toxic == 1, -1 / np.expm1(np.maximum(quiet, 1e-9)), 1.0)
        back = pull[doc_of] / (1 + np.exp(-logit))
        grad = np.bincount(word_of, back[sent_of], len(words)) / n + DECAY * w
        base = np.exp(leak)
        grad = np.append(grad, [back.sum() / n, pull.sum() / n * base / (1 - base)])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-2], bias - move[-2]
        leak = min(leak - move[-1], np.log(0.4))
    return Model({x: float(v) for x, v in zip(words, w, strict=True) if abs(v) > 0.05},
                 float(bias), float(np.exp(leak)))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SAMPLE labelled documents at most, none of them held out: text and label."""
    marks = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("of"), "of").limit(SAMPLE)
    # SAMPLE rows of ids and labels: a bounded broadcast. Rows that share an id count once.
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
        .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    )


def _fit_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("doc_id", kind="stable")
    model = fit(rows["text"].tolist(), rows["toxic"].to_numpy())
    return pd.DataFrame({
        "word": ["\0bias", "\0base", *model.weights],
        "weight": [model.bias, model.base, *model.weights.values()]})


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample in one task; FEATURES weights come back."""
    rows = training_sample(docs, labels).groupBy().applyInPandas(
        _fit_group, "word string, weight double").collect()
    weights = {r["word"]: r["weight"] for r in rows}
    bias, base = weights.pop("\0bias", -20.0), weights.pop("\0base", 0.0)
    return Model(weights, bias, base)


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score, and whether it is predicted toxic."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double").select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The sentences that score `least` or more: doc_id, start, end, words, score.

    start and end are places in the text, in code points: text[start:end] is the sentence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for start, end, s in placed_sentences(text.as_py() or ""):
                    logit = model.logit(s)
                    score = 0.0 if logit is None else float(1 / (1 + np.exp(-logit)))
                    if score >= least:
                        found.append((doc_id, start, end, " ".join(s), score))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()),
                 pa.array([x[1] for x in found], pa.int64()),
                 pa.array([x[2] for x in found], pa.int64()),
                 pa.array([x[3] for x in found], pa.string()),
                 pa.array([x[4] for x in found], pa.float64())],
                names=["doc_id", "start", "end", "words", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, end long, words string, score double")
