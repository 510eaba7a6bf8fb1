"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A document is a bag of sentences (cut after ``.!?`` and at line ends). A sentence's score is the logistic of a fixed bias
plus the weights of its distinct words, each with the weights of its beginnings of 4 and 5 letters; a document's score is the noisy-or of its sentences, 1 - prod(1 - p). The weights
follow from document labels alone (full-batch Adam on the cross entropy of the noisy-or, with L1 shrinkage), and then
sentence scores say where the offence is.

The model is fitted on the driver on a bounded sample: of the labelled training rows of at most ``SAMPLE_BYTES`` bytes,
the ``SAMPLE`` ids of each label with the smallest 64-bit hash; of rows that share an id, those with the smallest hash of id and
text, in that order, up to twice ``SAMPLE`` rows in all. Scoring covers every whole text.

Defined cases: null and empty texts have one empty sentence, hence the bias' score; without training rows of both labels
scores are the training share of label 1 (0.5 without any rows); several labels of one doc_id count as the largest;
repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, utf8
from gridloom.llm.quality import held_out

#: Training documents of each label, and bytes of each, at most.
SAMPLE, SAMPLE_BYTES = 2500, 12_000
#: Words in fewer training documents get no weight.
LEAST_DOCS = 5
STEPS, RATE, SHRINK = 150, 0.2, 4e-4
#: Logit of a sentence without known words: so low that thousands of clean sentences don't add up to an offence.
BIAS = -10.0
#: Words whose weights a worker keeps.
KEPT_WORDS = 300_000
THRESHOLD = 0.5
#: Sentences from this score on count as offending.
OFFENDS = 0.5

_CUT = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[str]:
    """The text's sentences, blank ones left out; one empty sentence if there is none."""
    return [s for s in _CUT.split(text) if s and not s.isspace()] or [""]


def parts(word: str) -> list[str]:
    """A word's features: itself and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in (4, 5) if len(word) > n)]


class Instances:
    """A fitted model: weight of each known feature, and the share of label 1 where nothing could be learned."""

    def __init__(self, weights: dict[str, float] | None = None, share: float | None = None):
        self.weights, self.share = weights or {}, share
        self.words = _Words(self.weights)

    def __reduce__(self):
        return Instances, (self.weights, self.share)

    def sentence_scores(self, text: str) -> tuple[list[str], np.ndarray]:
        own, weight = sentences(text), self.words.__getitem__
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        z = np.array([sum(map(weight, set(_WORD.findall(s)))) for s in map(str.lower, own)])
        return own, 1 / (1 + np.exp(-np.clip(z + BIAS, -60, 60)))


class _Words(dict):
    """Total weight of words that were met."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        # Rounded, so that the order of a sentence's words doesn't show in its sum.
        self[word] = total = round(sum(self.weights.get(f, 0.0) for f in parts(word)) * 1024) / 1024
        return total


def noisy_or(p: np.ndarray) -> float:
    """1 - prod(1 - p)."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def train(texts: list[str], labels: list[int]) -> Instances:
    """Weights from whole documents and their labels."""
    positive = sum(labels)
    if not 0 < positive < len(labels):
        return Instances(share=positive / len(labels) if labels else 0.5)
    bags = [[set(_WORD.findall(s.lower())) for s in sentences(t)] for t in texts]
    seen: dict[str, int] = {}
    for bag in bags:
        for f in {f for w in set().union(*bag) for f in parts(w)}:
            seen[f] = seen.get(f, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_DOCS))}
    words, sentence_of, doc_of, s = [], [], [], 0
    for d, bag in enumerate(bags):
        for own in bag:
            ids = [vocabulary[f] for w in sorted(own) for f in parts(w) if f in vocabulary]
            words += ids
            sentence_of += [s] * len(ids)
            doc_of.append(d)
            s += 1
    words, sentence_of, doc_of = np.array(words, np.int64), np.array(sentence_of, np.int64), np.array(doc_of, np.int64)
    y = np.array(labels, float)
    # Both labels weigh the same in the loss, whatever their shares in the sample.
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (len(y) - positive))
    w = np.zeros(len(vocabulary))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = BIAS + np.bincount(sentence_of, w[words], s)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        clean = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))  # of no offence in the document
        # Gradient of the cross entropy by the sentence's logit: p for clean documents, -p * clean / (1 - clean) for others.
        pull = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * weight
        g = p * pull[doc_of]
        gw = np.bincount(words, g[sentence_of], len(w))
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        at = RATE / (1 - 0.9**step)
        root = 1 - 0.999**step
        w = w - at * m / (np.sqrt(v / root) + 1e-7)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SHRINK / (np.sqrt(v / root) + 1e-6), 0)
    kept = {word: float(w[i]) for word, i in vocabulary.items() if abs(w[i]) > 1e-3}
    return Instances(kept)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", out: Column | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Instances:
    """The model from the bounded sample; rows for which ``out`` holds don't train."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.octet_length("text") <= sample_bytes)
    rows = rows.where(~out) if out is not None else rows
    texts, ys = [], []
    chosen = [known.where(F.col("y") == y).join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    ids = chosen[0].union(chosen[1])  # at most 2 * sample rows
    for text, y in rows.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(2 * sample).select("text", "y").toLocalIterator():
        texts.append(text)
        ys.append(int(y))
    return train(texts, ys)


def score(docs: DataFrame, model: Instances, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, worst_sentence (0-based), worst_score, offending (array of sentence indexes) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for raw in utf8(batch.column(1)):
            text = raw.decode("utf-8", "replace")
            own, p = model.sentence_scores(text)
            worst = int(p.argmax())
            row = (noisy_or(p) if model.share is None else model.share, len(own), worst, float(p[worst]), np.flatnonzero(p >= OFFENDS).tolist())
            for c, x in zip(cols, row, strict=True):
                c.append(x)
        kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "score", "n_sentences", "worst_sentence", "worst_score", "offending"])

    schema = f"doc_id {kind}, score double, n_sentences long, worst_sentence long, worst_score double, offending array<long>"
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), each, schema)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 5, rest: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of each document."""
    out = held_out("doc_id", modulus, rest)
    model = fit(docs, labels, label_col, out)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_score", "offending")
