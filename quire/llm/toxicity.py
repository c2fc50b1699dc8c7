"""Operator 9: toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is logistic in the features of its distinct folded words (a word and its prefixes, for insults
are also inflected and joined to other words); a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only documents are labelled: the gradient of the document likelihood shares the blame among the
sentences in proportion to p. The trained weights then score and locate sentences.

Training takes a bounded sample of labelled rows (``per_class``, chosen by hash), whole texts. Defined results: null or
empty text scores the bias of no sentence, 0; without labelled rows of both classes every score is 0; several labels of
one document count once (its greatest); repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_slices
from quire.llm.langid import held_out

_SENTENCE = re.compile(r"[\n.!?]+")
_EDGE = ".,;:!?()[]{}\"'`|*#&%$@<>~+-=_/\\"


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if not s.isspace() and s]


def words(sentence: str) -> set[str]:
    return {w for x in sentence.lower().split() if (w := x.strip(_EDGE))}


def features(word: str) -> list[str]:
    """The word and its prefixes of three to seven characters, marked as such."""
    return [word, *(word[:n] + "-" for n in range(3, min(7, len(word)) + 1))]


def train(rows: list[tuple[str, int]], *, least: int = 5, epochs: int = 80, rate: float = 0.3, l2: float = 2e-3, bias: float = -6.0) -> tuple[dict[str, float], float]:
    """Weights of features and the bias, from (text, 0 or 1) rows; features in fewer than ``least`` documents are left out."""
    rows = sorted(rows)
    labels = np.array([y for _, y in rows], dtype=float)
    if not len(rows) or labels.min() == labels.max():
        return {}, -50.0
    bags = [[words(s) for s in sentences(t)] for t, _ in rows]
    seen: dict[str, int] = {}
    for bag in bags:
        for f in {f for w in set().union(*bag) for f in features(w)}:
            seen[f] = seen.get(f, 0) + 1
    index = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= least))}
    word, sent, owner = array("i"), array("i"), array("i")
    for d, bag in enumerate(bags):
        for s in bag:
            found = [index[f] for w in s for f in features(w) if f in index]
            word.extend(found)
            sent.extend([len(owner)] * len(found))
            owner.append(d)
    del bags, seen
    word, sent, owner = (np.frombuffer(x, dtype=np.int32) for x in (word, sent, owner))
    weights, b = np.zeros(len(index)), bias
    g2, b2 = np.full(len(index), 1e-8), 1e-8
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(epochs):
        score = np.bincount(sent, weights[word], len(owner)) + b
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(rows))
        whole = -np.expm1(none)
        # d log-likelihood / d score of a sentence: p (y / P - 1) where P is the document's noisy-or
        pull = p * ((balance * labels / np.maximum(whole, 1e-9))[owner] - balance[owner])
        grad = np.bincount(word, pull[sent], len(index)) / len(rows) - l2 * weights / max(1, len(index)) ** 0.5
        grad_b = pull.sum() / len(rows)
        g2 = 0.9 * g2 + 0.1 * grad**2
        b2 = 0.9 * b2 + 0.1 * grad_b**2
        weights += rate * grad / np.sqrt(g2 + 1e-10)
        b = min(-2.0, b + 0.1 * grad_b / np.sqrt(b2 + 1e-10))
    return {w: float(weights[i]) for w, i in index.items() if abs(weights[i]) > 1e-3}, float(b)


def word_score(word: str, weights: dict[str, float]) -> float:
    return sum(weights.get(f, 0.0) for f in features(word))


class WordScores(dict):
    """Scores of words, with a bound on what is remembered."""

    def __init__(self, weights: dict[str, float], bound: int = 500_000):
        super().__init__()
        self.weights, self.bound = weights, bound

    def __missing__(self, word: str) -> float:
        value = word_score(word, self.weights)
        if len(self) < self.bound:
            self[word] = value
        return value


def sentence_scores(text: str | None, weights: dict[str, float], bias: float) -> list[tuple[str, float]]:
    """Sentences with their probabilities: where a document offends."""
    found = sentences(text)
    return [(s, float(1 / (1 + np.exp(-np.clip(bias + sum(word_score(w, weights) for w in sorted(words(s))), -30, 30))))) for s in found]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> list[tuple[str, int]]:
    ids = labels.where(F.col("toxic").isNotNull() & ~F.coalesce(held_out(4), F.lit(True))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    parts = [ids.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    picked = parts[0].unionByName(parts[1])  # two bounded samples
    texts = docs.select(F.col("doc_id").alias("doc_id"), "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    return [(r.text, r.toxic) for r in texts.select("text", "toxic").collect()]


def toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 1200, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, worst (the sentence that offends most, null below the threshold)."""
    weights, bias = train(labelled_sample(docs, labels, per_class))
    shipped = docs.sparkSession.sparkContext.broadcast((weights, bias))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shipped.value
        scored = WordScores(weights)
        for part in text_slices(batches, cache=scored):
            scores, worst = [], []
            for text in part.column("text").to_pylist():
                found = sentences(text)
                z = np.array([bias + math.fsum(map(scored.__getitem__, words(s))) for s in found])
                scores.append(float(-np.expm1(-np.logaddexp(0.0, z).sum())))
                worst.append(found[int(z.argmax())] if scores[-1] >= threshold else None)
            yield pa.record_batch([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(worst, pa.string())], names=["doc_id", "score", "worst"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, worst string")
    return found.select("doc_id", F.coalesce(held_out(4), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst")
