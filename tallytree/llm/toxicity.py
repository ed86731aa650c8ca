"""Toxicity (5): multiple-instance learning; a document is toxic if some sentence is.

A sentence's score comes from its words and their beginnings; a document's score is the noisy-or of its
sentences': 1 - (1 - leak) * product of (1 - p). Only documents have labels, and the gradient of their
likelihood reaches the sentences through the noisy-or. p is taken relative to a sentence without any
evidence, which so adds nothing: a long clean document doesn't become toxic by its length.

Training uses at most ``per_class`` labelled rows of either class (documented bound), never held-out
ones. Candidate features are counted over that sample on the executors, and the ``vocabulary`` most
associated ones are kept; only their occurrences come to the driver. Defined results: null and empty
texts have no sentence and score the leak; without labels of both classes all texts score the share of
toxic labels; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD, PREFIXES, CACHE = 0.5, (4, 5, 6, 7), 300_000
_ENDS = b".!?\n"
#: Ends of sentences to a line end, other ASCII that isn't a letter to a space; other characters stay.
_FLAT = bytes(10 if b in _ENDS else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def sentences(text: bytes) -> list[list[bytes]]:
    """The words of each sentence that has any, lower-cased."""
    low = text.lower() if text.isascii() else text.decode().lower().encode()
    return [w for s in low.translate(_FLAT).split(b"\n") if (w := s.split())]


def word_features(word: bytes) -> list[bytes]:
    letters = word if word.isascii() else word.decode()
    return [word] + [b"^" + (letters[:n] if letters is word else letters[:n].encode()) for n in PREFIXES if len(letters) > n]


@dataclass
class NoisyOr:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = 0.0
    leak: float = 0.0  # -log of 1 - the leak's probability
    cache: dict[bytes, float] = field(default_factory=dict, repr=False)

    def evidence(self, word: bytes) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.cache[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return found

    def score(self, text: bytes) -> tuple[float, list[tuple[int, float]]]:
        """The document's score, and (sentence number, score) of each sentence with evidence."""
        total, found, get, base = self.leak, [], self.evidence, math.log1p(math.exp(self.bias))
        cached = self.cache.get
        for k, words in enumerate(sentences(text)):
            z = 0.0
            for w in words:
                e = cached(w)
                z += get(w) if e is None else e
            if z > 0:
                part = max(0.0, float(np.logaddexp(0, self.bias + z)) - base)
                total += part
                found.append((k, -math.expm1(-part)))
        return -math.expm1(-total), found


def fit(sentence: np.ndarray, feature: np.ndarray, doc_of: np.ndarray, y: np.ndarray, weight: np.ndarray, n_features: int, steps: int = 300, ridge: float = 0.02, rate: float = 0.1) -> tuple[np.ndarray, float, float]:
    """Weights (not negative), bias and leak; (sentence, feature) are the occurrences, doc_of a sentence's document.

    Minimises the weighted log loss of the noisy-or plus a ridge, by Adam with projection.
    """
    n_sentences, n_docs = len(doc_of), len(y)
    theta = np.concatenate([np.full(n_features, 0.5), [-3.0, -6.0]])  # weights, bias, log leak
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for t in range(1, steps + 1):
        w, bias, leak = theta[:-2], theta[-2], math.exp(theta[-1])
        z = bias + np.bincount(sentence, w[feature], n_sentences)
        part = np.logaddexp(0, z) - np.logaddexp(0, bias)
        s = leak + np.bincount(doc_of, part, n_docs)
        # loss: y=1: -log(1 - exp(-s)); y=0: s
        ds = weight * np.where(y > 0, -1 / np.expm1(np.clip(s, 1e-9, 500)), 1.0) / total
        dz = ds[doc_of] / (1 + np.exp(-z))
        db = (ds[doc_of] * (1 / (1 + np.exp(-z)) - 1 / (1 + math.exp(-bias)))).sum()
        grad = np.concatenate([np.bincount(feature, dz[sentence], n_features) + ridge * w / n_docs, [db, leak * ds.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta[:-2] = np.maximum(theta[:-2], 0)
        theta[-2] = np.clip(theta[-2], -12, 0)
        theta[-1] = np.clip(theta[-1], -9, -1)
    return theta[:-2], float(theta[-2]), math.exp(theta[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000, vocabulary: int = 2000) -> NoisyOr:
    sample = common.checkpointed(common.bounded_labels(docs, labels, label, per_class))
    sizes = dict(sample.groupBy("y").count().collect())
    if len(sizes) < 2:
        p = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        return NoisyOr(leak=-math.log1p(-p) if sizes else math.log(2))
    real = common.label_counts(labels, label)

    def distinct(batches):
        for batch in common.sliced(batches):
            rows = [(y, f) for y, text in zip(batch.column(1).to_pylist(), common.texts(batch.column(2)), strict=True) for f in {f for s in sentences(text) for w in set(s) for f in word_features(w)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["y", "f"])

    counts = sample.mapInArrow(distinct, "y int, f binary").groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    p1, p0 = (F.col("a") + 0.1) / sizes[1], (F.col("b") + 0.5) / sizes[0]
    # how far the share among toxic documents exceeds the other, in standard errors, and by what factor
    pooled = (F.col("a") + F.col("b") + 0.6) / (sizes[0] + sizes[1])
    z = (p1 - p0) / F.sqrt(pooled * (1 - pooled + 1e-6) * (1 / sizes[0] + 1 / sizes[1]))
    top = counts.where(F.col("a") >= 3).withColumn("z", z).where((F.col("z") > 3) & (p1 > 2 * p0)).orderBy(F.desc("z"), "f").limit(vocabulary)
    names = [bytes(r.f) for r in top.select("f").collect()]
    ids = {f: k for k, f in enumerate(names)}

    def occurrences(batches):
        for batch in common.sliced(batches):
            found = []
            for text in common.texts(batch.column(2)):
                found.append([(k, ids[f]) for k, s in enumerate(sentences(text)) for w in s for f in word_features(w) if f in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([[x[i] for x in r] for r in found], pa.list_(pa.int32())) for i in (0, 1))], names=["doc_id", "y", "s", "f"])

    rows = sorted((r.doc_id, r.y, r.s, r.f) for r in sample.mapInArrow(occurrences, "doc_id long, y int, s array<int>, f array<int>").collect())
    y = np.array([r[1] for r in rows], float)
    weight = np.where(y > 0, real[1] / sizes[1], real[0] / sizes[0])
    where: dict[tuple[int, int], int] = {}
    sentence = np.array([where.setdefault((d, s), len(where)) for d, r in enumerate(rows) for s in r[2]], np.int64)
    feature = np.array([f for r in rows for f in r[3]], np.int64)
    doc_of = np.array([d for d, _ in where], np.int64)
    w, bias, leak = fit(sentence, feature, doc_of, y, weight, len(names))
    return NoisyOr({f: float(x) for f, x in zip(names, w, strict=True) if x > 1e-4}, bias, leak)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, sentences array<int>"


def toxicity_scores(docs: DataFrame, model: NoisyOr, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences): the last has the numbers of the offending sentences, those of at least ``threshold``, or the worst one of a toxic text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        found = [shared.value.score(t) for t in common.texts(batch.column(1))]
        where = [[k for k, p in x if p >= threshold] or ([max(x, key=lambda v: v[1])[0]] if x and s >= threshold else []) for s, x in found]
        return {"doc_id": batch.column(0), "held_out": [common.is_held_out(x) for x in batch.column(0).to_pylist()], "score": [s for s, _ in found], "predicted": [int(s >= threshold) for s, _ in found], "sentences": where}

    return common.map_rows(common.id_and_text(docs), make, SCHEMA)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, common.table(spark, sf_dir, "labels")))
