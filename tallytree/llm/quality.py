"""Quality classifier (3): a generalised additive model with pairwise interactions.

Features are simple counts over the whole text. Each is cut into quantile bins; boosting goes round the
features in cycles and each time fits a shallow tree on one feature's histogram of gradients and adds it
to that feature's lookup table. Then the pairs of features whose quadrants explain most of what is left
get small two-dimensional tables in the same way. A score is the sum of table entries: scoring a batch
is a few vectorised additions.

Training uses at most ``per_class`` labelled rows of either class (documented bound; chosen by a hash of
doc_id, weighted back to the classes' real shares), never held-out ones. Everything else covers all
rows. Defined results: null and empty texts have the features of no text and are scored like any other;
without labels the score is 0.5; labels other than 0 and 1 and null ids aren't learned from; repeated
rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "bang", "other_punct", "newline", "non_ascii", "entropy",
    "distinct_words", "top_word", "repeat_4grams", "dup_lines", "ends_punct", "no_letter_words", "short_words", "longest_word", "line_words",
)
_CLASS = np.full(256, 5)
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&|<>^~=@_{}[]\\/+", b"!")):
    for _b in _chars:
        _CLASS[_b] = _k
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[128:] = 6, 7, 8


def features(text: bytes) -> list[float]:
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=9)
    words = text.split()
    k = len(words)
    if not k:
        return [math.log1p(n)] + [0.0] * (len(FEATURES) - 1)
    share = counts[counts > 0] / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    grams = len(set(zip(words, words[1:], words[2:], words[3:], strict=False)))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if kinds[7] else [text]
    visible = n - kinds[6] - kinds[7]
    lone = sum(c for w, c in seen.items() if not w.isalpha() and w.isascii() and not any(65 <= (b & 223) <= 90 for b in w))
    ends = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128)
    short = sum(c for w, c in seen.items() if len(w) <= 3)
    return [
        math.log1p(n), math.log1p(k), visible / k, kinds[0] / visible, kinds[2] / visible, kinds[3] / visible, kinds[4] / visible, kinds[5] / visible, kinds[7] / n, kinds[8] / visible,
        float(-(share * np.log2(share)).sum()), len(seen) / k, max(seen.values()) / k, 1 - grams / max(1, k - 3), 1 - len(set(lines)) / len(lines), ends / k, lone / k, short / k, math.log1p(max(map(len, seen))), math.log1p(k / len(lines)),
    ]


@dataclass
class Additive:
    """Cuts and lookup tables; everything a score needs."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], side="right")]
        for a, b, ca, cb, table in self.pairs:
            total += table[np.searchsorted(ca, x[:, a], side="right"), np.searchsorted(cb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A step function over bins: the shallow tree of at most ``leaves`` leaves, grown where the gain is largest."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = value(a, at) + value(at, b) - value(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (a, b), int(at[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = -(G[b] - G[a]) / (H[b] - H[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 120, bins: int = 48, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, leaves: int = 4, ridge: float = 2.0) -> Additive:
    model = Additive()
    if not len(y):
        return model
    p = (float(weight @ y) + 0.5) / (float(weight.sum()) + 1)
    model.intercept = math.log(p / (1 - p))
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if 0 < y.sum() < len(y):
        binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
        margin = np.full(len(y), model.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-margin))
            return weight * (q - y), weight * np.maximum(q * (1 - q), 1e-6)

        for _ in range(rounds):
            for table, b in zip(model.tables, binned, strict=True):
                g, h = slopes()
                step = rate * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), leaves, ridge)
                table += step
                margin += step[b]
        coarse = [np.unique(np.quantile(x[:, j], [0.125, 0.25, 0.5, 0.75, 0.875])) for j in range(x.shape[1])]
        cells = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
        g, h = slopes()
        gains = []
        for a in range(x.shape[1]):
            for b in range(a):
                wide = len(coarse[b]) + 1
                k, size = cells[a] * wide + cells[b], wide * (len(coarse[a]) + 1)
                G, H = np.bincount(k, g, size), np.bincount(k, h, size)
                gains.append((float((G**2 / (H + ridge)).sum()), a, b))
        for _, a, b in sorted(gains, reverse=True)[:pairs]:
            model.pairs.append((a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))))
        for _ in range(pair_rounds):
            for a, b, ca, cb, table in model.pairs:
                g, h = slopes()
                k, size = cells[a] * (len(cb) + 1) + cells[b], table.size
                G, H = (np.bincount(k, v, size).reshape(table.shape) for v in (g, h))
                # a shallow tree in two dimensions: split on the first feature, then each side on the second
                rows = _tree(G.sum(axis=1), H.sum(axis=1), 2, ridge)
                step = np.empty(table.shape)
                for v in np.unique(rows):
                    own = rows == v
                    step[own] = rate * _tree(G[own].sum(axis=0), H[own].sum(axis=0), 2, ridge)
                table += step
                margin += step.ravel()[k]
        shift = [float(t[b].mean()) for t, b in zip(model.tables, binned, strict=True)]
        for t, s in zip(model.tables, shift, strict=True):
            t -= s
        model.intercept += sum(shift)
    return model


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 8000) -> Additive:
    """The model of ``label``, from at most 2 * ``per_class`` rows' features, which are gathered on the driver."""
    sample = common.bounded_labels(docs, labels, label, per_class)
    names = ", ".join(f"f{j} double" for j in range(len(FEATURES)))

    def make(batch: pa.RecordBatch) -> dict:
        x = _matrix(common.texts(batch.column(2)))
        return {"doc_id": batch.column(0), "y": batch.column(1)} | {f"f{j}": x[:, j] for j in range(x.shape[1])}

    rows = common.map_rows(sample, make, f"doc_id long, y int, {names}").toArrow()
    data = np.column_stack([rows.column(k).to_numpy() for k in range(rows.num_columns)]) if rows.num_rows else np.zeros((0, len(FEATURES) + 2))
    data = data[np.lexsort(data.T[::-1])]
    real = common.label_counts(labels, label)
    y = data[:, 1]
    weight = np.ones(len(y))
    for kind in (0, 1):
        if (own := y == kind).any():
            weight[own] = real[kind] / own.sum()
    return fit(data[:, 2:], y, weight / weight.mean() if len(weight) else weight)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def quality_scores(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        score = shared.value.score(_matrix(common.texts(batch.column(1))))
        return {"doc_id": batch.column(0), "held_out": [common.is_held_out(x) for x in batch.column(0).to_pylist()], "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return common.map_rows(common.id_and_text(docs), make, SCHEMA)


def drop_low_quality(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all columns, that aren't rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.kept_rows(docs, lambda text: shared.value.score(_matrix(common.texts(text))) >= threshold)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, common.table(spark, sf_dir, "labels")))
