"""Language ID (6): a linear-chain conditional random field over the words of a text.

A word's emission scores sum the weights of its byte n-grams with the word's borders (so beginnings and
ends count as affixes) and of the word itself (lexicon); transitions between the languages of adjacent
words are learned. Forward-backward gives each word's posterior, so that code-switched texts get a label
for each word; a document's language is the one with the largest mean posterior, which is its score.
Emissions and forward-backward are vectorised over many texts at once. A text is one chain: it is worked on in
pieces of ``CHAIN`` words, and what passes from piece to piece is carried over by each piece's transfer matrix.

Training takes the whole texts of at most ``per_language`` documents of each language (documented bound,
chosen by a hash of doc_id), from rows that aren't held out, and joins spans of different documents to
chains, so that switches are seen. Defined results: null texts and texts without a letter
are ``und`` with score 0; so are all texts if nothing can be learned; null languages aren't learned
from; ties go to the language that sorts first; repeated rows are predicted one by one; other columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .hashing import mixed, rolled

CHAIN, GRAMS, BITS, RUN = 64, (2, 3, 4, 5), 18, 1 << 17
_FLAT = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; none if the text has no letter."""
    if text.isascii():
        return text.lower().translate(_FLAT).split()
    s = text.decode()
    return s.lower().encode().translate(_FLAT).split() if _LETTER.search(s) else []


def occurrences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of all features of all words, ordered by neither."""
    buf = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    space = buf == 32
    before = np.concatenate([[0], np.cumsum(space)])  # spaces before a position
    values, word, feature = _BYTES[buf], [], []
    for n in GRAMS:
        if len(buf) < n:
            continue
        at = np.flatnonzero(before[n - 1 : len(buf)] == before[1 : len(buf) - n + 2])  # no space inside
        h = mixed(rolled(values, n)[at] + np.uint64(n))
        word.append(before[at + 1] - 1)
        feature.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    starts = np.flatnonzero(space[:-1]) + 1
    inner = np.flatnonzero(~space)
    of = before[inner] - 1
    sums = np.add.reduceat(values[inner] * _POWERS[(inner - starts[of]) % len(_POWERS)], np.searchsorted(inner, starts))
    word.append(np.arange(len(words)))
    feature.append((mixed(sums) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(word), np.concatenate(feature)


@dataclass
class Chain:
    """languages, feature weights, transitions and scores of the first label."""

    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """(words, languages); n-gram by n-gram, so that no array has a row for each feature of all lengths."""
        k, n = len(self.languages), len(words)
        word, feature = occurrences(words)
        got = self.weights[feature]
        return np.column_stack([np.bincount(word, got[:, j], n) for j in range(k)])


def posteriors(emissions: np.ndarray, lengths: np.ndarray, steps: np.ndarray, first: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward over chains laid end to end: word posteriors, expected transitions and first labels, log partition.

    first: scores of the first label, for all chains or a row for each; last: the same of what follows the last label.
    """
    n, k = emissions.shape
    top = emissions.max(axis=1, keepdims=True)
    e = np.exp(emissions - top)
    A = np.exp(steps)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")  # the chains still running at step t are the first ones
    start, size = start[order], lengths[order]
    alpha, scale = np.empty((n, k)), np.empty(n)
    live = len(size)
    for t in range(int(size[0]) if live else 0):
        live = int(np.searchsorted(-size, -t, side="left"))
        at = start[:live] + t
        a = e[at] * (np.exp(first if first.ndim == 1 else first[order]) if t == 0 else alpha[at - 1] @ A)
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    beta = np.ones((n, k))
    if last is not None:
        ends = start + size - 1
        beta[ends] = np.exp(last[order])
        beta[ends] /= (alpha[ends] * beta[ends]).sum(axis=1, keepdims=True)
    moved = np.zeros((k, k))
    for t in range((int(size[0]) if len(size) else 0) - 2, -1, -1):
        live = int(np.searchsorted(-size, -(t + 1), side="left"))
        at = start[:live] + t
        nxt = e[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = nxt @ A.T
        moved += alpha[at].T @ nxt
    gamma = alpha * beta
    return gamma, moved * A, gamma[start].sum(axis=0), float(np.log(scale).sum() + top.sum())


def text_posteriors(emissions: np.ndarray, sizes: np.ndarray, steps: np.ndarray, first: np.ndarray, piece: int = CHAIN) -> np.ndarray:
    """Word posteriors of texts laid end to end, each of them one chain however long.

    All pieces' transfer matrices are made at once, then the scores at the pieces' borders follow from piece to piece.
    """
    k, A = emissions.shape[1], np.exp(steps)
    sizes = sizes[sizes > 0]
    pieces = -(-sizes // piece)
    heads = np.concatenate([[0], np.cumsum(pieces)[:-1]])  # the first piece of each text
    nth = np.arange(pieces.sum()) - np.repeat(heads, pieces)
    lengths = np.minimum(piece, np.repeat(sizes, pieces) - nth * piece)
    if len(lengths) == len(sizes):
        return posteriors(emissions, lengths, steps, first)[0]
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    order = np.argsort(-lengths, kind="stable")
    start, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    across = np.eye(k) * e[start][:, None, :]  # from a piece's first label to its last one, emissions included
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, side="left"))
        x = (across[:live].reshape(-1, k) @ A).reshape(live, k, k) * e[start[:live] + t][:, None, :]
        across[:live] = x / x.max(axis=(1, 2), keepdims=True)
    across[order] = across.copy()
    into, after = np.tile(np.exp(first), (len(lengths), 1)), np.ones((len(lengths), k))
    most = np.argsort(-pieces, kind="stable")
    count, head = pieces[most], heads[most]
    for j in range(1, int(count[0])):
        at = head[: int(np.searchsorted(-count, -j, side="left"))] + j
        x = (into[at - 1][:, None, :] @ across[at - 1])[:, 0] @ A
        into[at] = x / x.max(axis=1, keepdims=True)
    for j in range(int(count[0]) - 1, 0, -1):
        at = head[: int(np.searchsorted(-count, -j, side="left"))] + j
        x = (across[at] @ after[at][:, :, None])[:, :, 0] @ A.T
        after[at - 1] = x / x.max(axis=1, keepdims=True)
    return posteriors(emissions, lengths, steps, np.log(into), np.log(after))[0]


def fit(kinds: list[bytes], of: np.ndarray, gold: np.ndarray, lengths: np.ndarray, languages: list[str], rounds: int = 40, rate: float = 0.3, ridge: float = 1e-6) -> Chain:
    """Maximum likelihood by adaptive gradient steps over all chains at once.

    kinds: the different words; of, gold: number and language of each word of the chains, laid end to end.
    The gradient is summed up over runs of chains of about ``RUN`` words, so that memory has two small numbers a word.
    """
    k = len(languages)
    model = Chain(languages, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if k < 2 or not len(lengths):
        return model
    n, ends = len(of), np.cumsum(lengths)
    cuts = np.unique(np.searchsorted(ends, np.arange(RUN, n + RUN, RUN)).clip(max=len(ends) - 1) + 1)
    runs = [(a, b, int(ends[a] - lengths[a]), int(ends[b - 1])) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
    kind, feature = occurrences(kinds)
    inside = np.ones(n, bool)
    inside[ends - lengths] = False
    at = np.flatnonzero(inside)
    seen = np.bincount(gold[at - 1].astype(np.int64) * k + gold[at], minlength=k * k).reshape(k, k)
    W, squares = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-8)
    B, sb = np.zeros((k, k)), np.full((k, k), 1e-8)
    heads = np.bincount(gold[ends - lengths], minlength=k)
    S, ss = np.zeros(k), np.full(k, 1e-8)
    for _ in range(rounds):
        scores = np.column_stack([np.bincount(kind, W[feature, j], len(kinds)) for j in range(k)])
        by, moved, begun = np.zeros((len(kinds), k)), np.zeros((k, k)), np.zeros(k)
        for a, b, start, end in runs:
            own = of[start:end]
            diff, steps, starts, _ = posteriors(scores[own], lengths[a:b], B, S)
            diff[np.arange(end - start), gold[start:end]] -= 1
            by += np.column_stack([np.bincount(own, diff[:, j], len(kinds)) for j in range(k)])
            moved += steps
            begun += starts
        by /= n
        g = np.column_stack([np.bincount(feature, by[kind, j], 1 << BITS) for j in range(k)]) + ridge * W
        squares += g * g
        W -= rate * g / np.sqrt(squares)
        g = (moved - seen) / n
        sb += g * g
        B -= rate * g / np.sqrt(sb)
        g = (begun - heads) / n
        ss += g * g
        S -= rate * g / np.sqrt(ss)
    model.weights, model.steps, model.first = W.astype(np.float32), B, S
    return model


def train(docs: DataFrame, per_language: int = 500, seed: int = 7) -> Chain:
    """From the whole texts of at most ``per_language`` documents of each language; an id's least text if it has several.

    Two scans, however many languages there are: one ranks ids by a hash (each task passes on so many of a language at
    most, and no text), one reads the chosen texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & ~common.held_out(F.col("doc_id")))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("lang", "doc_id").withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= per_language).select("lang", "doc_id").distinct()

    def normal(batches):
        for batch in common.sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b" ".join(words_of(t)) for t in common.texts(batch.column(2))], pa.binary())], names=["doc_id", "lang", "text"])

    texts = rows.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = sorted((r.doc_id, r.lang, bytes(r.text)) for r in texts.mapInArrow(normal, "doc_id long, lang string, text binary").collect())
    languages = sorted({lang for _, lang, _ in found})
    found = [x for x in found if x[2]]
    rng = np.random.default_rng(seed)
    numbers: dict[bytes, int] = {}
    spans = []
    for _, lang, text in found:
        own = np.array([numbers.setdefault(w, len(numbers)) for w in text.split(b" ")], np.int32)
        at = 0
        while at < len(own):
            n = int(rng.integers(6, 32))
            spans.append((own[at : at + n], languages.index(lang)))
            at += n
    del found
    if not spans:
        return fit([], np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros(0, np.int64), languages)
    order = rng.permutation(len(spans)).tolist()
    sizes = np.array([len(spans[i][0]) for i in order], np.int64)
    gold = np.repeat(np.array([spans[i][1] for i in order], np.int16), sizes)
    # two spans to a chain, of one document or of two
    return fit(list(numbers), np.concatenate([spans[i][0] for i in order]), gold, np.add.reduceat(sizes, np.arange(0, len(sizes), 2)), languages)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


def _predict(model: Chain, texts: list[bytes]) -> tuple[list, list, list, list, list[np.ndarray]]:
    words = [words_of(t) for t in texts]
    n = len(words)
    sizes = np.array([len(w) for w in words], np.int64)
    if not len(model.languages) or not sizes.sum():
        return ["und"] * n, [0.0] * n, sizes.tolist(), [0] * n, [np.zeros(s, np.int64) for s in sizes]
    flat = [w for x in words for w in x]
    gamma = text_posteriors(model.emissions(flat), sizes, model.steps, model.first)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    best = gamma.argmax(axis=1)
    lang, score, switches, labels = [], [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        labels.append(best[a:b])
        if a == b:
            lang.append("und"), score.append(0.0), switches.append(0)
            continue
        mean = gamma[a:b].mean(axis=0)
        j = int(mean.argmax())
        lang.append(model.languages[j]), score.append(min(1.0, float(mean[j]))), switches.append(int((best[a + 1 : b] != best[a : b - 1]).sum()))
    return lang, score, sizes.tolist(), switches, labels


def language_scores(docs: DataFrame, model: Chain) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, n_switches) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        lang, score, words, switches, _ = _predict(shared.value, common.texts(batch.column(1)))
        return {"doc_id": batch.column(0), "held_out": [common.is_held_out(x) for x in batch.column(0).to_pylist()], "lang_pred": lang, "score": score, "n_words": words, "n_switches": switches}

    return common.map_rows(common.id_and_text(docs), make, SCHEMA, most=1 << 20)


def label_words(model: Chain, text: str) -> list[tuple[str, str]]:
    """Each word of a text with its language."""
    words = words_of(text.encode())
    return [(w.decode(), model.languages[j]) for w, j in zip(words, _predict(model, [text.encode()])[4][0], strict=True)]


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return language_scores(docs, train(docs))
