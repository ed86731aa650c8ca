"""Quality rules (9): base counts, and repeated passages found with a suffix array.

A suffix array over the words of a text, with its longest-common-prefix array, gives every repeated run of
words as an LCP interval: as many suffixes in a row as have it in common. Intervals whose suffixes don't
all have one word before them are the maximal repeats. The union of the spans of those of at least
``min_repeat`` words is the covered part; a document is rejected if that is more than ``most_covered`` per
cent of its words or if its longest repeat has over ``longest`` words. A suffix gives a span only for the
deepest interval that it is in: the others' spans start there too and are shorter. If that one isn't
maximal, the interval of the suffixes one word to the left covers more. So the work is linear, also in
texts of one word over and over, whose intervals are all nested.

Everything is per document: no shuffle. Many documents are sorted at once, about a megabyte of text: the
first rank of a suffix is its (document, word) pair, so that no two documents ever share a rank. A longer
text is sorted alone and whole, with some 8 (3 + log2 of its longest repeat) bytes a word.

Defined results: null and empty texts have no words and fail the base rule. Repeated rows and equal
ids are judged row by row. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Base rule: fewer words than this fail, or more than MOST_REPEATED per cent of words in repeated windows.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30


@dataclass(frozen=True)
class Limits:
    min_repeat: int = 16
    most_covered: int = 25
    longest: int = 100


SYMBOL = re.compile(rb"[#*$%&|<>]")


def suffix_array(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array (lcp[k]: of suffixes k-1 and k) of a row of ranks, by prefix doubling.

    Each round sorts the still undecided suffixes alone. The ranks of all rounds are kept, and the LCP
    of neighbours is read from them by halving steps.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    ranked = first[order]
    new = np.empty(n, bool)
    if n:
        new[0] = True
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = start
    rank[n] = -1
    levels, h = [rank.copy()], 1
    while True:
        starts = np.flatnonzero(np.append(new, True))
        alone = np.diff(starts) == 1
        open_ = ~np.repeat(alone, np.diff(starts))
        slots = np.flatnonzero(open_)
        if not len(slots):
            break
        here = order[slots]
        key = rank[here] * np.int64(n + 1) + rank[np.minimum(here + h, n)] + 1
        by = np.argsort(key, kind="stable")
        here, key = here[by], key[by]
        order[slots] = here
        changed = np.empty(len(slots), bool)
        changed[0] = True
        np.not_equal(key[1:], key[:-1], out=changed[1:])
        new[slots] = changed
        rank[here] = slots[np.maximum.accumulate(np.where(changed, np.arange(len(slots)), 0))]
        h *= 2
        levels.append(rank.copy())
    lcp = np.zeros(n, np.int64)
    if n > 1:
        k = np.arange(1, n)
        k = k[levels[0][order[1:]] == levels[0][order[:-1]]]
        a, b = order[k - 1].copy(), order[k].copy()
        got = np.zeros(len(k), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            same = levels[j][a] == levels[j][b]
            same &= (a < n) & (b < n)
            step = np.where(same, 1 << j, 0)
            got += step
            a, b = np.minimum(a + step, n), np.minimum(b + step, n)
        lcp[k] = got
    return order, lcp


def _suffixes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix and LCP array of the documents laid end to end, which places hold words, the word before each place, and the documents' offsets."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for doc in words for w in doc), np.int64, int(offsets[-1]))
    # each document's end has a rank of its own, so that no match runs over it
    n = len(flat) + len(words)
    first = np.empty(n, np.int64)
    ends = offsets[1:] + np.arange(len(words))
    inner = np.ones(n, bool)
    inner[ends] = False
    doc = np.repeat(np.arange(len(words)), sizes)
    first[inner] = flat + doc * np.int64(len(ids) + 1)
    first[ends] = len(ids) + np.arange(len(words)) * np.int64(len(ids) + 1)
    order, lcp = suffix_array(first)
    return order, lcp, inner, np.concatenate([[-1], first[:-1]]), offsets


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The LCP intervals of a depth of at least ``least``: depth, first and last rank of each, and for each rank the interval of its LCP value (-1: none).

    Ranks k - 1 and k are in one interval of depth lcp[k]; lcp[0] counts as 0. One pass with a stack over the ranks that matter.
    """
    n = len(lcp)
    of = np.full(n + 1, -1, np.int64)
    at = np.flatnonzero(lcp >= least)
    at = at[at > 0]
    depth: list[int] = []
    left: list[int] = []
    right: list[int] = []
    stack: list[int] = []
    before = -2
    for k, d in zip(at.tolist(), lcp[at].tolist(), strict=True):
        if k != before + 1:  # between the runs all values are less
            for x in stack:
                right[x] = before
            stack = []
        start = k - 1
        while stack and depth[stack[-1]] > d:
            x = stack.pop()
            right[x], start = k - 1, left[x]
        if not stack or depth[stack[-1]] < d:
            stack.append(len(depth))
            depth.append(d), left.append(start), right.append(0)
        of[k] = stack[-1]
        before = k
    for x in stack:
        right[x] = before
    return np.array(depth, np.int64), np.array(left, np.int64), np.array(right, np.int64), of


def longest_repeats(words: list[list[bytes]], least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans and longest repeats of at least ``least`` words, from the documents' LCP intervals.

    For each word of each document the length of the maximal repeat whose span starts there (0: none does, or
    one that starts before it covers it); for each document its longest repeat; and the documents' offsets.
    """
    order, lcp, inner, before, offsets = _suffixes(words)
    n = len(order)
    depth, left, right, of = lcp_intervals(lcp, least)
    span, longest = np.zeros(n, np.int64), np.zeros(len(words), np.int64)
    if len(depth):
        prior = before[order]
        prior[order == 0] = -1
        differs = np.concatenate([[0], np.cumsum(prior[1:] != prior[:-1])])
        maximal = differs[right] > differs[left]
        # the deeper of the two intervals that a rank is in with its neighbours
        up, down = of[:-1], of[1:]
        deepest = np.where((down >= 0) & ((up < 0) | (np.append(lcp[1:], 0) > lcp)), down, up)
        ranks = np.flatnonzero(deepest >= 0)
        ranks = ranks[maximal[deepest[ranks]]]
        span[order[ranks]] = depth[deepest[ranks]]
        doc = np.searchsorted(offsets[1:] + np.arange(1, len(words) + 1), order[left], side="right")
        np.maximum.at(longest, doc, depth)
    return span[inner], longest, offsets


def covered(span: np.ndarray, least: int) -> np.ndarray:
    """Which words the union of the spans of at least ``least`` words covers (spans end within their text)."""
    n = len(span)
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(span >= least)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + span[at], -1)
    return np.cumsum(mark[:n]) > 0


def maximal_repeats(words: list[bytes], least: int) -> list[tuple[int, list[int]]]:
    """The maximal repeats of one text of at least ``least`` words as (length in words, starts)."""
    order, lcp, _, before, _ = _suffixes([words])
    prior = before[order]
    return [(d, sorted(order[a : b + 1].tolist())) for d, a, b in zip(*(x.tolist() for x in lcp_intervals(lcp, least)[:3]), strict=True) if len(set(prior[a : b + 1].tolist())) > 1]


def _judge(batch: pa.RecordBatch, limits: Limits) -> dict:
    raw = common.texts(batch.column(1))
    words = [t.split() for t in raw]
    span, longest, offsets = longest_repeats(words, min(WINDOW, limits.min_repeat, limits.longest + 1))
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    n_words = np.diff(offsets)
    repeated, cover = sums(covered(span, WINDOW)), sums(covered(span, limits.min_repeat))
    chars, symbols, dups = [], [], []
    for text, found in zip(raw, words, strict=True):
        joined = b"".join(found)
        chars.append(len(joined) if joined.isascii() else len(joined.decode()))
        symbols.append(len(SYMBOL.findall(text)))
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            dups.append(len(lines) - len(set(lines)))
        else:
            dups.append(0)
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    rejected = (100 * cover > limits.most_covered * n_words) | (longest > limits.longest)
    return {
        "doc_id": batch.column(0), "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeated,
        "n_covered_words": cover, "longest_repeat": longest, "base_failed": failed, "kept": ~(failed | rejected),
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"


CONTRACT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: the base counts, the covered words, the longest repeat and the verdict."""
    return common.map_rows(common.id_and_text(docs), lambda b: _judge(b, limits), SCHEMA, most=1 << 20)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents")).select(*CONTRACT)


_L = Limits()
#: A word lies in a repeat of at least m words if it lies in an m-word window found twice; the longest repeat exceeds M if an (M+1)-word window is found twice.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
{"".join(f'''
g{m} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {m - 1}], ' ')) AS n FROM p WHERE i + {m - 1} <= len(w)),
r{m} AS (SELECT doc_id, count(DISTINCT j) AS c FROM (SELECT doc_id, unnest(range(i, i + {m})) AS j FROM g{m} WHERE n > 1) GROUP BY doc_id),''' for m in (WINDOW, _L.min_repeat))}
x AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {_L.longest}], ' ')) AS n FROM p WHERE i + {_L.longest} <= len(w)) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda z: length(z))), 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(r{WINDOW}.c, 0) AS n_repeat_words,
  coalesce(r{_L.min_repeat}.c, 0) AS n_cov, coalesce(x.n, 0) AS longest
  FROM d LEFT JOIN r{WINDOW} USING (doc_id) LEFT JOIN r{_L.min_repeat} USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN e USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND NOT (100 * n_cov > {_L.most_covered} * n_words OR longest > 1) AS kept
FROM f
"""
