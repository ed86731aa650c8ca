"""Suffix-array dedup (2): bytes inside long strings that occur again anywhere in the corpus.

A sparse suffix array: of every window of ``LENGTH`` bytes the run of ``ANCHOR`` bytes with the least
hash is its anchor, so two equal windows have equal anchors at equal offsets. Consecutive windows with
one anchor form a stretch (anchor hash, content hash, place). One shuffle by anchor finds the anchors
that occur again. Stretches with equal content are duplicates as a whole and are counted once from then
on; where different stretches share an anchor, one of each content is fetched and the suffixes from the
anchors on (and, backwards, what stands before them) are sorted by deep-shallow sorting: multikey
quicksort to ``SHALLOW`` bytes, then blind tries for the groups still equal there. Two stretches share a
window exactly if the common prefixes to both sides of the anchor add up to LENGTH, which intervals of the
two longest-common-prefix arrays tell for all of them at once.

What is long is counted in bytes, ``LENGTH`` of them, and in words (runs of bytes other than white space),
``WORDS`` of them whatever stands between: a passage of over 50 words mostly has fewer than 400 bytes. For the
latter the same is done with the words' 64-bit hashes in place of bytes; the lowest bit of an anchor's hash
is 1 then. ``words=0`` leaves it out, as the query does, whose contract counts bytes only.

A group of up to ``GROUP`` distinct stretches is sorted in one task; a hotter one is taken apart
window by window and counted with partial aggregation, also exactly. Content hashes have 127 bits (anchor
and content), equality by them, and of words by theirs, is taken as equality. Spans are judged on the input.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH and WORDS lose nothing; equal rows
are copies of each other and lose all that is long enough; rows are told apart by id and text, and null
ids are ids like any other; other columns are ignored or, by ``drop_repeats``, kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .hashing import mixed, rolled

LENGTH, ANCHOR, SHALLOW, GROUP = 400, 128, 64, 60_000
WORDS, WORD_ANCHOR = 51, 16
#: Bytes of a word's hash.
_WORD = 8
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 21
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_LOW = np.uint64((1 << 24) - 1)


# --- stretches -------------------------------------------------------------------------------------------


def hashed_words(text: bytes) -> bytes:
    """The hashes of a text's words, one after another."""
    out, at = [], 0
    while at < len(text):  # a very long text in pieces of whole words
        end = m.start() if (m := _SPACE.search(text, at + _PIECE)) else len(text)
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, text[at:end].split()), np.uint64).tobytes())
        at = end
    return b"".join(out)


def _word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    buf = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = (buf != 32) & ((buf < 9) | (buf > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def stretches(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR, unit: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, start, windows, offset of the anchor, anchor hash, content hash) arrays over all windows of all texts, in units of ``unit`` bytes."""
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, max(0, len(text) // unit - length + 1), _PIECE):  # a very long text in pieces of window starts
            piece = text[at * unit : (at + _PIECE + length - 1) * unit]
            part.append((k, at, piece))
            size += len(piece) // unit
            if size >= _PIECE // 2:
                yield _stretches(part, length, anchor, unit)
                part, size = [], 0
    if part:
        yield _stretches(part, length, anchor, unit)


def _stretches(part: list[tuple[int, int, bytes]], length: int, anchor: int, unit: int) -> tuple[np.ndarray, ...]:
    raw = b"".join(x[2] for x in part)
    values = _BYTES[np.frombuffer(raw, np.uint8)] if unit == 1 else np.frombuffer(raw, np.uint64)
    ends = np.cumsum([len(x[2]) // unit for x in part])
    starts = np.concatenate([[0], ends[:-1]])
    hashes = mixed(rolled(values, anchor))
    n, w = len(hashes), length - anchor + 1
    packed = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    packed[:n] = (hashes & ~_LOW) | np.arange(n, dtype=np.uint64)  # the leftmost of the least ones
    blocks = packed.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    place = (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & _LOW).astype(np.int64)
    cut = np.empty(m + 1, bool)
    cut[0] = cut[m] = True
    np.not_equal(place[1:], place[:-1], out=cut[1:m])
    cut[starts] = True
    over = ends - length + 1  # windows from here to the next text's start would run over the end
    cut[over[over <= m]] = True
    bounds = np.flatnonzero(cut)
    a, b = bounds[:-1], bounds[1:]
    of = np.searchsorted(starts, a, side="right") - 1
    real = a + length <= ends[of]
    a, b, of = a[real], b[real], of[real]
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(raw[i:j]) for i, j in zip((a * unit).tolist(), ((b + length - 1) * unit).tolist(), strict=True)), np.uint64, len(a))
    number = np.array([x[0] for x in part])[of]
    base = np.array([x[1] for x in part])[of]
    p = place[a]
    h = hashes[p] & ~np.uint64(1) | np.uint64(unit != 1)
    return number, a - starts[of] + base, b - a, p - a, h.view(np.int64), content.view(np.int64)


OCCURRENCES = "h long, c long, doc_id long, t long, a long, n int, o int"


def occurrences(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, words: int = WORDS) -> DataFrame:
    """The stretches of rows (doc_id, text, t): t is a hash of the text, which with doc_id names the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            ids, t, texts = batch.column(0), batch.column(2), common.texts(batch.column(1))
            by_words = stretches([hashed_words(x) for x in texts], words, min(words, WORD_ANCHOR), _WORD) if words else ()
            for number, a, n, o, h, c in chain(stretches(texts, length, anchor), by_words):
                at = pa.array(number)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), ids.take(at), t.take(at), pa.array(a), pa.array(n.astype(np.int32)), pa.array(o.astype(np.int32))], names=["h", "c", "doc_id", "t", "a", "n", "o"])

    return rows.mapInArrow(run, OCCURRENCES)


# --- deep-shallow sorting --------------------------------------------------------------------------------


def lcp(x: bytes, y: bytes, at: int = 0) -> int:
    """The length of the common prefix, known to be ``at`` at least."""
    most = min(len(x), len(y))
    if x[at:most] == y[at:most]:
        return most
    low, step = at, 16
    while x[low : low + step] == y[low : low + step]:
        low += step
        step *= 2
    while step > 1:  # the difference lies in the next ``step`` bytes
        step //= 2
        if x[low : low + step] == y[low : low + step]:
            low += step
    return low


def _blind(texts: list[bytes], members: list[int], depth: int) -> list[int]:
    """``members``, equal in their first ``depth`` bytes, in order: a blind trie keeps only where they branch.

    A node is [bytes in common, branches by next byte (-1: the text ends), some leaf below]. A search
    follows the branches without looking at what lies between and compares with one leaf only.
    """
    root: list | int = members[0]

    def leaf(x: list | int) -> int:
        return x if isinstance(x, int) else x[2]

    same: dict[int, list[int]] = {members[0]: []}
    for k in members[1:]:
        text = texts[k]
        x = root
        while not isinstance(x, int):
            byte = text[x[0]] if x[0] < len(text) else -1
            if byte not in x[1]:
                break
            x = x[1][byte]
        other = leaf(x)
        got = lcp(text, texts[other], depth)
        if got == len(text) == len(texts[other]):
            same[other].append(k)
            continue
        same[k] = []
        mine = text[got] if got < len(text) else -1
        theirs = texts[other][got] if got < len(texts[other]) else -1
        above, x = None, root
        while not isinstance(x, int) and x[0] < got:
            above, byte = x, text[x[0]]
            x = x[1][byte]
        if not isinstance(x, int) and x[0] == got:
            x[1][mine] = k
            continue
        node = [got, {mine: k, theirs: x}, k]
        if above is None:
            root = node
        else:
            above[1][byte] = node
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if isinstance(x, int):
            out += [x, *same[x]]
        else:
            stack += [x[1][b] for b in sorted(x[1], reverse=True)]
    return out


def deep_shallow(texts: list[bytes], members: list[int], shallow: int = SHALLOW) -> list[int]:
    """``members`` by their texts: multikey quicksort, eight bytes at a time, to ``shallow`` bytes, then blind tries."""
    out: list[int] = []
    work = [(members, 0)]
    while work:
        group, depth = work.pop()
        if len(group) <= 1:
            out += group
        elif depth >= shallow:
            out += _blind(texts, group, depth)
        else:
            keys = [texts[k][depth : depth + 8] for k in group]
            pivot = keys[len(keys) // 2]
            less = [k for k, x in zip(group, keys, strict=True) if x < pivot]
            equal = [k for k, x in zip(group, keys, strict=True) if x == pivot]
            more = [k for k, x in zip(group, keys, strict=True) if x > pivot]
            if more:
                work.append((more, depth))
            if len(pivot) < 8:  # all of these end here
                ended = equal
                if less:
                    work.append((ended, shallow))
                    work.append((less, depth))
                else:
                    out += ended
            else:
                work.append((equal, depth + 8))
                if less:
                    work.append((less, depth))
    return out


def _sorted_with_lcp(texts: list[bytes], groups: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The groups one after another, each in order, and the common prefix of each text with the one before (-1 at a group's start)."""
    order, common_ = [], []
    for group in groups:
        own = deep_shallow(texts, group)
        order += own
        common_ += [-1, *(lcp(texts[x], texts[y]) for x, y in zip(own, own[1:], strict=False))]
    return np.array(order, np.int64), np.array(common_, np.int64)


def shared_windows(texts: list[bytes], groups: list[list[int]], offset: np.ndarray, windows: np.ndarray, length: int = LENGTH, unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each text the first and last start of a window that another text of its group has at the same anchor (-1: none).

    All in units of ``unit`` bytes.
    """
    total = len(texts)
    first, last = np.full(total, -1, np.int64), np.full(total, -1, np.int64)
    anchors = (offset * unit).tolist()
    right, rl = _sorted_with_lcp([t[o:] for t, o in zip(texts, anchors, strict=True)], groups)
    left, ll = _sorted_with_lcp([t[:o][::-1] for t, o in zip(texts, anchors, strict=True)], groups)
    rl, ll = rl // unit, ll // unit  # what hashes of different words have in common doesn't count
    best = lambda x: np.maximum(x, np.append(x[1:], -1))
    reach_r, reach_l = np.empty(total, np.int64), np.empty(total, np.int64)
    reach_r[right], reach_l[left] = best(rl), best(ll)
    on_r, on_l = np.empty(total, np.int64), np.empty(total, np.int64)
    may = reach_r + reach_l >= length
    if not may.any():
        return first, last
    low, high = int(np.maximum(0, length - reach_r[may]).min()), int(reach_l[may].max())
    for t in range(low, high + 1):  # t bytes before the anchor belong to the window
        at = np.flatnonzero((reach_l >= t) & (reach_r >= length - t) & (offset >= t) & (offset - t < windows))
        if len(at) < 2:
            continue
        on_r[right], on_l[left] = np.cumsum(rl < length - t), np.cumsum(ll < t)
        key = on_l[at] * np.int64(total + 1) + on_r[at]
        by = np.argsort(key, kind="stable")
        k = key[by]
        eq = k[1:] == k[:-1]
        hit = at[by[np.append(eq, False) | np.append(False, eq)]]
        start = offset[hit] - t
        first[hit] = start  # t grows, so starts fall
        last[hit] = np.maximum(last[hit], start)
    return first, last


def _compare(length: int, words: int):
    """Members (h, c, n, o, text), ordered by h, to (h, c, first, last): whole groups at a time."""
    names = ["h", "c", "first", "last"]

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for unit, size in ((1, length), (_WORD, words)):
            own = [r for r in rows if r[0] & 1 == (unit != 1)]
            if not own:
                continue
            groups: dict[int, list[int]] = {}
            for k, r in enumerate(own):
                groups.setdefault(r[0], []).append(k)
            first, last = shared_windows([r[4] for r in own], list(groups.values()), np.array([r[3] for r in own]), np.array([r[2] for r in own]), size, unit)
            keep = np.flatnonzero(first >= 0).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([own[k][0] for k in keep], pa.int64()), pa.array([own[k][1] for k in keep], pa.int64()), pa.array(first[keep].astype(np.int32)), pa.array(last[keep].astype(np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            if len(held) >= 20_000:
                k = len(held)
                while k and held[k - 1][0] == held[-1][0]:  # the last group may go on
                    k -= 1
                if k:
                    yield from solve(held[:k])
                    held = held[k:]
        if held:
            yield from solve(held)

    return run


def _taken_apart(length: int, words: int):
    """Members to their single windows (h, c, s, w1, w2): the start, and two hashes of anchor offset and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, n, o, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                unit, size = (_WORD, words) if h & 1 else (1, length)
                found = [xxhash.xxh3_128_digest(text[s * unit : (s + size) * unit], seed=o - s) for s in range(n)]
                w = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, c)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1]))], names=["h", "c", "s", "w1", "w2"])

    return run


# --- the operator ----------------------------------------------------------------------------------------


def _rows(docs: DataFrame) -> DataFrame:
    return common.id_and_text(docs).withColumn("t", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, words: int = WORDS) -> DataFrame:
    """(doc_id, t, spans): for the rows with any, the spans (a, b, w) of what starts elsewhere too. May overlap.

    w 0: the bytes [a, b) are in strings of ``length``. w 1: the words [a, b) are in runs of ``words``.
    """
    spark, rows = docs.sparkSession, _rows(docs)
    all_, everything = common.written(occurrences(rows, length, anchor, words), "stretches")
    # which anchors occur again, and whether with different stretches: a row for each anchor and task, however hot
    anchors = all_.groupBy("h").agg(F.count("*").alias("seen"), F.min("c").alias("low"), F.max("c").alias("high")).where("seen > 1")
    # by themselves, so that the join is one of two plain shuffles and a hot anchor's rows are split among tasks
    anchors = common.checkpointed(anchors.select("h", (F.col("low") != F.col("high")).alias("mixed")), small=True)
    found, path = common.written(all_.join(anchors, "h"), "repeats")
    common.remove(spark, everything)
    # one stretch of each content where an anchor has several
    ones = common.checkpointed(found.where("mixed").groupBy("h", "c").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "t", "a", "n", "o")).alias("x")).select("h", "c", "copies", "x.*"))
    wanted = ones.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("dt")).agg(F.collect_list(F.struct("h", "c", "a", "n", "o")).alias("wanted"))
    holders = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.d) & (rows.t == wanted.dt))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            out = []
            for text, ws in zip(common.texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                hashes = hashed_words(text) if any(w["h"] & 1 for w in ws) else b""
                for w in ws:
                    source, unit, size = (hashes, _WORD, words) if w["h"] & 1 else (text, 1, length)
                    out.append((w["h"], w["c"], w["n"], w["o"], source[w["a"] * unit : (w["a"] + w["n"] + size - 1) * unit]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["h", "c", "n", "o", "text"])

    members = holders.select("text", "wanted").mapInArrow(cut, "h long, c long, n int, o int, text binary")
    result = "h long, c long, first int, last int"
    hot = common.checkpointed(ones.groupBy("h").count().where(F.col("count") > group).select("h"), small=True)
    some_hot = bool(hot.take(1))
    usual = members.join(hot, "h", "left_anti") if some_hot else members
    shared = usual.repartition("h").sortWithinPartitions("h", "c").mapInArrow(_compare(length, words), result)
    if some_hot:
        windows = members.join(hot, "h", "left_semi").mapInArrow(_taken_apart(length, words), "h long, c long, s int, w1 long, w2 long").distinct()
        again = windows.groupBy("h", "w1", "w2").agg(F.count_distinct("c").alias("n")).where("n > 1").select("h", "w1", "w2")
        shared = shared.unionByName(windows.join(again, ["h", "w1", "w2"], "left_semi").groupBy("h", "c").agg(F.min("s").alias("first"), F.max("s").alias("last")))
    # what has copies is a repeat as a whole; a row that is there twice gives its stretches twice
    whole = ones.where("copies > 1").select("h", "c", F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    shared = common.checkpointed(shared.unionByName(whole).groupBy("h", "c").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    # a stretch of an anchor that has no other is a repeat as a whole
    marked = found.join(shared, ["h", "c"], "left").where("NOT mixed OR first IS NOT NULL")
    first, last = F.coalesce("first", F.lit(0)), F.coalesce("last", F.col("n") - 1)
    kind = F.col("h").bitwiseAND(1)
    spans = marked.select("doc_id", "t", (F.col("a") + first).alias("a"), (F.col("a") + last + F.when(kind == 1, words).otherwise(length)).alias("b"), kind.cast("int").alias("w"))
    spans = common.checkpointed(spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct("a", "b", "w")).alias("spans")))
    common.remove(spark, path)
    return spans


def _merged(text: bytes, spans: list[dict] | None) -> list[list[int]]:
    """The runs of bytes in any span; of words, what stands between them too."""
    out: list[list[int]] = []
    found = [(x["a"], x["b"]) for x in spans or () if not x["w"]]
    if by_words := [(x["a"], x["b"]) for x in spans or () if x["w"]]:
        starts, ends = _word_bounds(text)
        found += [(int(starts[a]), int(ends[b - 1])) for a, b in by_words]
    for s in sorted(found):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return out


def _pieces(text: bytes, runs: list[list[int]]) -> list[bytes]:
    """What is left of a text, run by run."""
    ends = [0, *(x for r in runs for x in r), len(text)]
    return [text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)] if runs else [text]


def _characters(pieces: list[bytes]) -> str:
    """The characters of which no byte was cut off."""
    return "".join([x.decode(errors="ignore") for x in pieces])


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` and, as its last column, the spans of each row."""
    id_, t, own = common.fresh(docs, "id", "t", "spans")
    spans = spans.select(F.col("doc_id").alias(id_), F.col("t").alias(t), F.col("spans").alias(own))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(t)), "left").drop(id_, t)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, words: int = WORDS) -> DataFrame:
    """One row per document: its bytes, the removed bytes and runs, the sha256 of what is left, and that as a text.

    ``text`` has the characters of which all bytes are left.
    """
    joined = _with_spans(docs.select("doc_id", "text"), repeated_spans(docs, length, anchor, group, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            texts = common.texts(batch.column(1))
            runs = [_merged(t, s) for t, s in zip(texts, batch.column(2).to_pylist(), strict=True)]
            gone = [sum(b - a for a, b in r) for r in runs]
            left = [_pieces(t, r) for t, r in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(gone, pa.int64()), pa.array(list(map(len, runs)), pa.int64()), pa.array([hashlib.sha256(b"".join(x)).hexdigest() for x in left], pa.string()), pa.array(list(map(_characters, left)), pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def drop_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, words: int = WORDS) -> DataFrame:
    """``docs``, all columns, with the repeated bytes cut out of ``text`` (what is left of a cut character goes too).

    A long column ``n_chars`` is set to the new length; rows without a repeat stay as they are.
    """
    joined = _with_spans(docs, repeated_spans(docs.select("doc_id", "text"), length, anchor, group, words))
    names, schema = docs.columns, StructType(docs.schema.fields)
    at, counts = names.index("text"), names.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            spans = batch.column(len(names))
            columns = [batch.column(k) for k in range(len(names))]
            if spans.null_count < len(spans):
                texts, sizes = columns[at].to_pylist(), columns[counts].to_pylist() if counts is not None else []
                for k, s in enumerate(spans.to_pylist()):
                    if s:
                        text = texts[k].encode()
                        texts[k] = _characters(_pieces(text, _merged(text, s)))
                        if counts is not None:
                            sizes[k] = len(texts[k])
                columns[at] = pa.array(texts, columns[at].type)
                if counts is not None:
                    columns[counts] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.table(spark, sf_dir, "documents"), words=0)


#: Every window by itself, on hexadecimal digits: two a byte. A window's strings are compared by their MD5.
_HEAD, _TAIL = "^([89AB].)+", "([C-F].|[EF].[89AB].|F.[89AB].[89AB].)$"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 2 * {LENGTH})) AS m FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {LENGTH} + 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r),
s AS (SELECT doc_id, i, sum(CASE WHEN gap <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
v AS (SELECT doc_id, k, min(i) AS a, max(i) + {LENGTH} AS b FROM s GROUP BY doc_id, k),
u AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS following, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM v),
p AS (SELECT doc_id, a, b, CASE WHEN before IS NULL THEN substr(x, 1, 2 * a) ELSE '' END AS head, CASE WHEN following IS NULL THEN substr(x, 2 * b + 1) ELSE substr(x, 2 * b + 1, 2 * (following - b)) END AS tail
  FROM u JOIN d USING (doc_id)),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(head || tail, '' ORDER BY a) AS kept,
  string_agg(regexp_replace(head, '{_TAIL}', '') || regexp_replace(regexp_replace(tail, '{_HEAD}', ''), '{_TAIL}', ''), '' ORDER BY a) AS whole
  FROM p GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256, decode(unhex(coalesce(whole, x))) AS text
FROM d LEFT JOIN t USING (doc_id)
"""
