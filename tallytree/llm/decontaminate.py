"""Benchmark decontamination (4): a broadcast hash set of the test items' word windows.

The windows of the benchmark (13 consecutive normalised words; a shorter item is one window) are hashed
over the ids of their words and broadcast in blocks of at most ``BLOCK_WORDS`` words, so that what an
executor holds doesn't grow with the benchmark. Each block is scanned over all documents: the words
become ids (unknown ones share an id that no window has), rolling hashes of all windows of a length are
made for a whole batch at once, and each hash found in the set is verified word by word.

Defined results: null and empty texts have no words and aren't contaminated. Items without words have
no window. Items without an item_id are left out, so a passage of theirs isn't found; ``ORACLE_SQL`` keeps
them, and the two differ on such benchmarks. Repeated rows are judged one by one. Other columns are ignored; without any item nothing is
hit.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import mixed, rolled

WINDOW, SHARE, BLOCK_WORDS = 13, 20, 2_000_000
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: A-Z to a-z; what is no word character to a space. Every byte of a non-ASCII character is a word byte.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Windows:
    """The windows of one block of items: some 25 bytes each in flat arrays, besides a dictionary of the block's different words."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        texts = [np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in words_of(text)), np.int32) for _, text in items]
        sizes = np.array([len(x) for x in texts], np.int64)
        self.words = np.concatenate([*texts, np.zeros(0, np.int32)])
        starts, numbers = np.cumsum(sizes) - sizes, np.array([x[0] for x in items], np.int64)
        del texts
        #: by window length: sorted hashes, where in ``words`` each window starts, its item, and a bitmap of 20 bits that turns nearly all others away
        self.sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(sizes, window)).tolist():
            own = np.flatnonzero(np.minimum(sizes, window) == size)
            if not size or not len(own):
                continue
            counts = sizes[own] - size + 1
            of = np.repeat(own, counts)
            at = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            hashes = rolled(mixed(self.words.astype(np.uint64) + np.uint64(1)), size)[at]
            by = np.lexsort((numbers[of], hashes))
            hashes, at, item = hashes[by], at[by], numbers[of][by]
            # a window that its item has twice is kept once
            twice = np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1]))
            twice = twice[self._same(self.words, at[twice], self.words, at[twice + 1], size)]
            keep = np.ones(len(at), bool)
            keep[twice + 1] = False
            hashes, at, item = hashes[keep], at[keep].astype(np.int32), item[keep]
            bits = np.zeros(1 << 20, bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.sets[size] = hashes, at, item, bits

    @staticmethod
    def _same(x: np.ndarray, at: np.ndarray, y: np.ndarray, there: np.ndarray, size: int) -> np.ndarray:
        """Which runs of ``size`` values are equal, value by value."""
        out = np.ones(len(at), bool)
        for k in range(size):
            out &= x[at + k] == y[there + k]
        return out

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """For each text its number of words and the (start, length, item) of the windows that it holds."""
        words = [words_of(t) for t in texts]
        sizes = [len(x) for x in words]
        get = self.ids.get
        flat = np.fromiter((get(w, -1) for x in words for w in (*x, None)), np.int32, sum(sizes) + len(sizes))
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
        hashed = mixed((flat.astype(np.int64) + 1).astype(np.uint64))
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for size, (exact, starts, items, bits) in self.sets.items():
            if len(flat) < size:
                continue
            found = rolled(hashed, size)
            at = np.flatnonzero(bits[(found >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(exact, found[at], side="left")
            n = np.searchsorted(exact, found[at], side="right") - low
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            real = self._same(flat, at, self.words, starts[which], size)
            at, which = at[real], which[real]
            doc = np.searchsorted(offsets, at, side="right") - 1
            for d, a, item in zip(doc.tolist(), (at - offsets[doc]).tolist(), items[which].tolist(), strict=True):
                hits[d].append((a, size, item))
        return ((n, hits.get(k, [])) for k, n in enumerate(sizes))


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items, each with its texts, in blocks of about ``most`` words, one block at a time on the driver."""
    block, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary")).where("item_id IS NOT NULL").toLocalIterator():
        n = len(words_of(row[1]))
        if block and words + n > most:
            yield block
            block, words = [], 0
        block.append((row[0], bytes(row[1])))
        words += n
    yield block


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _verdict(n: int, found: list[tuple[int, int, int]]) -> tuple:
    hit = set()
    for at, size, _ in found:
        hit.update(range(at, at + size))
    items = sorted({str(x[2]) for x in found})
    return n, len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit) and SHARE * len(hit) >= n


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: its words, those inside occurrences of benchmark windows, the items, and the verdict."""
    rows = common.id_and_text(docs)
    blocks = _blocks(benchmark, block_words)
    block, following = next(blocks), next(blocks, None)
    sc = docs.sparkSession.sparkContext
    if following is None:
        shared = sc.broadcast(Windows(block, window))

        def make(batch: pa.RecordBatch) -> dict:
            found = [_verdict(n, x) for n, x in shared.value.scan(common.texts(batch.column(1)))]
            return {"doc_id": batch.column(0)} | {k: [x[i] for x in found] for i, k in enumerate(("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))}

        return common.map_rows(rows, make, SCHEMA)
    return _in_blocks(rows, benchmark, window, block_words).drop("h")


def _in_blocks(rows: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """For a larger benchmark: a scan for each block, then all hits of a row together. ``h`` is a hash of the text."""
    sc, blocks = rows.sparkSession.sparkContext, _blocks(benchmark, block_words)
    block, following = next(blocks), next(blocks, None)
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"))
    hits = None
    while block is not None:
        shared = sc.broadcast(Windows(block, window))

        def scan(batch: pa.RecordBatch, shared=shared) -> dict:
            found = [x for _, x in shared.value.scan(common.texts(batch.column(1)))]
            return {"doc_id": batch.column(0), "h": batch.column(2), "found": [[{"a": a, "n": n, "item": i} for a, n, i in x] for x in found]}

        part = common.map_rows(rows, scan, "doc_id long, h long, found array<struct<a:int,n:int,item:long>>").where(F.size("found") > 0)
        part = common.checkpointed(part)
        shared.unpersist()
        hits = part if hits is None else hits.unionByName(part)
        block, following = following, next(blocks, None)
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("dh")).agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    counted = common.map_rows(rows, lambda b: {"doc_id": b.column(0), "h": b.column(2), "n_words": [len(words_of(t)) for t in common.texts(b.column(1))]}, "doc_id long, h long, n_words long")
    joined = counted.join(hits, counted.doc_id.eqNullSafe(hits.d) & (counted.h == hits.dh), "left").select("doc_id", "n_words", "found", "h")

    def finish(batches):
        for batch in batches:
            found = [_verdict(n, [(x["a"], x["n"], x["item"]) for x in f or ()]) for n, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))), batch.column(3)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "h"])

    return joined.mapInArrow(finish, SCHEMA + ", h long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all columns, that aren't contaminated."""
    blocks = list(_sizes(benchmark, block_words))
    if len(blocks) <= 1:
        shared = docs.sparkSession.sparkContext.broadcast(Windows(next(_blocks(benchmark, block_words)), window))
        return common.kept_rows(docs, lambda text: [not _verdict(n, x)[-1] for n, x in shared.value.scan(common.texts(text))])
    id_, hash_ = common.fresh(docs, "id", "hash")
    bad = _in_blocks(common.id_and_text(docs), benchmark, window, block_words).where("contaminated").select(F.col("doc_id").alias(id_), F.col("h").alias(hash_)).distinct()
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (own == F.col(hash_)), "left_anti")


def _sizes(benchmark: DataFrame, most: int) -> Iterator[int]:
    """The sizes of at most two blocks: whether there is more than one."""
    blocks = _blocks(benchmark, most)
    for _, block in zip(range(2), blocks, strict=False):
        yield len(block)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words number a to a + n of each (a, n), and what stands between two removed words."""
    raw = text.encode()
    gone = sorted({k for a, n in spans for k in range(a, a + n)})
    at, starts, inside = raw.translate(NORMAL), [], False
    for k, b in enumerate(at):
        if (b != 32) != inside:
            inside = not inside
            starts.append(k)
    starts.append(len(raw)) if inside else None
    keep = bytearray(raw)
    runs: list[list[int]] = []
    for k in gone:
        if runs and runs[-1][1] == k:
            runs[-1][1] = k + 1
        else:
            runs.append([k, k + 1])
    for a, b in reversed(runs):
        del keep[starts[2 * a] : starts[2 * b - 1]]
    return keep.decode()


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
