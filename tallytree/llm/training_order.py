"""Token-ID / binary output (1): sequences in a random but replayable training order, in fixed-stride shards.

Each text's token ids and an end token are cut into sequences of ``length`` tokens, the last one padded.
Rows are numbered by file, in order of the paths, and by place in the file; a sequence's number is its row's
number and its place in the text. So a number doesn't depend on how Spark splits files into tasks, and the
same files and key give the same order on any cluster. A keyed Feistel network over the least even power of
two not below the count of numbers, with cycle-walking (what falls outside is sent through again), permutes
the numbers without any table. A shard is a range of permuted numbers; one task sorts it and writes it as
one file with a fixed stride. A sequence's slot is its rank in that order: the shard's first slot, known from
the shards' sizes, and its place in the file. So texts are tokenised once, the tokens are shuffled once, and
no pass is needed to count them beforehand. Reading in order, from any slot on, is sequential.

An input that isn't a plain scan of Parquet files is written to the shared folder first and numbered there.
The driver holds a path and a number for each file. Shards are written aside and renamed, so that a repeated
task replaces its file.

Defined results: null and empty texts give one sequence with the end token alone; repeated rows give
sequences each; null ids stay null; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens
from .hashing import mixed

LENGTH, SHARD_BYTES, ROUNDS, KEY = 256, 16 << 20, 6, 20240501
#: Bits of a sequence's number for its place in its text: a text has 2^31 bytes at most, so fewer than 2^31 tokens.
PLACE = 23


class Permutation:
    """A keyed bijection of 0..n-1, n below 2^62, and its inverse, on arrays."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS) -> None:
        self.n = n
        self.half = max(1, -(-max(0, n - 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def _network(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & self.mask)
        return (right << np.uint64(self.half)) | left  # swapped, so that the keys in reverse undo it

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._network(np.asarray(x, np.uint64), keys)
        while len(far := np.flatnonzero(out >= self.n)):
            out[far] = self._network(out[far], keys)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


RAW = "shard int, place long, doc_id long, seq_no int, n_tokens int, crc32 long"


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, int], int, str | None]:
    """Rows with their file and place there, each file's first number, the count of rows, and a folder to remove afterwards."""
    rows, temporary = common.id_and_text(docs), None
    steps = re.findall(r"(?m)^[^A-Za-z]*(?:\(\d+\) )?([A-Za-z]+)( parquet)?", rows._jdf.queryExecution().executedPlan().toString())
    if not {"".join(x) for x in steps} <= {"Project", "Filter", "ColumnarToRow", "FileScan parquet"}:
        rows, temporary = common.written(rows, "texts")
        docs = rows
    source = docs.metadataColumn("_metadata")
    places = docs.select(source["file_path"].alias("path"), source["row_index"].alias("row"))
    counts = sorted((r.path, r.n) for r in places.groupBy("path").agg(F.count("*").alias("n")).collect())  # footers alone are read
    firsts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(int).tolist()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), source["file_path"].alias("path"), source["row_index"].alias("row"))
    return rows, {path: first for (path, _), first in zip(counts, firsts, strict=False)}, firsts[-1], temporary


def materialise(docs: DataFrame, out: str, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, key: int = KEY, vocabulary: str = tokens.VOCABULARY, shards: int | None = None) -> DataFrame:
    """Writes ``shards`` shards, else as many as make them about ``shard_bytes`` long, and a manifest under ``out``; returns the manifest, one row for each sequence."""
    spark = docs.sparkSession
    rows, files, total, temporary = _numbered(docs)
    stride, pad = 2 * length, tokens.END.to_bytes(2, "little")
    # sizes in files, compressed: about as many bytes again come out
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = shards or max(1, min(1 << 20, -(-3 * size // (2 * shard_bytes))))
    order = Permutation(max(1, total) << PLACE, key)
    width = -(-order.n // shards)
    firsts = spark.sparkContext.broadcast(files)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            ids, numbers, payloads, counts = [], [], [], []
            path = batch.column(2).dictionary_encode()
            first = np.array([firsts.value[x] for x in path.dictionary.to_pylist()], np.uint64)[np.asarray(path.indices)]
            for doc, text in zip(batch.column(0).to_pylist(), common.texts(batch.column(1)), strict=True):
                own = tokens.packed(text.decode(), vocabulary) + pad
                n = -(-len(own) // stride)
                ids += [doc] * n
                numbers += range(n)
                counts.append(n)
                payloads += [own[stride * k : stride * (k + 1)] for k in range(n)]
            row = (first + np.asarray(batch.column(3)).astype(np.uint64)) << np.uint64(PLACE)
            permuted = order.slots(np.repeat(row, counts) + np.array(numbers, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(permuted), pa.array((permuted // width).astype(np.int32)), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], names=["key", "shard", "doc_id", "seq_no", "payload"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pa.fs.FileSystem.from_uri(out)
        fs.create_dir(top, recursive=True)
        shard, stream, aside, done = -1, None, "", 0

        def close() -> None:
            if stream is not None:
                stream.close()
                fs.move(aside, f"{top}/shard-{shard:08d}.bin")

        for batch in batches:
            of, payloads = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            places = []
            for own, payload in zip(of, payloads, strict=True):
                if own != shard:
                    close()
                    shard, done, aside = own, 0, f"{top}/_{own:08d}-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(aside)
                stream.write(payload + pad * ((stride - len(payload)) // 2))
                places.append(done)
                done += 1
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(places, pa.int64()), batch.column(2), batch.column(3), pa.array([len(p) // 2 for p in payloads], pa.int32()), pa.array([zlib.crc32(p) for p in payloads], pa.int64())], names=["shard", "place", "doc_id", "seq_no", "n_tokens", "crc32"])
        close()

    dealt = rows.mapInArrow(sequences, "key long, shard int, doc_id long, seq_no int, payload binary").repartitionById(shards, "shard").sortWithinPartitions("shard", "key")
    dealt.mapInArrow(write, RAW).write.option("compression", "zstd").parquet(f"{out}/sequences")
    if temporary:
        common.remove(spark, temporary)
    # a row for each shard: its first slot
    sizes = sorted((r.shard, r["count"]) for r in spark.read.schema(RAW).parquet(f"{out}/sequences").groupBy("shard").count().collect())
    begin = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int).tolist()
    spark.createDataFrame([(shard, begin[k], n) for k, (shard, n) in enumerate(sizes)], "shard int, first long, n long").repartition(1).write.option("compression", "zstd").parquet(f"{out}/shards")
    return manifest(spark, out, length)


def manifest(spark: SparkSession, out: str, length: int = LENGTH) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, seq_no, n_tokens, crc32) of what stands under ``out``."""
    shards = spark.read.schema("shard int, first long, n long").parquet(f"{out}/shards").select("shard", "first")
    rows = spark.read.schema(RAW).parquet(f"{out}/sequences").join(F.broadcast(shards), "shard")
    return rows.select((F.col("first") + F.col("place")).alias("slot"), "shard", (F.col("place") * 2 * length).alias("byte_offset"), "doc_id", "seq_no", "n_tokens", "crc32")


def read(spark: SparkSession, out: str, slot: int, n: int, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The ``n`` sequences from ``slot`` on, padded, one after another: where a reader stopped it goes on."""
    fs, top = pa.fs.FileSystem.from_uri(out)
    for shard in spark.read.parquet(f"{out}/shards").where((F.col("first") + F.col("n") > slot) & (F.col("first") < slot + n)).orderBy("first").collect():
        at = max(slot, shard.first)
        some = min(slot + n, shard.first + shard.n) - at
        with fs.open_input_file(f"{top}/shard-{shard.shard:08d}.bin") as f:
            f.seek((at - shard.first) * 2 * length)
            yield from np.frombuffer(f.read(some * 2 * length), "<u2").reshape(-1, length)


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(common.table(spark, sf_dir, "documents"), common.scratch_path(spark, "token-shards"))
