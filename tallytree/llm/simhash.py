"""SimHash near-dedup (8) by covering locality-sensitive hashing.

A fingerprint has a bit for the majority of the XXH64 hashes of a text's three-word shingles. Two
fingerprints link if they differ in at most ``RADIUS`` bits. Each bit position gets a random vector of
RADIUS + 1 bits, and each non-zero vector v gives the mask of the positions whose vector has an even
product with v. The at most RADIUS vectors of the differing bits leave some v orthogonal to all of
them, so every pair within the radius agrees on all positions of that mask: it collides in some table,
surely and not only probably.

Exact copies have one fingerprint and are pre-aggregated before any table is built. A bucket with more
than ``BUCKET`` distinct fingerprints is divided again by the same construction over the bits its mask
leaves free, to the point where at most ``LAST_BITS`` bits are free and so at most 2^LAST_BITS
fingerprints can meet; no bucket is capped. Within a bucket, links are found with vectorised popcounts
and only a spanning forest of them is emitted, never all pairs. Components are found by star steps.

Defined results: null and empty texts have fingerprint zero, linked like any other. Texts with one or
two words have one shingle. Repeated rows give one row each. Null ids stay null and take the smallest
id that their fingerprint reaches (null if none). Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS, BUCKET, LAST_BITS, SEED = 3, 256, 8, 20240607


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= 3:
        return h(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - 2
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[2:].tolist(), strict=True)), np.uint64, n)
    votes = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's 64 bits as a signed long."""

    def make(batch: pa.RecordBatch) -> dict:
        found = np.fromiter(map(fingerprint, common.texts(batch.column(1))), np.uint64, batch.num_rows)
        return {"doc_id": batch.column(0), "fp": found.view(np.int64)}

    return common.map_rows(common.id_and_text(docs), make, "doc_id long, fp long")


def masks(bits: list[int], radius: int, seed: int) -> list[int]:
    """For the positions ``bits``, masks of which at least one misses any ``radius`` of them.

    The positions' vectors are dealt out evenly (a seeded shuffle), so the masks have about half of the positions each.
    """
    size = 1 << (radius + 1)
    rng = np.random.default_rng(seed)
    vectors = np.resize(np.arange(1, size), len(bits))
    rng.shuffle(vectors)
    return [sum(1 << b for b, x in zip(bits, vectors.tolist(), strict=True) if (x & v).bit_count() % 2) for v in range(1, size)]


def tables(seed: int = SEED, radius: int = RADIUS) -> list[list[int]]:
    """The masks of each level: a mask and, level by level, its extensions over the bits it leaves free."""
    levels = [masks(list(range(64)), radius, seed)]
    while any(64 - m.bit_count() > LAST_BITS for m in levels[-1]):
        nxt = []
        for k, m in enumerate(levels[-1]):
            free = [b for b in range(64) if not m >> b & 1]
            nxt.append([m | x for x in masks(free, radius, seed + 1000 * len(levels) + k)] if len(free) > LAST_BITS else [m])
        levels.append([x for xs in nxt for x in xs])
        if len(levels) == 8:  # a radius too large for further division; the last buckets are compared in blocks
            break
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _children(level: int, seed: int, radius: int) -> list[list[int]]:
    """For each table of ``level``, the masks of the next level that refine it."""
    levels = tables(seed, radius)
    out, at = [], 0
    for m in levels[level]:
        n = (1 << (radius + 1)) - 1 if 64 - m.bit_count() > LAST_BITS else 1
        out.append(levels[level + 1][at : at + n])
        at += n
    return out


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one bucket."""
    left, out = fps.view(np.uint64), []
    parent = list(range(len(left)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(left) - 1):
        near = np.flatnonzero(np.bitwise_count(left[i + 1 :] ^ left[i]) <= radius)
        for j in near.tolist():
            a, b = root(i), root(i + 1 + j)
            if a != b:
                parent[b] = a
                out.append((int(fps[i]), int(fps[i + 1 + j])))
    return out


def _forests(buckets: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) of buckets (members array<long>), each of at most a few hundred members."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for batch in batches:
            pairs = [x for row in batch.column(0) for x in forest(np.asarray(row.values), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], schema=schema)

    return buckets.select("members").mapInArrow(run, "u long, v long")


def _refined(keyed: DataFrame, below: list[list[int]]) -> DataFrame:
    """Rows of hot buckets dealt out again to the tables that refine theirs: (fp, t, key)."""
    first = np.cumsum([0, *map(len, below)])
    schema = pa.schema([("fp", pa.int64()), ("t", pa.int32()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            fp, t = (np.asarray(batch.column(k)) for k in (0, 1))
            for k in np.unique(t).tolist():
                of, masked = fp[t == k], np.array(below[k], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of, len(masked))), pa.array(np.tile(np.arange(first[k], first[k + 1], dtype=np.int32), len(of))), pa.array((of[:, None] & masked).ravel())], schema=schema)

    return keyed.select("fp", "t").mapInArrow(run, "fp long, t int, key long")


def links(fps: DataFrame, radius: int = RADIUS, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) among distinct fingerprints (fp) that connect exactly what differs in at most ``radius`` bits."""
    levels, found = tables(seed, radius), None
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(levels[0])])).alias("x")).select("fp", "x.t", "x.key")
    for level in range(len(levels)):
        last = level == len(levels) - 1
        counts = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
        if not last:
            counts = common.checkpointed(counts, small=True)
        members = keyed.join(counts if last else counts.where(F.col("n") <= bucket), ["t", "key"])
        small = members.groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
        part = _forests(small, radius)
        found = part if found is None else found.union(part)
        if last or not (hot := counts.where(F.col("n") > bucket)).take(1):
            return found
        keyed = common.checkpointed(_refined(keyed.join(hot.select("t", "key"), ["t", "key"], "left_semi"), _children(level, seed, radius)), small=True)
    return found


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    rows = common.checkpointed(fingerprints(docs))
    distinct = common.checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), small=True)
    roots = common.checkpointed(components(links(distinct.select("fp"), radius, bucket=bucket)), small=True)
    grouped = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    known = grouped.join(least, "root").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all its columns: that of the smallest id.

    Of several rows with that id the one with the least hash of its text stays, of equal rows any one.
    Rows without an id come last.
    """
    id_, print_, hash_, place, d, p, low = common.fresh(docs, "id", "print", "hash", "place", "d", "p", "low")
    rows = common.checkpointed(fingerprints(docs.select("doc_id", "text")).groupBy("doc_id", "fp").count(), small=True)
    distinct = common.checkpointed(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("least")), small=True)
    roots = common.checkpointed(components(links(distinct.select("fp"), radius)), small=True)
    grouped = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = grouped.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("x")).select(F.col("x.least.doc_id").alias(id_), F.col("x.fp").alias(print_))
    chosen = rows.join(first, rows.doc_id.eqNullSafe(F.col(id_)) & (rows.fp == F.col(print_)), "left_semi").select(F.col("doc_id").alias(id_), F.col("fp").alias(print_))
    held = rows.groupBy(F.col("doc_id").alias("held")).agg(F.sum("count").alias("all"))
    chosen = common.checkpointed(chosen.join(held, F.col(id_).eqNullSafe(F.col("held"))).select(id_, print_, (F.col("all") == 1).alias("alone")), small=True)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(id_))
    kept = docs.join(chosen.where("alone").select(id_), same, "left_semi")
    again = chosen.where("NOT alone").select(id_, print_)
    if not again.take(1):
        return kept
    # repeated ids: their rows are told apart by fingerprint and text, and the least one is found by partial aggregation
    repeated = _with_fingerprint(docs.join(again.select(id_).distinct(), same, "left_semi"), print_).withColumn(hash_, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    least = repeated.groupBy(F.col("doc_id").cast("long").alias(d), F.col(print_).alias(p)).agg(F.min(hash_).alias(low))
    least = least.join(again, F.col(d).eqNullSafe(F.col(id_)) & (F.col(p) == F.col(print_)), "left_semi")
    told = repeated.join(least, repeated["doc_id"].cast("long").eqNullSafe(F.col(d)) & (repeated[print_] == F.col(p)) & (repeated[hash_] == F.col(low)), "left_semi")
    # equal texts under one id: any one of them, found by partial aggregation too
    one = told.groupBy(F.col("doc_id").cast("long").alias(d), F.col(print_).alias(p)).agg(F.first(F.struct(*docs.columns)).alias(place))
    return kept.unionByName(one.select(f"{place}.*"))


def _with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*docs.schema.fields]).add(name, LongType())

    def run(batches):
        for batch in batches:
            found = np.fromiter(map(fingerprint, common.texts(batch.column(batch.schema.get_field_index("text")))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
