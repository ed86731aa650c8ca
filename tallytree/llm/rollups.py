"""Token counts (10): rollups maintained from signed changes.

A change is an insert (+1), a delete (-1) or, for a revised count, a delete of the old and an insert of
the new one. Counts are additive, so a batch of changes comes down to one small table of signed totals
by source, language and tokenizer version, made with partial aggregation (a source with a third of all
rows is a few rows a task). A batch is committed by renaming its finished folder to its number; a
batch that is there already is left as it is, so a repeated or interrupted commit changes nothing
twice. The rollup is the sum over the committed batches, and never reads documents again. One writer
commits at a time; readers see whole batches only.

Defined results: null sources, languages and versions are groups of their own; null counts and signs
count as zero; groups whose documents and tokens come to nothing are left out; no committed batch gives no
row; other columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"
INSERT, DELETE = 1, -1


def deltas(changes: DataFrame) -> DataFrame:
    """The signed totals of each batch; changes without a batch are left out."""
    sign = F.coalesce(F.col("sign").cast("long"), F.lit(0))
    keys = [F.col(k).cast("string").alias(k) for k in KEYS]
    by = changes.where("batch IS NOT NULL").groupBy(F.col("batch").cast("long").alias("batch"), *keys)
    return by.agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))).alias("n_tokens"))


class Rollup:
    """The committed batches under a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        top = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(top)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def committed(self) -> set[int]:
        return {int(x.getPath().getName()[6:]) for x in self.fs.listStatus(self._path("")) if x.getPath().getName().startswith("batch=")} if self.fs.exists(self._path("")) else set()

    def commit(self, changes: DataFrame) -> list[int]:
        """Commits the batches in ``changes`` (batch, sign, source, lang, version, n_tokens) that aren't yet; returns their numbers."""
        return self.commit_deltas(deltas(changes))

    def commit_deltas(self, totals: DataFrame) -> list[int]:
        """The same for batches that are summed up already."""
        if done := self.committed():
            totals = totals.where(~F.col("batch").isin(sorted(done)))
        aside = self._path(f"_aside-{uuid.uuid4().hex}")
        totals.repartition(1).write.partitionBy("batch").parquet(aside.toString())
        new = []
        for status in self.fs.listStatus(aside):
            name = status.getPath().getName()
            if name.startswith("batch=") and not self.fs.exists(self._path(name)):
                if not self.fs.rename(status.getPath(), self._path(name)):
                    raise OSError(f"{name} could not be committed")
                new.append(int(name[6:]))
        self.fs.delete(aside, True)
        return sorted(new)

    def totals(self) -> DataFrame:
        done = self.committed()
        parts = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/batch={b}" for b in sorted(done))) if done else self.spark.createDataFrame([], SCHEMA)
        return parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")


def counted(docs: DataFrame, version: str, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens, n_bytes): the tokens of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))

    def make(batch: pa.RecordBatch) -> dict:
        texts = common.texts(batch.column(1))
        return {"doc_id": batch.column(0), "source": batch.column(2), "lang": batch.column(3), "version": [version] * len(texts), "n_tokens": [tokens.count(t.decode(), vocabulary) for t in texts], "n_bytes": list(map(len, texts))}

    return common.map_rows(rows, make, "doc_id long, source string, lang string, version string, n_tokens long, n_bytes long")


def inserts(counts: DataFrame, batch) -> DataFrame:
    return counts.select(batch.alias("batch"), F.lit(INSERT).alias("sign"), *KEYS, "n_tokens")


def deletes(counts: DataFrame, batch) -> DataFrame:
    return counts.select(batch.alias("batch"), F.lit(DELETE).alias("sign"), *KEYS, "n_tokens")


def revisions(counts: DataFrame, batch, old, new) -> DataFrame:
    """The old count goes, the new one comes."""
    change = F.explode(F.array(F.struct(F.lit(DELETE).alias("sign"), old.cast("long").alias("n_tokens")), F.struct(F.lit(INSERT).alias("sign"), new.cast("long").alias("n_tokens"))))
    return counts.select(batch.alias("batch"), *KEYS, change.alias("x")).select("batch", "x.sign", *KEYS, "x.n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """Totals of the documents, kept up by signed changes.

    Documents come in ``batches`` with a quarter of their bytes as the count; as many further batches
    revise it to the real count. The first batch has its documents twice; a last one deletes what was too
    much, so that every document counts once, whether it has a token or not. All batches are then sent once
    more, to no effect.
    """
    counts = counted(common.table(spark, sf_dir, "documents"), "byte_bpe_50k")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)), F.lit(0)).cast("long")
    change = lambda batch, sign, n: F.struct(batch.cast("long").alias("batch"), F.lit(sign).alias("sign"), n.cast("long").alias("n_tokens"))
    estimate, first = F.floor(F.col("n_bytes") / 4), part == 0
    sent = F.array(
        change(part, INSERT, estimate),
        change(part + batches, DELETE, estimate),
        change(part + batches, INSERT, F.col("n_tokens")),
        change(F.when(first, part), INSERT, estimate),
        change(F.when(first, F.lit(2 * batches)), DELETE, estimate),
    )
    changes = counts.select(*KEYS, F.explode(sent).alias("x")).select("x.batch", "x.sign", *KEYS, "x.n_tokens")
    sums = common.checkpointed(deltas(changes))
    rollup = Rollup(spark, common.scratch_path(spark, "rollup"))
    rollup.commit_deltas(sums)
    if rollup.commit_deltas(sums):
        raise RuntimeError("a batch was committed twice")
    return rollup.totals()
