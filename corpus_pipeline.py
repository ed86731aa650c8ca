"""A training-data pipeline over ``documents``: each stage reads what its predecessor kept.

The quality classifier drops what it rejects, SimHash near-dedup keeps one document of each group,
suffix-array dedup cuts repeated passages (400 bytes or 51 words) out of the texts, decontamination drops documents with
benchmark passages, and the rest is encoded to SentencePiece ids, the best segmentation's and those of the
following ones (``others``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallytree.llm import common, decontaminate, pieces, quality, simhash, suffixes


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.BEST)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: A trained classifier and a piece lattice aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each stage's rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs, path = common.written(out, name)
        if before:
            common.remove(spark, before)
        before = path
