"""What the operators share: reading, shared scratch space, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) modulo FOLDS is HELD_OUT are never trained on.
FOLDS, HELD_OUT = 5, 0
#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 4 << 20
#: Files that a small frame is written to, for each core of the session.
FILES_A_CORE = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) a local one is set.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallytree-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def checkpointed(df: DataFrame, small: bool = False) -> DataFrame:
    """``df`` written to the shared folder; Spark removes the files once unused if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.

    small: the rows hold no texts, only ids, hashes and counts. They are then written by FILES_A_CORE tasks for
    each core at most: a file costs more than its few bytes, on a plain local file system even a child process
    of the executor. The tasks read one shuffle partition after another, so none needs more memory.
    """
    shared_dir(df.sparkSession)
    if small:
        df = df.coalesce(FILES_A_CORE * max(1, df.sparkSession.sparkContext.defaultParallelism))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it none of the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` as a compressed table in the shared folder, and its path for ``remove``."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: Column) -> Column:
    """Null ids count as held out: they have no fold to learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and the text's UTF-8 bytes (null: empty); whatever else ``docs`` has is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            done = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str, most: int = CHUNK_BYTES) -> DataFrame:
    """``df`` run through ``make``, batch by batch: columns by name in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=most):
            out = make(batch)
            yield pa.RecordBatch.from_arrays([v if isinstance(v := out[f.name], pa.Array) and v.type == f.type else pa.array(v, type=f.type, from_pandas=True) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kinds)


def kept_rows(docs: DataFrame, verdicts: Callable[[pa.Array], np.ndarray], column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, for which ``verdicts`` of their texts is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column):
            text = batch.column(batch.schema.get_field_index(column))
            yield batch.filter(pa.array(np.asarray(verdicts(text), dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


def texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column; null is empty."""
    return [b"" if x is None else x for x in (col.cast(pa.binary()) if pa.types.is_string(col.type) else col).to_pylist()]


def _training_labels(labels: DataFrame, label: str) -> DataFrame:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def label_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """How many training rows either class has."""
    return {r.y: r["count"] for r in _training_labels(labels, label).groupBy("y").count().collect()}


def bounded_labels(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled training rows of either class, chosen by a hash of doc_id: (doc_id, y, text).

    Held-out rows and labels other than 0 and 1 are left out; a doc_id with several labels takes
    the largest, one with several rows the least text. The ids chosen don't grow with the input, so they are
    broadcast to the scan of ``docs``; neither do the rows returned, however often an id is repeated.
    """
    rows = _training_labels(labels, label)
    some = None
    for kind in (0, 1):
        part = rows.where(F.col("y") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    return id_and_text(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
