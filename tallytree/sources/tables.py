"""Record sources and sinks."""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def read_records(spark: SparkSession, source: str | DataFrame, columns: list[str] | None = None, sep: str = ",", nrows: int | None = None, format: str | None = None, schema: str | None = None, order_by: list[str] | None = None) -> DataFrame:
    """A table with only ``columns``: a DataFrame, a catalog table, or a path (CSV with a header, Parquet, ORC or JSON).

    ``nrows`` of at least 1 takes the first rows, in the order of ``order_by`` where given; otherwise all are read.
    """
    if isinstance(source, DataFrame):
        df = source
    else:
        kind = format or {".parquet": "parquet", ".orc": "orc", ".json": "json", ".csv": "csv", ".txt": "csv"}.get(os.path.splitext(source.rstrip("/"))[1], "table")
        reader = spark.read.schema(schema) if schema else spark.read
        if kind == "table":
            df = reader.table(source)
        elif kind == "csv":
            df = reader.options(header=True, sep=sep, inferSchema=schema is None).csv(source)
        else:
            df = reader.format(kind).load(source)
    if columns is not None:
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"no column {', '.join(missing)} in {df.columns}")
        df = df.select(*columns)
    if nrows is not None and nrows > 0:
        df = df.orderBy(*order_by).limit(nrows) if order_by else df.limit(nrows)
    return df


def checked_path(path: str, default: str = "noisy_data.csv") -> str:
    """``path``, or for a local path in a folder that doesn't exist the default, with a warning. Other schemes are left to Spark."""
    if "://" not in path and (parent := os.path.dirname(path)) and not os.path.isdir(parent):
        log.warning("folder %s doesn't exist; %s is used", parent, default)
        return default
    return path


def write_records(df: DataFrame, path: str, format: str = "csv", sep: str = ",") -> str:
    """Overwrites ``path`` (CSV with a header, or another of Spark's formats)."""
    path = checked_path(path)
    writer = df.write.mode("overwrite")
    writer.options(header=True, sep=sep).csv(path) if format == "csv" else writer.format(format).save(path)
    return path
