"""Contingency domain and hierarchical counts.

A level l of the tree is one frame with the path columns hierarchy[:l], ``cell_id`` and ``n``; level 0
is the root and has no path column. Keeping levels apart avoids null path parts in joins. Records are
read and aggregated once, by ``compact``, to leaves and observed attribute values with their number; domain,
nodes, totals and counts come from that, and upper levels are sums of the level below.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cells beyond which a domain must be asked for expressly: it is broadcast, and every node has all of it.
MOST_CELLS = 1_000_000
#: The column of a compact frame that says how many records a row stands for.
RECORDS = "__records"


def compact(records: DataFrame, hierarchy: list[str], queries: list[str]) -> DataFrame:
    """(*hierarchy, *queries, __records): how many records there are of each kind, nulls being values too."""
    return records.groupBy(*hierarchy, *queries).agg(F.count(F.lit(1)).alias(RECORDS))


def _number(rows: DataFrame) -> Column:
    """The records that a group of ``rows`` stands for."""
    return F.coalesce(F.sum(RECORDS), F.lit(0)) if RECORDS in rows.columns else F.count(F.lit(1))


def domain(records: DataFrame, queries: list[str], most_cells: int = MOST_CELLS, null_policy: str = "drop") -> DataFrame:
    """(cell_id, *queries): the product of the observed values, numbered in lexicographic order.

    ``null_policy`` "value" keeps null as a value, last in order; "drop" leaves it out.
    """
    if not queries:
        raise ValueError("a domain needs at least one query column")
    values = [records.select(c).distinct() if null_policy == "value" else records.select(c).where(F.col(c).isNotNull()).distinct() for c in queries]
    # all columns' numbers of values in one pass
    found = records.agg(*(F.count_distinct(c).alias(f"n{k}") for k, c in enumerate(queries)), *(F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0)).alias(f"z{k}") for k, c in enumerate(queries))).first()
    guard(math.prod(found[f"n{k}"] + (found[f"z{k}"] if null_policy == "value" else 0) for k in range(len(queries))), most_cells)
    product = functools.reduce(lambda a, b: a.crossJoin(F.broadcast(b)), values)
    order = Window.orderBy(*(F.col(c).asc_nulls_last() for c in queries))
    return product.select((F.row_number().over(order) - 1).alias("cell_id"), *queries)


def guard(size: int, most_cells: int = MOST_CELLS) -> None:
    if size > most_cells:
        raise ValueError(f"the domain has {size} cells, over {most_cells}; raise most_cells to go on")


def public_domain(rows: DataFrame, queries: list[str], most_cells: int = MOST_CELLS) -> DataFrame:
    """A domain given beforehand (rows of query values), which so doesn't depend on the records."""
    cells = rows.select(*queries).distinct()
    guard(cells.count(), most_cells)
    return cells.select((F.row_number().over(Window.orderBy(*queries)) - 1).alias("cell_id"), *queries)


def leaf_counts(records: DataFrame, hierarchy: list[str], queries: list[str], cells: DataFrame, null_policy: str = "drop") -> DataFrame:
    """(*hierarchy, cell_id, n) of the non-empty cells of all leaves: one pass, aggregated before the shuffle."""
    if null_policy == "drop":
        records = records.dropna(subset=queries)
    counts = records.withColumnRenamed(RECORDS, "n") if RECORDS in records.columns else records.groupBy(*hierarchy, *queries).agg(F.count(F.lit(1)).alias("n"))
    named = cells.select("cell_id", *(F.col(c).alias(f"__{c}") for c in queries))
    by = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in queries))
    return counts.join(F.broadcast(named), by).select(*hierarchy, "cell_id", "n")


def nodes(records: DataFrame, hierarchy: list[str]) -> list[DataFrame]:
    """The nodes of each level with ``real_total``, the number of all their records; the root is one row."""
    leaves = records.groupBy(*hierarchy).agg(_number(records).alias("real_total")) if hierarchy else None
    out = [leaves]
    for level in range(len(hierarchy) - 1, -1, -1):
        out.append(out[-1].groupBy(*hierarchy[:level]).agg(F.coalesce(F.sum("real_total"), F.lit(0)).alias("real_total")))
    return out[::-1]


def dense(counts: DataFrame, paths: DataFrame, path: list[str], n_cells: int) -> DataFrame:
    """Every cell of every node, with 0 where nothing was counted.

    Only what was counted, and a row for each node, is shuffled: each such row then gives the empty cells up to the node's next one.
    """
    starts = paths.select(*path, F.lit(-1).alias("cell_id"), F.lit(0).cast("long").alias("n"))
    rows = starts.unionByName(counts.select(*path, F.col("cell_id").cast("int").alias("cell_id"), F.col("n").cast("long").alias("n")))
    following = F.lead("cell_id", 1, n_cells).over(Window.partitionBy(*path).orderBy("cell_id"))
    rows = rows.withColumn("__next", following).withColumnRenamed("cell_id", "__from")
    filled = rows.select(*path, "__from", "n", F.explode(F.sequence("__from", F.col("__next") - 1)).alias("cell_id")).where("cell_id >= 0")
    return filled.select(*path, "cell_id", F.when(F.col("cell_id") == F.col("__from"), F.col("n")).otherwise(0).cast("long").alias("n"))


def check_hierarchy(records: DataFrame, hierarchy: list[str]) -> None:
    if not hierarchy:
        raise ValueError("a hierarchy needs at least one column")
    nulls = records.where(functools.reduce(lambda a, b: a | b, (F.col(h).isNull() for h in hierarchy))).limit(1).count()
    if nulls:
        raise ValueError(f"a hierarchy column ({', '.join(hierarchy)}) is null in some record")


def tree(records: DataFrame, hierarchy: list[str], queries: list[str], cells: DataFrame, n_cells: int, null_policy: str = "drop") -> list[DataFrame]:
    """The dense counts of each level, root first."""
    leaf = leaf_counts(records, hierarchy, queries, cells, null_policy)
    sparse = [leaf]
    for level in range(len(hierarchy) - 1, -1, -1):
        sparse.append(sparse[-1].groupBy(*hierarchy[:level], "cell_id").agg(F.sum("n").alias("n")))
    return [dense(s, p, hierarchy[:k], n_cells) for k, (s, p) in enumerate(zip(sparse[::-1], nodes(records, hierarchy), strict=True))]


def stacked(levels: list[DataFrame], hierarchy: list[str], columns: list[str]) -> DataFrame:
    """All levels in one frame (level, *hierarchy, *columns), null below a node's level: level order."""
    parts = [
        df.select(F.lit(k).alias("level"), *(F.col(h) if j < k else F.lit(None).alias(h) for j, h in enumerate(hierarchy)), *columns)
        for k, df in enumerate(levels)
    ]
    return functools.reduce(DataFrame.unionByName, parts[::-1])


def node_flags(levels: list[DataFrame], hierarchy: list[str]) -> DataFrame:
    """(level, *hierarchy, is_root, is_leaf, real_total) of all nodes."""
    rows = stacked(levels, hierarchy, ["real_total"])
    return rows.withColumns({"is_root": F.col("level") == 0, "is_leaf": F.col("level") == len(hierarchy)})


def apply_to_nodes(level: DataFrame, path: list[str], function, schema: str) -> DataFrame:
    """A function of each node's cells (a pandas frame to a pandas frame)."""
    return level.groupBy(*path).applyInPandas(function, schema) if path else level.groupBy().applyInPandas(function, schema)
