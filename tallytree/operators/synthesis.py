"""Records from counts, and checks of what was published."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records that one row makes at most, so that a cell with very many is spread over tasks.
RUN = 100_000


def synthesise(leaves: DataFrame, domain: DataFrame, hierarchy: list[str], queries: list[str], count: str = "x") -> DataFrame:
    """Each cell of each leaf as often as it counts: columns hierarchy and then queries, with the source's types."""
    some = leaves.where(F.col(count) > 0).select(*hierarchy, "cell_id", F.col(count).cast("long").alias("__n"))
    some = some.join(F.broadcast(domain), "cell_id")
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / RUN).cast("long"))
    some = some.withColumn("__run", F.explode(runs)).withColumn("__n", F.least(F.lit(RUN).cast("long"), F.col("__n") - F.col("__run") * RUN))
    return some.select(*hierarchy, *queries, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__k")).drop("__k")


def total_violations(parents: DataFrame, children: DataFrame, path: list[str], count: str = "x") -> DataFrame:
    """Nodes (*path, total, children_total) whose grand total isn't their children's; ``path`` is the parents'."""
    a = parents.groupBy(*path).agg(F.sum(count).alias("total"))
    b = children.groupBy(*path).agg(F.sum(count).alias("children_total"))
    joined = a.join(b, path, "full") if path else a.crossJoin(b)
    return joined.where(~F.col("total").eqNullSafe(F.col("children_total")))


def cell_violations(parents: DataFrame, children: DataFrame, path: list[str], count: str = "x") -> DataFrame:
    """The same cell by cell, which is stronger."""
    keys = [*path, "cell_id"]
    b = children.groupBy(*keys).agg(F.sum(count).alias("children_total"))
    return parents.select(*keys, F.col(count).alias("total")).join(b, keys, "full").where(~F.col("total").eqNullSafe(F.col("children_total")))


def check_correctness(levels: list[DataFrame], hierarchy: list[str], count: str = "x") -> None:
    """An error that names a node if some parent isn't the sum of its children."""
    for k in range(len(levels) - 1):
        if bad := cell_violations(levels[k], levels[k + 1], hierarchy[:k], count).take(1):
            raise ValueError(f"level {k}, {'/'.join(str(bad[0][h]) for h in hierarchy[:k]) or 'root'}: {bad[0]}")


def distances(level: DataFrame, path: list[str], truth: str = "n", other: str = "x") -> DataFrame:
    """(*path, manhattan, euclidean, cosine) between true and published counts of each node."""
    a, b = F.col(truth).cast("double"), F.col(other).cast("double")
    norm = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
    measures = [F.sum(F.abs(a - b)).alias("manhattan"), F.sqrt(F.sum((a - b) * (a - b))).alias("euclidean"), F.when(norm > 0, 1 - F.sum(a * b) / norm).alias("cosine")]
    return level.groupBy(*path).agg(*measures)


def masked_sums(level: DataFrame, domain: DataFrame, expression, path: list[str], count: str = "n") -> DataFrame:
    """(*path, masked_sum): what the cells that meet an expression add up to, in each node."""
    cells = expression.mask(domain).select("cell_id", "mask")
    return level.join(F.broadcast(cells), "cell_id").groupBy(*path).agg(F.sum(F.when(F.col("mask"), F.col(count)).otherwise(0)).alias("masked_sum"))


def all_levels(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)
