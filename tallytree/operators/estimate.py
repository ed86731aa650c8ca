"""Estimation, level by level: counts that aren't negative, add up to their parents' and meet the constraints.

Where a group's only equation is its sum (children of a parent cell; all cells of a root with a total) the
nearest point and its rounding have a closed form, done in exact integers by window functions. Children with
sums of their own are solved per parent, all parents of a level in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import solver
from .constraints import Compiled, InfeasibleError, _named
from .noise import once


def tie_breaker(seed: int, path: list[str]) -> Column:
    """A hash for each child and cell: remainders in a group are all equal, and no child should always win."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") for p in path), F.col("cell_id").cast("string"), F.lit("t"))
    return F.md5(key.cast("binary"))


def project(df: DataFrame, group: list[str], value: str, total: str, tie: str = "tb") -> DataFrame:
    """Adds ``relaxed`` (double) and ``x`` (long): the nearest non-negative point of each group with sum ``total``, and its
    rounding, remainders by size and then ``tie``. Both are exact: all that are not zero are shifted by e / k."""
    ranked = Window.partitionBy(*group).orderBy(F.col(value).desc(), tie)
    all_ = Window.partitionBy(*group)
    df = df.withColumns({"__i": F.row_number().over(ranked).cast("long"), "__cs": F.sum(value).over(ranked.rowsBetween(Window.unboundedPreceding, 0))})
    df = df.withColumn("__k", F.max(F.when(F.col(value) * F.col("__i") > F.col("__cs") - F.col(total), F.col("__i"))).over(all_))
    df = df.withColumn("__e", F.max(F.when(F.col("__i") == F.col("__k"), F.col("__cs") - F.col(total))).over(all_))
    up = F.col(value) * F.col("__k") - F.col("__e")
    on = F.coalesce(up > 0, F.lit(False))
    df = df.withColumns({
        "relaxed": F.when(on, up / F.col("__k")).otherwise(0.0).cast("double"),
        "__f": F.when(on, F.expr(f"({value} * __k - __e) div __k")).otherwise(0).cast("long"),
        "__r": F.when(on, up % F.col("__k")).otherwise(0).cast("long"),
    })
    rest = Window.partitionBy(*group).orderBy(F.col("__r").desc(), tie)
    df = df.withColumns({"__m": F.col(total) - F.sum("__f").over(all_), "__n": F.row_number().over(rest)})
    return df.withColumn("x", F.col("__f") + F.when(F.col("__n") <= F.col("__m"), 1).otherwise(0)).drop("__i", "__cs", "__k", "__e", "__f", "__r", "__m", "__n")


def _ids(spark: SparkSession, zeros: set[int]) -> DataFrame:
    """Cells as a frame to broadcast; the domain's limit bounds them."""
    return F.broadcast(spark.createDataFrame([(int(z),) for z in sorted(zeros)], "cell_id int"))


def _open(level: DataFrame, zeros: set[int]) -> DataFrame:
    """Without the cells that must be empty."""
    return level.join(_ids(level.sparkSession, zeros), "cell_id", "left_anti") if zeros else level


def _with_zeros(solved: DataFrame, level: DataFrame, zeros: set[int]) -> DataFrame:
    """All cells again, the empty ones with 0; ``solved`` has the columns of ``level``, so nothing is shuffled."""
    solved = solved.select(*level.columns, "relaxed", "x")
    if not zeros:
        return solved
    empty = level.join(_ids(level.sparkSession, zeros), "cell_id", "left_semi")
    return solved.unionByName(empty.select(*level.columns, F.lit(0.0).alias("relaxed"), F.lit(0).cast("long").alias("x")))


def estimate_root(level: DataFrame, held: Compiled, seed: int = 0) -> DataFrame:
    """(cell_id, n, noisy, relaxed, x) of the root: one node, whose cells the domain's limit bounds."""
    open_ = _open(level, held.zeros)
    if not held.sums:
        return _with_zeros(open_.withColumns({"x": F.greatest("noisy", F.lit(0)), "relaxed": F.greatest("noisy", F.lit(0)).cast("double")}), level, held.zeros)
    n_open = open_.count()
    if len(held.sums) == 1 and len(held.sums[0][1]) == n_open and held.sums[0][3] is None:
        total = held.sums[0][2].first().rhs
        rows = open_.withColumns({"__g": F.lit(0), "__p": F.lit(total).cast("long"), "tb": tie_breaker(seed, [])})
        return _with_zeros(project(rows, ["__g"], "noisy", "__p"), level, held.zeros)
    rows = open_.withColumn("tb", tie_breaker(seed, [])).select("cell_id", "n", "noisy", "tb").orderBy("cell_id").toPandas()
    at = {c: k for k, c in enumerate(rows.cell_id)}
    sums = [(0, np.array([at[c] for c in cells]), int(sides.first().rhs), weights) for _, cells, sides, weights in held.sums]
    tie = rows.tb.rank().to_numpy()[None, :]
    try:
        relaxed, x = solver.solve(rows.noisy.to_numpy()[None, :], None, sums, tie / max(1, len(rows)), np.ones((1, len(rows)), bool))
    except InfeasibleError as e:
        raise InfeasibleError(f"at the root: {e}; constraints: {', '.join(name for name, *_ in held.sums)}") from e
    frame = pd.DataFrame({"cell_id": rows.cell_id.astype("int32"), "n": rows.n, "noisy": rows.noisy, "relaxed": relaxed[0], "x": x[0]})
    return _with_zeros(level.sparkSession.createDataFrame(frame, "cell_id int, n long, noisy long, relaxed double, x long"), level, held.zeros)


def estimate_children(level: DataFrame, parents: DataFrame, path: list[str], held: Compiled, seed: int = 0) -> DataFrame:
    """(*path, cell_id, n, noisy, relaxed, x): ``parents`` has (*path[:-1], cell_id, x)."""
    up = path[:-1]
    above = parents.select(*up, "cell_id", F.col("x").alias("__p"))
    rows = _open(level, held.zeros).join(above, [*up, "cell_id"]).withColumn("tb", tie_breaker(seed, path))
    if held.zeros:
        blocked = above.where(F.col("__p") > 0).join(_ids(level.sparkSession, held.zeros), "cell_id", "left_semi").take(1)
        if blocked:
            raise InfeasibleError(f"under {_named(up, blocked[0])}: cell {blocked[0].cell_id} must be empty, but its parent has {blocked[0]['__p']}")
    if not held.sums:
        return _with_zeros(project(rows, [*up, "cell_id"], "noisy", "__p"), level, held.zeros)
    others = None
    if held.under is not None:  # sums of single nodes: only their parents are solved in Python
        mine = F.lit(False)
        for parent in sorted(held.under, key=repr):
            here = F.lit(True)
            for u, v in zip(up, parent, strict=True):
                here &= F.col(u) == F.lit(v)
            mine |= here
        others, rows = project(rows.where(~mine), [*up, "cell_id"], "noisy", "__p"), rows.where(mine)
    for k, (_, _, sides, _) in enumerate(held.sums):
        rows = rows.join(sides.select(*path, F.col("rhs").alias(f"__s{k}")), path, "left")
    cells_of, weights_of, names = [cells for _, cells, _, _ in held.sums], [w for *_, w in held.sums], [name for name, *_ in held.sums]
    child, seed_ = path[-1], seed

    def one_parent(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([child, "cell_id"], kind="stable", ignore_index=True)
        children, cells = frame[child].unique(), np.sort(frame.cell_id.unique())
        shape = (len(children), len(cells))
        at = {c: j for j, c in enumerate(cells.tolist())}
        c, tie = frame.noisy.to_numpy().reshape(shape), frame.tb.rank().to_numpy().reshape(shape) / len(frame)
        parent = frame["__p"].to_numpy().reshape(shape)[0]
        firsts = frame.iloc[:: len(cells)]
        held_by = [(s, k) for s in range(len(cells_of)) for k in np.flatnonzero(firsts[f"__s{s}"].notna().to_numpy()).tolist()]
        sums = [(k, np.array([at[x] for x in cells_of[s]], int), int(firsts[f"__s{s}"].iloc[k]), weights_of[s]) for s, k in held_by]
        try:
            relaxed, x = solver.solve(c, parent, sums, tie, np.ones(shape, bool))
        except InfeasibleError as e:
            where = "/".join(str(frame[u].iloc[0]) for u in up) or "the root"
            raise InfeasibleError(f"under {where}: {e}; constraints: {', '.join(names)}; seed {seed_}") from e
        return frame[[*path, "cell_id", "n", "noisy"]].assign(relaxed=relaxed.ravel(), x=x.ravel())

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{p}` {kinds[p]}" for p in path), "cell_id int, n long, noisy long, relaxed double, x long"])
    grouped = rows.groupBy(*up)
    solved = grouped.applyInPandas(one_parent, schema)
    return _with_zeros(solved if others is None else solved.unionByName(others.select(*solved.columns)), level, held.zeros)


def estimate(levels: list[DataFrame], hierarchy: list[str], held: list[Compiled], seed: int = 0, out: list[DataFrame] | None = None) -> list[DataFrame]:
    """All levels, root first; each is written before the next one reads it. ``out`` gets them as they are done."""
    out = [] if out is None else out
    out.append(once(estimate_root(levels[0], held[0], seed)))
    for k in range(1, len(levels)):
        out.append(once(estimate_children(levels[k], out[-1], hierarchy[:k], held[k], seed)))
    return out
