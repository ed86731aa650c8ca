"""Constraints: predicates that become linear equations over the cells of nodes.

A bare logical expression says that the cells that don't meet it are empty. A sum says that the cells
that do meet it add up to a number: a constant, the node's record count, or an aggregate of its records.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import LogicalExpression


class InfeasibleError(ValueError):
    """The constraints can't hold together; the message names the constraint and the node."""


class Constraint(ABC):
    expression: LogicalExpression

    def cells(self, domain: DataFrame) -> DataFrame:
        """The cell_ids that the expression holds for."""
        return domain.where(self.expression.to_column(domain.schema)).select("cell_id")

    def weights(self) -> Column:
        """What a cell counts for, as a whole number; a subclass may take it from the cell's attributes."""
        return F.lit(1)

    def weighted_cells(self, domain: DataFrame) -> DataFrame:
        """(cell_id, weight) of the cells that the expression holds for."""
        return domain.select("cell_id", self.weights().alias("weight")).join(F.broadcast(self.cells(domain)), "cell_id")

    @abstractmethod
    def right_hand_sides(self, records: DataFrame, nodes: DataFrame, path: list[str]) -> DataFrame:
        """(*path, rhs) for all nodes of a level."""


@dataclass(frozen=True)
class StructuralZero(Constraint):
    """Cells that don't meet the expression are empty."""

    expression: LogicalExpression

    def cells(self, domain: DataFrame) -> DataFrame:
        return domain.where(~self.expression.to_column(domain.schema)).select("cell_id")

    def right_hand_sides(self, records, nodes, path):
        return nodes.select(*path, F.lit(0).cast("long").alias("rhs"))


@dataclass(frozen=True)
class AggregateConstraint(Constraint, ABC):
    expression: LogicalExpression


@dataclass(frozen=True)
class SumEqual(AggregateConstraint):
    """The cells add up to ``value`` in every node."""

    value: int

    def right_hand_sides(self, records, nodes, path):
        if self.value < 0 or self.value != int(self.value):
            raise InfeasibleError(f"{self!r}: counts never add up to {self.value}")
        return nodes.select(*path, F.lit(int(self.value)).cast("long").alias("rhs"))


@dataclass(frozen=True)
class WeightedSumEqual(AggregateConstraint):
    """The cells, each times ``weight`` (a whole number from its attributes, of any sign), add up to ``value`` in every node."""

    weight: Column
    value: int

    def weights(self) -> Column:
        return self.weight

    def right_hand_sides(self, records, nodes, path):
        if self.value != int(self.value):
            raise InfeasibleError(f"{self!r}: whole numbers never add up to {self.value}")
        return nodes.select(*path, F.lit(int(self.value)).cast("long").alias("rhs"))


@dataclass(frozen=True)
class ContextualAggregateConstraint(AggregateConstraint):
    """The cells add up to an aggregate of the node's records: a Spark aggregate column, evaluated for all nodes at
    once, or a function of a node's records as a pandas frame."""

    aggregation_function: Column | Callable

    def right_hand_sides(self, records, nodes, path):
        if isinstance(self.aggregation_function, Column):
            return records.groupBy(*path).agg(self.aggregation_function.cast("long").alias("rhs"))
        import pandas as pd

        function, keys = self.aggregation_function, {f.name: f.dataType.simpleString() for f in records.schema.fields if f.name in path}

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            value = function(frame)
            if value is None:
                raise ValueError("the aggregate gave no value")
            return pd.DataFrame([{**{p: frame[p].iloc[0] for p in path}, "rhs": int(value)}])

        schema = ", ".join([*(f"`{p}` {keys[p]}" for p in path), "rhs long"])
        return records.groupBy(*path).applyInPandas(one, schema) if path else records.groupBy().applyInPandas(one, schema)


@dataclass(frozen=True)
class SumEqualRealTotal(AggregateConstraint):
    """The cells add up to the number of all the node's records (those with nulls too). It releases that number without noise."""

    def right_hand_sides(self, records, nodes, path):
        return nodes.select(*path, F.col("real_total").alias("rhs"))


@dataclass(frozen=True)
class AtNode(Constraint):
    """A constraint that holds in the node at ``path`` (its hierarchy values from below the root on) and in no other.

    Its parent is estimated without it, so what the parent was given may leave no room for it: ``InfeasibleError``.
    """

    held: Constraint
    path: tuple

    @property
    def expression(self) -> LogicalExpression:
        return self.held.expression

    def cells(self, domain):
        return self.held.cells(domain)

    def weights(self):
        return self.held.weights()

    def right_hand_sides(self, records, nodes, path):
        if len(path) != len(self.path):
            raise ValueError(f"{self!r} has no right-hand side at level {len(path)}")
        here = [F.col(p) == F.lit(v) for p, v in zip(path, self.path, strict=True)]
        for condition in here:
            records, nodes = records.where(condition), nodes.where(condition)
        if not nodes.take(1):
            raise ValueError(f"{self!r}: there is no such node")
        return self.held.right_hand_sides(records, nodes, path)


def as_constraint(c: Constraint | LogicalExpression) -> Constraint:
    if isinstance(c, Constraint):
        return c
    if isinstance(c, LogicalExpression):
        return StructuralZero(c)
    raise TypeError(f"{c!r} is neither a constraint nor a logical expression")


class Registry:
    """Which constraints hold at which levels, 0 being the root.

    A constraint for level l holds from the root down to l, so that a parent never needs what its
    children may not have. ``level_semantics`` "offset" takes one level more, down to the leaves at most.
    """

    def __init__(self, depth: int, level_semantics: str = "documented") -> None:
        if level_semantics not in ("documented", "offset"):
            raise ValueError(f"unknown level_semantics {level_semantics!r}")
        self.depth, self.offset = depth, int(level_semantics == "offset")
        self.held: list[tuple[Constraint, int]] = []

    def add(self, c: Constraint | LogicalExpression, level: int | None = None) -> None:
        if level is not None and not 0 <= level <= self.depth:
            raise ValueError(f"there is no level {level}")
        self.held.append((as_constraint(c), self.depth if level is None else min(level + self.offset, self.depth)))

    def add_at(self, path: tuple, c: Constraint | LogicalExpression) -> None:
        if len(path) > self.depth:
            raise ValueError(f"there is no level {len(path)}")
        self.held.append((AtNode(as_constraint(c), tuple(path)), len(path)))

    def at(self, level: int) -> list[Constraint]:
        return [c for c, last in self.held if (level == last if isinstance(c, AtNode) else level <= last)]


@dataclass
class Compiled:
    """A level's constraints over a domain: cells that must be empty, and the sums' (name, cells, right-hand sides, weights).

    Weights are None where all are 1. ``under`` has the parents that have children with sums, None standing for all.
    """

    zeros: set[int]
    sums: list[tuple[str, list[int], DataFrame, list[int] | None]]
    under: set[tuple] | None = None


def compile_level(held: list[Constraint], domain: DataFrame, records: DataFrame, nodes: DataFrame, path: list[str]) -> Compiled:
    """Cells are gathered on the driver: there are no more of them than the domain's limit. Sums over no cell are
    folded: right-hand side 0 holds, another can't."""
    out = Compiled(set(), [], set())
    for c in held:
        if isinstance(c, StructuralZero):
            out.zeros |= {r.cell_id for r in c.cells(domain).collect()}
    for c in held:
        if isinstance(c, StructuralZero):
            continue
        sides = c.right_hand_sides(records, nodes, path)
        weight = {r.cell_id: r.weight for r in c.weighted_cells(domain).collect()}
        if any(w is None or w != int(w) for w in weight.values()):
            raise ValueError(f"{c!r}: weights must be whole numbers")
        cells = sorted(x for x, w in weight.items() if w and x not in out.zeros)
        if not cells:
            if bad := sides.where("rhs <> 0").take(1):
                raise InfeasibleError(f"{c!r} can't hold at {_named(path, bad[0])}: no cell is left, the sum should be {bad[0].rhs}")
            continue
        if isinstance(c, SumEqual) and c.value == 0:
            out.zeros |= set(cells)
            continue
        out.sums.append((repr(c), cells, sides, [int(weight[x]) for x in cells]))
        if not isinstance(c, AtNode):
            out.under = None
        elif out.under is not None:
            out.under.add(c.path[:-1])
    sums, out.sums = out.sums, []
    for name, cells, sides, weights in sums:  # cells may have been emptied since
        kept = [(x, w) for x, w in zip(cells, weights, strict=True) if x not in out.zeros]
        if kept:
            out.sums.append((name, [x for x, _ in kept], sides, None if all(w == 1 for _, w in kept) else [w for _, w in kept]))
        elif bad := sides.where("rhs <> 0").take(1):
            raise InfeasibleError(f"{name} can't hold at {_named(path, bad[0])}: no cell is left")
    return out


def equations(held: list[Constraint], domain: DataFrame, records: DataFrame, nodes: DataFrame, path: list[str]) -> DataFrame:
    """(*path, constraint, cell_id, weight, rhs): a level's equations as rows, to look into what can't hold together.

    cell_id is null where no cell is concerned. A rule's cells add up to 0.
    """
    out = None
    for c in held:
        cells = c.weighted_cells(domain).select("cell_id", F.col("weight").cast("long").alias("weight"), F.lit(repr(c)).alias("constraint"))
        sides = c.right_hand_sides(records, nodes, path).withColumn("constraint", F.lit(repr(c)))
        one = sides.join(F.broadcast(cells), "constraint", "left").select(*path, "constraint", "cell_id", "weight", "rhs")
        out = one if out is None else out.unionByName(one)
    return nodes.select(*path, F.lit("").alias("constraint"), F.lit(0).alias("cell_id"), *(F.lit(0).cast("long").alias(x) for x in ("weight", "rhs"))).limit(0) if out is None else out


def _named(path: list[str], row) -> str:
    return "/".join(str(row[p]) for p in path) or "the root"


def constraint_rows(c: Constraint | LogicalExpression, domain: DataFrame, records: DataFrame, nodes: DataFrame, path: list[str], name: str) -> DataFrame:
    """(*path, constraint_id, cell_id, rhs): the equation of every node as rows; cell_id is null where no cell is concerned."""
    c = as_constraint(c)
    sides = c.right_hand_sides(records, nodes, path)
    cells = c.cells(domain).withColumn("constraint_id", F.lit(name))
    return sides.withColumn("constraint_id", F.lit(name)).join(F.broadcast(cells), "constraint_id", "left").select(*path, "constraint_id", "cell_id", "rhs")


def folded(rows: DataFrame, path: list[str]) -> DataFrame:
    """(*path, constraint_id, rhs, n_cells, status) with status "active", "trivial" or "infeasible"."""
    out = rows.groupBy(*path, "constraint_id", "rhs").agg(F.count("cell_id").alias("n_cells"))
    return out.withColumn("status", F.when(F.col("n_cells") > 0, "active").when(F.col("rhs") == 0, "trivial").otherwise("infeasible"))
