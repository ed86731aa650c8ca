"""The whole release: records, domain, counts, noise, estimates, synthetic records."""

from __future__ import annotations

import logging
import random
import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, estimate, histogram, noise, synthesis
from ..sources import read_records, write_records

log = logging.getLogger(__name__)


@dataclass
class TopDown:
    """Settings first, then ``run``.

    ``hierarchy`` lists the levels below the root, ``queries`` the attributes of a cell. ``public_cells``
    (rows of query values) replaces the cells that would be taken from the records. ``noise_rng`` makes each
    task's generator for exact noise, in place of the operating system's randomness.
    """

    spark: SparkSession
    source: str | DataFrame
    hierarchy: list[str]
    queries: list[str]
    out_path: str | None = None
    sep: str = ";"
    nrows: int | None = None
    format: str | None = None
    null_policy: str = "drop"
    level_semantics: str = "documented"
    seed: int | None = None
    most_cells: int = histogram.MOST_CELLS
    public_cells: DataFrame | None = None
    mechanism: str | None = None
    privacy_parameters: list[float] = field(default_factory=list)
    noise_rng: Callable[[], random.Random] | None = None

    def __post_init__(self) -> None:
        if not self.hierarchy or not self.queries:
            raise ValueError("hierarchy and queries need at least one column each")
        if len({*self.hierarchy, *self.queries}) != len(self.hierarchy) + len(self.queries):
            raise ValueError("a column is listed twice")
        if self.null_policy not in ("drop", "value"):
            raise ValueError(f"unknown null_policy {self.null_policy!r}")
        self.constraints = constraints.Registry(len(self.hierarchy), self.level_semantics)
        self.tie_seed = self.seed if self.seed is not None else secrets.randbits(63)

    # settings
    def set_mechanism(self, name: str) -> TopDown:
        self.mechanism = noise.mechanism(name)
        return self

    def set_privacy_parameters(self, parameters: list[float]) -> TopDown:
        noise.check_budget(parameters, len(self.hierarchy) + 1)
        self.privacy_parameters = list(parameters)
        return self

    def set_constraint_to_tree(self, c) -> TopDown:
        self.constraints.add(c)
        return self

    def set_constraint_to_level(self, level: int, c) -> TopDown:
        self.constraints.add(c, level)
        return self

    def set_constraint_to_node(self, path: list | tuple, c) -> TopDown:
        """``path``: the node's hierarchy values from below the root on."""
        self.constraints.add_at(tuple(path), c)
        return self

    # phases
    def _timed(self, what: str, since: float) -> float:
        log.info("%s: %.2f s", what, time.time() - since)
        return time.time()

    def initialize(self) -> TopDown:
        t = time.time()
        self.records = read_records(self.spark, self.source, [*self.hierarchy, *self.queries], self.sep, self.nrows, self.format)
        # the one reading of the records: all that follows comes from these counts
        self.counted = noise.once(histogram.compact(self.records, self.hierarchy, self.queries))
        histogram.check_hierarchy(self.counted, self.hierarchy)
        if self.public_cells is not None:
            cells = histogram.public_domain(self.public_cells, self.queries, self.most_cells)
        else:
            cells = histogram.domain(self.counted, self.queries, self.most_cells, self.null_policy)
        self.domain = noise.once(cells)
        self.n_cells = self.domain.count()
        self.nodes = histogram.nodes(self.counted, self.hierarchy)
        self.levels = histogram.tree(self.counted, self.hierarchy, self.queries, self.domain, self.n_cells, self.null_policy)
        self._timed("counts", t)
        return self

    def measurement_phase(self) -> TopDown:
        if self.mechanism is None:
            raise ValueError("set a mechanism first; 'none' adds no noise")
        t = time.time()
        budget = self.privacy_parameters or ([1.0] * len(self.levels) if self.mechanism == "none" else [])
        self.measured = noise.measure(self.levels, self.hierarchy, self.mechanism, budget, self.tie_seed, self.noise_rng)
        self._timed("noise", t)
        return self

    def estimation_phase(self) -> TopDown:
        t = time.time()
        held = [constraints.compile_level(self.constraints.at(k), self.domain, self.records, self.nodes[k], self.hierarchy[:k]) for k in range(len(self.levels))]
        self.estimates = []
        estimate.estimate(self.measured, self.hierarchy, held, self.tie_seed, self.estimates)
        self._timed("estimates", t)
        return self

    def construct_microdata(self) -> DataFrame:
        self.synthetic = synthesis.synthesise(self.estimates[-1], self.domain, self.hierarchy, self.queries)
        if self.out_path:
            write_records(self.synthetic, self.out_path)
        return self.synthetic

    def run(self) -> DataFrame:
        return self.initialize().measurement_phase().estimation_phase().construct_microdata()

    def check_correctness(self) -> None:
        synthesis.check_correctness(self.estimates, self.hierarchy)

    def equations(self, level: int | None = None) -> DataFrame:
        """(*path, constraint, cell_id, weight, rhs) of a level; by default of the one at which the estimates ended.

        Meant for ``InfeasibleError``: rows to filter by the path in its message, or to write somewhere.
        """
        k = min(len(getattr(self, "estimates", ())), len(self.hierarchy)) if level is None else level
        return constraints.equations(self.constraints.at(k), self.domain, self.records, self.nodes[k], self.hierarchy[:k])

    def tree(self) -> DataFrame:
        """(level, *hierarchy, cell_id, n, noisy, relaxed, x): all nodes in one frame."""
        return histogram.stacked(self.estimates, self.hierarchy, ["cell_id", "n", "noisy", "relaxed", "x"])

    def iterate_by_levels(self):
        """(level, cells of its nodes), root first."""
        yield from enumerate(self.estimates)

    def n_nodes(self) -> tuple[int, int]:
        """All nodes, and those that aren't leaves."""
        sizes = [df.count() for df in self.nodes]
        return sum(sizes), sum(sizes[:-1])

    def distances(self, level: int) -> DataFrame:
        """(*path, manhattan, euclidean, cosine) of each node of a level; the root is one row."""
        return synthesis.distances(self.estimates[level], self.hierarchy[:level])
