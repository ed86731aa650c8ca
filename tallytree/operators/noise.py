"""Privacy budgets and noise mechanisms.

A mechanism adds an independent draw to every cell of every node, structural zeros included. The exact
ones draw in Arrow batches with the operating system's randomness and must be drawn once only: a second
draw of the same counts is a second release. ``measure`` therefore writes what it drew to the shared
folder before anything reads it. The seeded ones are for tests: they can be recomputed, and aren't private.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import samplers


def geometric_budget(total: float, n_levels: int) -> list[float]:
    """Twice as much for each level as for the one above."""
    return [total * 2**k / (2**n_levels - 1) for k in range(n_levels)]


def uniform_budget(total: float, n_levels: int) -> list[float]:
    return [total / n_levels] * n_levels


def check_budget(budget: list[float], n_levels: int) -> None:
    if len(budget) != n_levels:
        raise ValueError(f"{n_levels} levels need {n_levels} parameters, not {len(budget)}")
    if not all(b > 0 and math.isfinite(b) for b in budget):
        raise ValueError("parameters must be positive")


def hashed_uniform(seed: int, level: int, path: list[str], tag: str) -> Column:
    """A number in (0, 1] from the first 52 bits of an md5 of seed, place and tag."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(str(level)), *(F.col(p).cast("string") for p in path), F.col("cell_id").cast("string"), F.lit(tag))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def seeded_laplace(epsilon: float, seed: int, level: int, path: list[str]) -> Column:
    """The difference of two geometric numbers; not private."""
    size = lambda tag: F.floor(-F.log(hashed_uniform(seed, level, path, tag)) / F.lit(epsilon))
    return (size("a") - size("b")).cast("long")


def gaussian_table(sigma2: float) -> tuple[int, list[float]]:
    """The least value and the cumulative probabilities from it on."""
    reach = max(1, math.ceil(9 * math.sqrt(sigma2)))
    weights = [math.exp(-x * x / (2 * sigma2)) for x in range(-reach, reach + 1)]
    total, out, done = sum(weights), [], 0.0
    for w in weights:
        done += w
        out.append(done / total)
    return -reach, out[:-1]


def seeded_gaussian(sigma2: float, seed: int, level: int, path: list[str]) -> Column:
    """By the inverse of the cumulative probabilities; not private."""
    least, table = gaussian_table(sigma2)
    u = hashed_uniform(seed, level, path, "g")
    return (F.size(F.filter(F.array(*map(F.lit, table)), lambda c: c < u)) + least).cast("long")


SEEDED: dict[str, Callable[[float, int, int, list[str]], Column]] = {"none": lambda *_: F.lit(0).cast("long"), "seeded_laplace": seeded_laplace, "seeded_gaussian": seeded_gaussian}
EXACT: dict[str, Callable] = {name: samplers.batch_sampler(name) for name in ("discrete_laplace", "discrete_gaussian", "discrete_gaussian_zcdp")}


def register_mechanism(name: str, draw: Callable[[float], int]) -> None:
    """A mechanism of the user's: one integer for a level's parameter."""
    EXACT[name] = lambda n, parameter, rng=None: np.array([draw(parameter) for _ in range(n)], dtype=np.int64)


def mechanism(name: str) -> str:
    if name not in SEEDED and name not in EXACT:
        raise ValueError(f"unknown mechanism {name!r}; there are {', '.join([*SEEDED, *EXACT])}")
    return name


def add_noise(level: DataFrame, name: str, parameter: float, path: list[str], depth: int, seed: int = 0, rng: Callable[[], random.Random] | None = None) -> DataFrame:
    """The level with ``noisy`` beside ``n``. ``rng`` makes a task's generator for the exact mechanisms, in place of the
    operating system's randomness; it is called in each task, and generators of two tasks must differ."""
    if mechanism(name) in SEEDED:
        return level.withColumn("noisy", F.col("n") + SEEDED[name](parameter, seed, depth, path))
    draw = EXACT[name]

    @F.pandas_udf("long")
    def noise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = rng() if rng else None
        for n in batches:
            yield n + draw(len(n), parameter, own)

    return level.withColumn("noisy", noise.asNondeterministic()(F.col("n")))


def once(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that it is never computed again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> None:
    """The folder in spark.checkpoint.dir; one of this machine only where the session names none and runs in one process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not at and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="tallytree-"))


def measure(levels: list[DataFrame], hierarchy: list[str], name: str, budget: list[float], seed: int = 0, rng: Callable[[], random.Random] | None = None) -> list[DataFrame]:
    """Each level with noise at its parameter, drawn once."""
    check_budget(budget, len(levels))
    return [once(add_noise(df, name, b, hierarchy[:k], k, seed, rng)) for k, (df, b) in enumerate(zip(levels, budget, strict=True))]
