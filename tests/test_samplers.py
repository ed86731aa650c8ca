import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tallytree.functions import samplers as S

N = 20000


def chi_square(draws, pmf):
    counts, stat, cells = Counter(draws), 0.0, 0
    for x in range(-60, 61):
        if (expected := N * pmf(x)) >= 8:
            stat += (counts[x] - expected) ** 2 / expected
            cells += 1
    return stat, cells


@pytest.mark.parametrize("scale", [Fraction(1, 2), Fraction(5, 3), Fraction(4)])
def test_laplace(scale):
    rng, s = random.Random(1), float(scale)
    z = (math.exp(1 / s) - 1) / (math.exp(1 / s) + 1)
    stat, cells = chi_square([S.discrete_laplace(scale, rng) for _ in range(N)], lambda x: z * math.exp(-abs(x) / s))
    assert stat < cells + 5 * math.sqrt(2 * cells)


@pytest.mark.parametrize("sigma2", [0.3, 2.0, 9.5])
def test_gaussian(sigma2):
    rng = random.Random(2)
    z = sum(math.exp(-x * x / (2 * sigma2)) for x in range(-100, 101))
    stat, cells = chi_square([S.discrete_gaussian(sigma2, rng) for _ in range(N)], lambda x: math.exp(-x * x / (2 * sigma2)) / z)
    assert stat < cells + 5 * math.sqrt(2 * cells)


def test_parts():
    rng = random.Random(3)
    assert S.discrete_gaussian(0) == 0 and S.geometric_exp(Fraction(0), rng) == 0
    assert abs(sum(S.bernoulli_exp(Fraction(7, 3), rng) for _ in range(N)) / N - math.exp(-7 / 3)) < 0.01
    a = sum(S.geometric_exp(Fraction(3, 7), rng) for _ in range(N)) / N
    b = sum(S.geometric_exp_by_trials(Fraction(3, 7), rng) for _ in range(N)) / N
    assert abs(a - b) < 0.1
    assert [S.floor_sqrt(x) for x in (0, 1, 3, 4, Fraction(35, 4), 10**40)] == [0, 1, 1, 2, 2, 10**20]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            S.discrete_laplace(bad)


@pytest.mark.parametrize("scale", [Fraction(1, 2), Fraction(5, 3), Fraction(4), 1 / Fraction(0.1), 1 / Fraction(0.3)])
def test_many_laplace(scale):
    rng, s = random.Random(4), float(scale)
    z = (math.exp(1 / s) - 1) / (math.exp(1 / s) + 1)
    stat, cells = chi_square(S.discrete_laplaces(N, scale, rng).tolist(), lambda x: z * math.exp(-abs(x) / s))
    assert stat < cells + 5 * math.sqrt(2 * cells)


@pytest.mark.parametrize("sigma2", [0.3, 2.0, 9.5, 1 / (2 * Fraction(0.07))])
def test_many_gaussian(sigma2):
    rng = random.Random(5)
    z = sum(math.exp(-x * x / (2 * float(sigma2))) for x in range(-100, 101))
    stat, cells = chi_square(S.discrete_gaussians(N, sigma2, rng).tolist(), lambda x: math.exp(-x * x / (2 * float(sigma2))) / z)
    assert stat < cells + 5 * math.sqrt(2 * cells)


def test_many_of_extreme_parameters():
    rng = random.Random(6)
    assert S.discrete_gaussians(3, 0).tolist() == [0, 0, 0] and len(S.discrete_laplaces(0, 2)) == 0 and len(S.discrete_gaussians(0, 2)) == 0
    assert not S.discrete_laplaces(100, 1 / Fraction(200.0), rng).any()
    wide = S.discrete_gaussians(400, 10**14, rng)
    assert 0.8 < (wide.astype(float) ** 2).mean() / 1e14 < 1.25
    assert 400 < abs(S.discrete_laplaces(2000, 1 / Fraction(0.001), rng)).mean() < 1600  # terms of over 62 bits
    for m in (5, 2**62):
        draws = S.uniforms(4000, m, rng)
        assert draws.min() >= 0 and draws.max() < m and abs(draws.mean() / m - 0.5 + 0.5 / m) < 0.03
    for bad in (0, -1):
        with pytest.raises(ValueError):
            S.discrete_laplaces(2, bad)
    with pytest.raises(ValueError):
        S.discrete_gaussians(2, -1)


def test_equal_heads_are_told_apart():
    """Where the 62 bits drawn equal the probability's, the rest of it decides."""

    class Ties(random.Random):
        def randbytes(self, n):
            return (5 << 2).to_bytes(8, "little") * (n // 8)

    drawn = S._bernoullis(np.repeat([4, 5, 6], N), lambda k: Fraction(1, 3), Ties(7))
    assert not drawn[:N].any() and drawn[2 * N :].all() and abs(drawn[N : 2 * N].mean() - 1 / 3) < 0.02


def test_a_sampler_takes_a_generator():
    for name in ("discrete_laplace", "discrete_gaussian", "discrete_gaussian_zcdp"):
        assert S.sampler(name, random.Random(8))(0.5) == S.sampler(name, random.Random(8))(0.5)
        a, b = (S.batch_sampler(name)(50, 0.5, random.Random(9)).tolist() for _ in range(2))
        assert a == b and len(set(a)) > 1
