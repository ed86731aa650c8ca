"""Exact sampling of discrete Laplace and discrete Gaussian noise with rational arithmetic only.

After Canonne, Kamath and Steinke, "The Discrete Gaussian for Differential Privacy" (arXiv 2004.00010).
No floating point takes part, and by default all randomness comes from the operating system. The functions
named in the plural draw many numbers at once, in 64-bit integers: each trial that would need longer ones
compares 62 bits first and goes on with rational numbers only where those are equal, so they are exact too.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from fractions import Fraction

import numpy as np

_SYSTEM = random.SystemRandom()


def uniform(m: int, rng=None) -> int:
    """One of 0..m-1."""
    return (rng or _SYSTEM).randrange(m)


def bernoulli(p: Fraction, rng=None) -> bool:
    return uniform(p.denominator, rng) < p.numerator


def _bernoulli_exp_unit(x: Fraction, rng) -> bool:
    """True with probability exp(-x) for x in [0, 1]: the parity of the first k at which Bernoulli(x/k) fails."""
    k = 1
    while bernoulli(x / k, rng):
        k += 1
    return k % 2 == 1


def bernoulli_exp(x: Fraction, rng=None) -> bool:
    """True with probability exp(-x), for x not negative: the whole part is so many trials of exp(-1)."""
    x = Fraction(x)
    if x < 0:
        raise ValueError("x must not be negative")
    whole = x.numerator // x.denominator
    return all(_bernoulli_exp_unit(Fraction(1), rng) for _ in range(whole)) and _bernoulli_exp_unit(x - whole, rng)


def geometric_exp_by_trials(x: Fraction, rng=None) -> int:
    """How many trials of exp(-x) succeed before one fails."""
    n = 0
    while bernoulli_exp(x, rng):
        n += 1
    return n


def geometric_exp(x: Fraction, rng=None) -> int:
    """The same distribution for x = s/t: u in 0..t-1 weighted by exp(-u/t), plus t times trials of exp(-1), over s."""
    x = Fraction(x)
    if x == 0:
        return 0
    s, t = x.numerator, x.denominator
    u = uniform(t, rng)
    while not bernoulli_exp(Fraction(u, t), rng):
        u = uniform(t, rng)
    return (u + t * geometric_exp_by_trials(Fraction(1), rng)) // s


def discrete_laplace(scale, rng=None) -> int:
    """Probability proportional to exp(-|x| / scale)."""
    scale = Fraction(scale)
    if scale <= 0:
        raise ValueError("scale must be positive")
    while True:
        negative, size = bernoulli(Fraction(1, 2), rng), geometric_exp(1 / scale, rng)
        if size or not negative:  # zero counts once
            return -size if negative else size


def floor_sqrt(x) -> int:
    x = Fraction(x)
    return math.isqrt(x.numerator // x.denominator)


def discrete_gaussian(sigma2, rng=None) -> int:
    """Probability proportional to exp(-x^2 / (2 sigma2)); 0 for sigma2 = 0. Rejection from discrete Laplace."""
    sigma2 = Fraction(sigma2)
    if sigma2 < 0:
        raise ValueError("sigma2 must not be negative")
    if sigma2 == 0:
        return 0
    t = floor_sqrt(sigma2) + 1
    while True:
        y = discrete_laplace(t, rng)
        if bernoulli_exp((abs(y) - sigma2 / t) ** 2 / (2 * sigma2), rng):
            return y


def _bits(n: int, bits: int, rng) -> np.ndarray:
    """n numbers of so many random bits, 63 at most."""
    if bits == 0:
        return np.zeros(n, np.int64)
    return (np.frombuffer((rng or _SYSTEM).randbytes(8 * n), "<u8") >> np.uint64(64 - bits)).astype(np.int64)


def uniforms(n: int, m: int, rng=None) -> np.ndarray:
    """n numbers of 0..m-1, for m up to 2^62."""
    bits = (m - 1).bit_length()
    out = _bits(n, bits, rng)
    while len(over := np.flatnonzero(out >= m)):
        out[over] = _bits(len(over), bits, rng)
    return out


def _exp_units(n: int, trial: Callable[[np.ndarray], np.ndarray] | None, rng) -> np.ndarray:
    """True with probability exp(-x) for an x in [0, 1] of each place: ``trial`` gives Bernoulli(x) for given places, None is x = 1.

    Bernoulli(x/k) is Bernoulli(x) and, independent of it, one chance in k.
    """
    out, alive, k = np.zeros(n, bool), np.arange(n), 1
    while len(alive):
        on = uniforms(len(alive), k, rng) == 0
        if trial is not None:
            on[on] = trial(alive[on])
        out[alive[~on]] = k % 2 == 1
        alive, k = alive[on], k + 1
    return out


def _successes(n: int, rng) -> np.ndarray:
    """How many trials of exp(-1) succeed before one fails."""
    out, alive = np.zeros(n, np.int64), np.arange(n)
    while len(alive):
        alive = alive[_exp_units(len(alive), None, rng)]
        out[alive] += 1
    return out


def discrete_laplaces(n: int, scale, rng=None) -> np.ndarray:
    """n draws of ``discrete_laplace``; scales whose terms don't fit 64 bits are drawn one by one."""
    scale = Fraction(scale)
    if scale <= 0:
        raise ValueError("scale must be positive")
    t, s = scale.numerator, scale.denominator
    if t > 1 << 62 or s > 1 << 62:
        return np.array([discrete_laplace(scale, rng) for _ in range(n)], dtype=np.int64)
    out, todo = np.zeros(n, np.int64), np.arange(n)
    while m := len(todo):
        u, refused = uniforms(m, t, rng), np.arange(m)
        while True:  # u weighted by exp(-u/t)
            mine = u[refused]
            refused = refused[~_exp_units(len(refused), lambda at, mine=mine: uniforms(len(at), t, rng) < mine[at], rng)]
            if not len(refused):
                break
            u[refused] = uniforms(len(refused), t, rng)
        v = _successes(m, rng)
        whole, rest = divmod(t, s)  # (u + t v) div s, in parts that fit
        if int(v.max()) * rest + t < 1 << 63 and int(v.max()) * whole < 1 << 62:
            size = v * whole + (u + v * rest) // s
        else:
            size = np.array([(a + t * b) // s for a, b in zip(u.tolist(), v.tolist(), strict=True)], dtype=np.int64)
        negative = _bits(m, 1, rng) == 1
        ok = (size > 0) | ~negative  # zero counts once
        out[todo[ok]] = np.where(negative, -size, size)[ok]
        todo = todo[~ok]
    return out


def _bernoullis(head: np.ndarray, rest: Callable[[int], Fraction], rng) -> np.ndarray:
    """True with probability (head + rest) / 2^62 of each place; ``rest`` in [0, 1) is asked for only where the bits drawn equal head."""
    r = _bits(len(head), 62, rng)
    on = r < head
    for k in np.flatnonzero(r == head):
        on[k] = bernoulli(rest(int(k)), rng)
    return on


def discrete_gaussians(n: int, sigma2, rng=None) -> np.ndarray:
    """n draws of ``discrete_gaussian``."""
    sigma2 = Fraction(sigma2)
    if sigma2 < 0:
        raise ValueError("sigma2 must not be negative")
    if sigma2 == 0:
        return np.zeros(n, np.int64)
    p, q, t = sigma2.numerator, sigma2.denominator, floor_sqrt(sigma2) + 1
    below = 2 * p * q * t * t
    out, todo = np.zeros(n, np.int64), np.arange(n)
    while len(todo):
        y = discrete_laplaces(len(todo), t, rng)
        sizes, of = np.unique(np.abs(y), return_inverse=True)
        parts = [divmod((size * q * t - p) ** 2, below) for size in sizes.tolist()]  # whole part and remainder of the exponent
        heads = [divmod(rest << 62, below) for _, rest in parts]
        whole = np.array([min(w, 1 << 62) for w, _ in parts], dtype=np.int64)[of]
        head = np.array([h for h, _ in heads], dtype=np.int64)[of]
        maybe = np.flatnonzero(_successes(len(todo), rng) >= whole)

        def trial(at: np.ndarray, at_of=of[maybe], head=head[maybe], heads=heads) -> np.ndarray:
            return _bernoullis(head[at], lambda k: Fraction(heads[at_of[at[k]]][1], below), rng)

        ok = maybe[_exp_units(len(maybe), trial, rng)]
        out[todo[ok]] = y[ok]
        todo = np.delete(todo, ok)
    return out


def sampler(name: str, rng=None) -> Callable[[float], int]:
    """A mechanism's draw for its parameter."""
    return {
        "discrete_laplace": lambda epsilon: discrete_laplace(1 / Fraction(epsilon), rng),
        "discrete_gaussian": lambda sigma2: discrete_gaussian(sigma2, rng),
        "discrete_gaussian_zcdp": lambda rho: discrete_gaussian(1 / (2 * Fraction(rho)), rng),
    }[name]


def batch_sampler(name: str) -> Callable[..., np.ndarray]:
    """(n, parameter, rng) to n draws of a mechanism."""
    return {
        "discrete_laplace": lambda n, epsilon, rng=None: discrete_laplaces(n, 1 / Fraction(epsilon), rng),
        "discrete_gaussian": discrete_gaussians,
        "discrete_gaussian_zcdp": lambda n, rho, rng=None: discrete_gaussians(n, 1 / (2 * Fraction(rho)), rng),
    }[name]
