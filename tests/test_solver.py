import itertools

import numpy as np
import pytest

from tallytree.operators import solver
from tallytree.operators.constraints import InfeasibleError


def instance(rng, K, n, full=True):
    truth = rng.poisson(2, (K, n))
    c = truth + rng.integers(-3, 4, (K, n))
    if full:
        sums = [(k, np.arange(n), int(truth[k].sum())) for k in range(K)]
    else:
        sums = [(k, np.flatnonzero(m), int(truth[k, m].sum())) for k in range(K) if (m := rng.random(n) < 0.6).any()]
    return c, truth.sum(axis=0), sums, rng.random((K, n))


@pytest.mark.parametrize("full", [True, False])
def test_margins_and_optimality(full):
    rng = np.random.default_rng(3)
    for _ in range(60):
        K, n = int(rng.integers(2, 4)), int(rng.integers(2, 5))
        c, parent, sums, tie = instance(rng, K, n, full)
        x, y = solver.solve(c, parent, sums, tie * 0, np.ones((K, n), bool))
        assert (x >= 0).all() and np.allclose(x.sum(axis=0), parent, atol=1e-4)
        assert (y.sum(axis=0) == parent).all() and all(y[k, cells].sum() == t for k, cells, t in sums)
        whole, part = solver.snapped(x)
        best = min(
            (((part - z) ** 2).sum() for bits in itertools.product((0, 1), repeat=K * n) for z in [np.reshape(bits, (K, n))] if ((whole + z).sum(axis=0) == parent).all() and all((whole + z)[k, cells].sum() == t for k, cells, t in sums)),
        )
        assert ((part - (y - whole)) ** 2).sum() == pytest.approx(best, abs=1e-6)


def test_many_near_ties_are_rounded():
    """Whole targets make remainders whose exchanges all but cancel out; these sizes are too large to enumerate."""
    rng = np.random.default_rng(1)
    for K, n, full in ((10, 100, True), (25, 300, True), (12, 200, False)):
        c, parent, sums, tie = instance(rng, K, n, full)
        x, y = solver.solve(c, parent, sums, tie, np.ones((K, n), bool))
        assert (y.sum(axis=0) == parent).all() and all(y[k, cells].sum() == t for k, cells, t in sums)
        assert (y >= 0).all() and (abs(y - x) <= 1 + 1e-6).all()


def test_newton_steps_by_elimination():
    """Eliminating a parent's cells gives the point that a dense matrix gives, for overlapping sums too."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        K, n = int(rng.integers(2, 6)), int(rng.integers(2, 9))
        row, var = [np.tile(np.arange(n), K)], [np.arange(K * n)]
        truth = rng.poisson(2, (K, n))
        b = list(truth.sum(axis=0))
        for k in range(K):
            for _ in range(2):
                cells = np.flatnonzero(rng.random(n) < 0.6)
                row.append(np.full(len(cells), len(b)))
                var.append(k * n + cells)
                b.append(truth[k, cells].sum())
        c, row, var, b = rng.normal(2, 3, K * n), np.concatenate(row), np.concatenate(var), np.array(b, float)
        a = solver.relax(c, row, var, b, apart=n)
        z = solver.relax(c, row, var, b)
        assert np.allclose(a, z, atol=1e-5) and np.allclose(np.bincount(row, a[var], len(b)), b, atol=1e-4)


def test_relaxation_is_nearest():
    """No feasible direction between two cells of a group comes nearer."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(2, 9))
        c, total = rng.integers(-5, 9, n).astype(float), float(rng.integers(0, 20))
        x = solver.relax(c, np.zeros(n, int), np.arange(n), np.array([total]))
        assert x.sum() == pytest.approx(total, abs=1e-5) and (x >= 0).all()
        for i, j in itertools.permutations(range(n), 2):
            if x[i] > 1e-3:
                z = x.copy()
                z[i] -= 1e-3
                z[j] += 1e-3
                assert ((z - c) ** 2).sum() >= ((x - c) ** 2).sum() - 1e-5


def test_overlapping_sums():
    c = np.array([[3, 1, 2, 0]])
    sums = [(0, np.array([0, 1]), 5), (0, np.array([1, 2]), 4)]
    x, y = solver.solve(c, None, sums, np.zeros((1, 4)), np.ones((1, 4), bool))
    assert y[0, 0] + y[0, 1] == 5 and y[0, 1] + y[0, 2] == 4 and (y >= 0).all()


def nearest(whole, part, row, var, b):
    m = len(b)
    return min((((part - z) ** 2).sum() for bits in itertools.product((0, 1), repeat=len(whole)) for z in [np.array(bits)] if (np.bincount(row, (whole + z)[var], m) == b).all()), default=None)


def test_overlapping_sums_are_rounded_to_the_nearest():
    rng = np.random.default_rng(11)
    for _ in range(80):
        n, m = int(rng.integers(3, 11)), int(rng.integers(2, 5))
        row, var = np.nonzero(rng.random((m, n)) < 0.6)
        whole, part = rng.integers(0, 4, n), np.where(rng.random(n) < 0.4, 0.0, rng.random(n))
        b = np.bincount(row, (whole + (rng.random(n) < 0.5))[var], m)
        got = solver.round_general(whole, part, row, var, b, np.zeros(n)) - whole
        assert ((part - got) ** 2).sum() == pytest.approx(nearest(whole, part, row, var, b), abs=1e-9)
    # a whole cell shared by both sums costs less than two cells with small remainders
    whole, part = np.zeros(3, int), np.array([0.1, 0.0, 0.1])
    row, var = np.array([0, 0, 1, 1]), np.array([0, 1, 1, 2])
    assert solver.round_general(whole, part, row, var, np.array([1, 1]), np.zeros(3)).tolist() == [0, 1, 0]


def test_weighted_sums():
    """Relaxed to the nearest point (its distance along feasible directions) and rounded to the nearest, by enumeration."""
    rng, solved = np.random.default_rng(21), 0
    for _ in range(80):
        n, m = int(rng.integers(3, 9)), int(rng.integers(1, 4))
        A = rng.integers(-2, 4, (m, n)) * (rng.random((m, n)) < 0.7)
        row, var = np.nonzero(A)
        weight, truth = A[row, var], rng.poisson(2, n)
        c, b = truth + rng.normal(0, 2, n), A @ truth
        x = solver.relax(c, row, var, b.astype(float), weight=weight)
        assert (x >= 0).all() and np.allclose(A @ x, b, atol=1e-3)
        # the truth is feasible, so no step towards it comes nearer
        z = x + 1e-3 * (truth - x)
        assert ((z - c) ** 2).sum() >= ((x - c) ** 2).sum() - 1e-5
        whole, part = rng.integers(0, 4, n), np.where(rng.random(n) < 0.4, 0.0, rng.random(n))
        b = A @ (whole + (rng.random(n) < 0.5))
        best = min(((part - z) ** 2).sum() for bits in itertools.product((0, 1), repeat=n) for z in [np.array(bits)] if (A @ (whole + z) == b).all())
        got = solver.round_general(whole, part, row, var, b, np.zeros(n), weight=weight) - whole
        assert (A @ (whole + got) == b).all() and ((part - got) ** 2).sum() == pytest.approx(best, abs=1e-9)
        solved += 1
    assert solved == 80
    # children of one parent: the parent's cells beside a weighted sum of each child
    for _ in range(30):
        K, n = int(rng.integers(2, 4)), int(rng.integers(2, 5))
        truth, w = rng.poisson(2, (K, n)), rng.integers(1, 4, n)
        sums = [(k, np.arange(n), int(truth[k] @ w), w) for k in range(K)]
        try:
            x, y = solver.solve(truth + rng.integers(-1, 2, (K, n)), truth.sum(axis=0), sums, rng.random((K, n)), np.ones((K, n), bool))
        except InfeasibleError as e:
            assert "rounding" in str(e)  # weights may leave no rounding by less than one
            continue
        assert np.allclose(x.sum(axis=0), truth.sum(axis=0), atol=1e-3) and np.allclose(x @ w, truth @ w, atol=1e-3)
        assert (y.sum(axis=0) == truth.sum(axis=0)).all() and (y @ w == truth @ w).all() and (y >= 0).all()


def test_an_end_of_effort_is_an_error():
    rng, failed, whole = np.random.default_rng(12), 0, np.zeros(12, int)
    for _ in range(15):
        row, var = np.nonzero(rng.random((3, 12)) < 0.5)
        part, b = rng.random(12), np.bincount(row, (rng.random(12) < 0.5)[var], 3)
        best = nearest(whole, part, row, var, b)
        for effort in (5, 13, 14, 15, 20, 25, 30, 40, 60, 100, 200, 400):
            try:
                got = solver.round_general(whole, part, row, var, b, np.zeros(12), effort)
            except solver.SolverError:
                failed += 1
                continue
            assert ((part - got) ** 2).sum() == pytest.approx(best, abs=1e-9)
    assert failed


def test_infeasible():
    ones = np.ones((2, 2), bool)
    with pytest.raises(InfeasibleError):
        solver.solve(np.zeros((2, 2)), np.array([1, 1]), [(0, np.arange(2), 5), (1, np.arange(2), 5)], np.zeros((2, 2)), ones)
    with pytest.raises(InfeasibleError):
        solver.solve(np.zeros((1, 2)), None, [(0, np.arange(2), -1)], np.zeros((1, 2)), np.ones((1, 2), bool))
