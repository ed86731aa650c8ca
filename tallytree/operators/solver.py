"""Least squares and controlled rounding for one parent's children, in numpy.

``relax`` finds the x >= 0 nearest to c with A x = b: a semi-smooth Newton method on the dual, where
x = max(c + A'l, 0). ``round_margins`` rounds x to whole numbers, up or down by at most one, at the least
squared change, so that all margins hold: the columns' (cells over children) and those of disjoint rows
(cells of one child). That is a minimum-cost flow, solved by successive shortest paths between rows.
``round_general`` does the same for any equations by branch and bound, and fails beyond its effort.
"""

from __future__ import annotations

import numpy as np

from .constraints import InfeasibleError


class SolverError(RuntimeError):
    """No solution within the given effort."""


SNAP = 1e-6
#: A cost of one in whole numbers, and what stands for no way.
UNIT, FAR = 1 << 44, 1 << 60


def relax(c: np.ndarray, row: np.ndarray, var: np.ndarray, b: np.ndarray, steps: int = 200, tolerance: float = 1e-7, apart: int = 0, weight: np.ndarray | None = None) -> np.ndarray:
    """c: targets; (row, var, weight): the entries of A, ones without weights; b: right-hand sides. The first ``apart`` equations
    have weights of one and share no variable with each other (a parent's cells): their block of the Newton matrix is diagonal,
    so only the others are solved for."""
    n, m = len(c), len(b)
    if m == 0:
        return np.maximum(c, 0.0)
    w = np.ones(len(row)) if weight is None else weight.astype(float)
    up, down = (np.bincount(row, s * w > 0, m) > 0 for s in (1, -1))
    if (~up & (b > 0)).any() or (~down & (b < 0)).any():
        raise InfeasibleError("a sum can't be reached")
    x0 = np.ones(n, bool)
    x0[var[((b == 0) & ~(up & down))[row]]] = False  # a sum of 0 empties all its cells, if their weights have one sign
    newton = _Newton(n, m, row, var, apart, w)
    lam, scale = np.zeros(m), 1 + float(np.abs(b).max())

    def point(l: np.ndarray) -> np.ndarray:
        return np.where(x0, np.maximum(c + np.bincount(var, w * l[row], n), 0.0), 0.0)

    def value(l: np.ndarray, x: np.ndarray) -> float:
        return 0.5 * float(x @ x) - float(b @ l)

    x = point(lam)
    for _ in range(steps):
        g = np.bincount(row, w * x[var], m) - b
        if np.abs(g).max() <= tolerance * scale:
            return x
        d = newton.step(x > 0, g)
        t, before, slope = 1.0, value(lam, x), float(g @ d)
        while t > 1e-12:
            new = lam + t * d
            y = point(new)
            if value(new, y) <= before + 1e-4 * t * slope + 1e-12 * abs(before):
                break
            t /= 2
        lam, x = new, y
        if np.abs(lam).max() > 1e12:
            break
    g = np.bincount(row, w * x[var], m) - b
    if np.abs(g).max() <= 1e-4 * scale:
        return x
    raise InfeasibleError(f"the equations can't hold together (off by {np.abs(g).max():.3g})")


class _Newton:
    """Steps -(A D A')^-1 g, D being 1 for active variables, by the Schur complement of the first ``apart`` equations.

    Memory is that of the ones of A, of a square of the other equations, and of a block of at most BLOCK numbers.
    """

    BLOCK = 1 << 22
    SHIFT = 1e-8

    def __init__(self, n: int, m: int, row: np.ndarray, var: np.ndarray, apart: int, weight: np.ndarray) -> None:
        self.apart, self.rest = apart, m - apart
        first = row < apart
        self.column = np.full(n, -1)
        self.column[var[first]] = row[first]
        at, self.sum, self.of, self.w = np.flatnonzero(~first), row[~first] - apart, var[~first], weight[~first]
        order = np.argsort(self.column[self.of], kind="stable")
        self.sum, self.of, self.w = self.sum[order], self.of[order], self.w[order]
        self.col = self.column[self.of]  # ascending; -1: in no column
        # pairs of the other equations that share a variable
        by = np.argsort(self.of, kind="stable")
        counts = np.bincount(self.of, minlength=n)
        ends = np.cumsum(counts)
        a, b = [np.arange(len(at))], [np.arange(len(at))]
        for gap in range(1, int(counts.max(initial=0))):
            here = np.flatnonzero(np.arange(len(by)) + gap < np.repeat(ends, counts))
            a += [by[here], by[here + gap]]
            b += [by[here + gap], by[here]]
        self.a, self.b = np.concatenate(a), np.concatenate(b)

    def step(self, active: np.ndarray, g: np.ndarray) -> np.ndarray:
        k, r = self.apart, self.rest
        inside = self.column[active]
        diagonal = np.bincount(inside[inside >= 0], minlength=k)[:k] + self.SHIFT
        top, low = -g[:k], -g[k:]
        if not r:
            return top / diagonal
        on = active[self.of]
        both = on[self.a]
        a, b = self.a[both], self.b[both]
        S = np.bincount(self.sum[a] * r + self.sum[b], self.w[a] * self.w[b], r * r).reshape(r, r).astype(float)
        S[np.diag_indices(r)] += self.SHIFT * max(1.0, float(np.trace(S)) / r)
        cross = on & (self.col >= 0)
        col, sum_, w = self.col[cross], self.sum[cross], self.w[cross]
        width = max(1, self.BLOCK // r)
        for lo in range(0, k, width):
            i, j = np.searchsorted(col, [lo, lo + width])
            if i == j:
                continue
            B = np.zeros((min(width, k - lo), r))
            np.add.at(B, (col[i:j] - lo, sum_[i:j]), w[i:j])
            S -= B.T @ (B / diagonal[lo : lo + width, None])
        d = np.linalg.solve(S, low - np.bincount(sum_, w * (top / diagonal)[col], r)) if len(col) else np.linalg.solve(S, low)
        return np.concatenate([(top - (np.bincount(col, w * d[sum_], k) if k else 0)) / diagonal, d])


def snapped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole parts and remainders, near-integers being taken as integers."""
    near = np.rint(x)
    x = np.where(np.abs(x - near) < SNAP, near, x)
    whole = np.floor(x)
    return whole.astype(np.int64), x - whole


def round_margins(whole: np.ndarray, part: np.ndarray, row_of: np.ndarray, column_sum: np.ndarray | None, row_sum: np.ndarray, tie: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """whole, part, tie, open_: (children, cells); row_of: the row node of each, or -1; sums are those of the result.

    open_ cells may be raised by one. Without column sums only the rows count.
    """
    K, n = whole.shape
    y = np.zeros((K, n), bool)
    gain = np.where(open_, (1 - 2 * part) + 1e-9 * tie, np.inf)  # cost of raising
    if column_sum is None:
        for r, total in enumerate(row_sum):
            at = np.argwhere((row_of == r) & open_)
            m = int(total - whole[row_of == r].sum())
            if not 0 <= m <= len(at):
                raise InfeasibleError("a sum can't be reached by rounding")
            best = at[np.argsort(gain[tuple(at.T)], kind="stable")][:m]
            y[tuple(best.T)] = True
        rest = (row_of < 0) & open_ & (part > 0.5)
        return whole + (y | rest)
    need = (column_sum - whole.sum(axis=0)).astype(np.int64)
    if (need < 0).any() or (need > open_.sum(axis=0)).any():
        raise InfeasibleError("a cell's sum can't be reached by rounding")
    # one node for each (child, row) and one for each child's cells without a row
    names: dict[tuple[int, int], int] = {}
    node = np.empty((K, n), np.int64)
    for k in range(K):
        for g in np.unique(row_of[k]):
            node[k, row_of[k] == g] = names.setdefault((k, int(g)), len(names))
    R = len(names)
    target = np.full(R, np.nan)
    for (_, g), i in names.items():
        if g >= 0:
            target[i] = row_sum[g]
    bound = ~np.isnan(target)
    fixed = np.bincount(node.ravel(), whole.ravel(), R)
    # costs in whole numbers: with fractions, errors of many near-ties would make cycles that seem to gain
    costs = np.rint(np.where(open_, gain, 0) * UNIT).astype(np.int64)
    ranks = np.argsort(np.where(open_, costs, FAR), axis=0, kind="stable")
    np.put_along_axis(y, ranks, np.arange(K)[:, None] < need, axis=0)
    cost, have, valid = np.zeros((R, n), np.int64), np.zeros((R, n), bool), np.zeros((R, n), bool)
    cols = np.broadcast_to(np.arange(n), (K, n))
    cost[node, cols], have[node, cols], valid[node, cols] = costs, y, open_
    give, take = np.where(have & valid, -cost, FAR), np.where(~have & valid, cost, FAR)
    between, via, changed = np.full((R, R), FAR), np.zeros((R, R), np.int64), range(R)
    while True:
        surplus = np.where(bound, fixed + have.sum(axis=1) - target, 0)
        if not surplus.any():
            break
        for a in changed:  # only what the last path went through differs
            for out, total in (((a, slice(None)), give[a] + take), ((slice(None), a), give + take[a])):
                via[out] = total.argmin(axis=1)
                least = total[np.arange(R), via[out]]
                between[out] = np.where(least < FAR // 2, least, FAR)
        edge = between.copy()
        np.fill_diagonal(edge, FAR)
        free = np.flatnonzero(~bound)
        edge[np.ix_(free, free)] = np.minimum(edge[np.ix_(free, free)], 0)
        over = surplus > 0
        start = over if over.any() else ~bound
        goal = surplus < 0 if (surplus < 0).any() else ~bound
        if not start.any() or not goal.any():
            raise InfeasibleError("the sums can't be reached by rounding")
        dist, back = np.where(start, 0, FAR), np.full(R, -1)
        for _ in range(R):
            through = np.where((dist < FAR)[:, None] & (edge < FAR), dist[:, None] + edge, FAR)
            best = through.argmin(axis=0)
            better = through[best, np.arange(R)] < dist
            if not better.any():
                break
            dist[better], back[better] = through[best, np.arange(R)][better], best[better]
        end = int(np.where(goal, dist, FAR).argmin())
        if dist[end] >= FAR or back[end] < 0:
            raise InfeasibleError("the sums can't be reached by rounding")
        seen, changed = 0, {end}
        while back[end] >= 0:
            a, seen = int(back[end]), seen + 1
            changed.add(a)
            if between[a, end] < FAR and not (a in free and end in free and edge[a, end] == 0):
                j = via[a, end]
                have[a, j], have[end, j] = False, True
            end = a
            if seen > R:
                raise SolverError("rounding found a cycle")
        for a in changed:
            give[a], take[a] = np.where(have[a] & valid[a], -cost[a], FAR), np.where(~have[a] & valid[a], cost[a], FAR)
    return whole + have[node, cols]


def round_general(whole: np.ndarray, part: np.ndarray, row: np.ndarray, var: np.ndarray, b: np.ndarray, tie: np.ndarray, effort: int = 200_000, weight: np.ndarray | None = None) -> np.ndarray:
    """Any equations in whole numbers (ones without weights), by branch and bound over all cells that are in a sum; ``SolverError`` if the effort ends before the optimum is proven.

    The bound is a Lagrangian one: any prices of the rows give a valid one, and good ones are sought by subgradient steps.
    """
    n, m = len(whole), len(b)
    w = np.ones(len(row), np.int64) if weight is None else weight.astype(np.int64)
    need = (b - np.bincount(row, w * whole[var], m)).round().astype(np.int64)
    cost = (1 - 2 * part) + 1e-9 * tie
    rows_of: list[list[int]] = [[] for _ in range(n)]
    weights_of: list[list[int]] = [[] for _ in range(n)]
    for r, v, x in zip(row.tolist(), var.tolist(), w.tolist(), strict=True):
        rows_of[v].append(r)
        weights_of[v].append(x)
    price = _prices(cost, need, row, var, w)
    reduced = cost - np.bincount(var, w * price[row], n)
    todo = sorted((v for v in range(n) if rows_of[v]), key=lambda v: (min(rows_of[v]), cost[v]))
    left, least = np.zeros((len(todo) + 1, m), np.int64), np.zeros((len(todo) + 1, m), np.int64)  # the most and least that later cells give each row
    bound = np.zeros(len(todo) + 1)  # the least that later cells add, at their reduced costs
    for k in range(len(todo) - 1, -1, -1):
        left[k], least[k] = left[k + 1], least[k + 1]
        left[k][rows_of[todo[k]]] += np.maximum(weights_of[todo[k]], 0)
        least[k][rows_of[todo[k]]] += np.minimum(weights_of[todo[k]], 0)
        bound[k] = bound[k + 1] + min(0.0, reduced[todo[k]])
    best, chosen, spent = np.inf, None, 0
    stack = [(0, 0.0, need, ())]
    while stack:
        k, done, want, picks = stack.pop()
        spent += 1
        if spent > effort:
            raise SolverError("rounding found no solution within its effort" if chosen is None else "rounding found no solution proven nearest within its effort")
        if (want < least[k]).any() or (want > left[k]).any() or done + float(price @ want) + bound[k] >= best - 1e-12:
            continue
        if k == len(todo):
            best, chosen = done, picks
            continue
        v = todo[k]
        less = want.copy()
        less[rows_of[v]] -= weights_of[v]
        options = [(k + 1, done, want, picks), (k + 1, done + cost[v], less, (*picks, v))]
        stack += options if reduced[v] < 0 else options[::-1]
    if chosen is None:
        raise InfeasibleError("no rounding meets the equations")
    y = (part > 0.5) & np.array([not r for r in rows_of], bool)
    y[list(chosen)] = True
    return whole + y


def _prices(cost: np.ndarray, need: np.ndarray, row: np.ndarray, var: np.ndarray, w: np.ndarray, steps: int = 300) -> np.ndarray:
    """Prices of the rows at which choosing cells by reduced cost alone bounds the least cost well from below."""
    n, m = len(cost), len(need)
    price, best, top = np.zeros(m), np.zeros(m), -np.inf
    for t in range(steps):
        reduced = cost - np.bincount(var, w * price[row], n)
        value = float(price @ need) + float(np.minimum(reduced, 0).sum())
        if value > top:
            top, best = value, price.copy()
        slope = need - np.bincount(row, w * (reduced < 0)[var], m)
        if not slope.any():
            break
        price = price + slope / (np.abs(slope).max() * (1 + t / 4))
    return best


def solve(c: np.ndarray, column_sum: np.ndarray | None, sums: list[tuple], tie: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(relaxed, rounded) of one parent's children.

    c, tie, open_: (children, cells); column_sum: the parent's cells, or None for the root; sums: (child, cells, total)
    or (child, cells, total, weights), None being ones. Cells that aren't open are empty.
    """
    K, n = c.shape
    number = np.full((K, n), -1)
    number[open_] = np.arange(open_.sum())
    row, var, b, weight = [], [], [], []
    if column_sum is not None:
        k, j = np.nonzero(open_)
        used = np.flatnonzero(open_.any(axis=0))
        at = np.full(n, -1)
        at[used] = np.arange(len(used))
        if column_sum[~open_.any(axis=0)].any():
            raise InfeasibleError("a parent has records in a cell that all its children must leave empty")
        row, var, b, weight = [at[j]], [number[k, j]], [column_sum[used]], [np.ones(len(j), np.int64)]
    base = len(b[0]) if b else 0
    row_of, disjoint = np.full((K, n), -1), True
    for s, (k, cells, _, *weights) in enumerate(sums):
        w = np.ones(len(cells), np.int64) if not weights or weights[0] is None else np.asarray(weights[0], np.int64)
        w, cells = w[open_[k, cells]], cells[open_[k, cells]]
        disjoint &= bool((w == 1).all())
        weight.append(w)
        disjoint &= bool((row_of[k, cells] < 0).all())
        row_of[k, cells] = s
        row.append(np.full(len(cells), base + s))
        var.append(number[k, cells])
    b.append(np.array([x[2] for x in sums], float))
    row, var, weight = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (row, var, weight))
    b = np.concatenate(b).astype(float)
    x = np.zeros((K, n))
    x[open_] = relax(c[open_].astype(float), row, var, b, apart=base, weight=weight)
    whole, part = snapped(x)
    if disjoint:
        return x, round_margins(whole, part, row_of, column_sum, b[base:], tie, open_)
    out = np.zeros((K, n), np.int64)
    out[open_] = round_general(whole[open_], part[open_], row, var, b, tie[open_], weight=weight)
    return x, out
