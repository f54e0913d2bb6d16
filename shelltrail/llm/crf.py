"""A linear-chain conditional random field with two states, in numpy.

State 1 of a position scores ``score`` (its log-odds by features), state 0 scores 0;
neighbouring states score ``trans[i, j]`` and the first state of a chain ``start[j]``.
Many chains lie one after another in flat arrays; ``first`` marks where each begins. The
forward and backward recursions are products of 2 x 2 matrices. They run over blocks of
positions side by side, then over the blocks, so a chain of any length costs the same for
each position; the result is exact.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256


def _scan(m: np.ndarray) -> np.ndarray:
    """Row vectors v[t] = v[t-1] m[t], each scaled to sum 1, from v[-1] = (1, 1). m: (4, n)."""
    n = m.shape[1]
    blocks = -(-n // BLOCK)
    grid = np.zeros((4, blocks * BLOCK))
    grid[0], grid[3] = 1, 1
    grid[:, :n] = m
    # position within the block first, so that each step works on contiguous numbers
    a, b, c, d = np.ascontiguousarray(grid.reshape(4, blocks, BLOCK).transpose(0, 2, 1))
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(BLOCK):
        p, q, r, s = p * a[t] + q * c[t], p * b[t] + q * d[t], r * a[t] + s * c[t], r * b[t] + s * d[t]
        size = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / size, q / size, r / size, s / size
    x, y = np.empty(blocks), np.empty(blocks)
    u, v = 0.5, 0.5
    for k, (e, f, g, h) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        x[k], y[k] = u, v
        u, v = u * e + v * g, u * f + v * h
        u, v = u / (u + v), v / (u + v)
    out = np.empty((2, BLOCK, blocks))
    for t in range(BLOCK):
        x, y = x * a[t] + y * c[t], x * b[t] + y * d[t]
        size = x + y
        x, y = x / size, y / size
        out[0, t], out[1, t] = x, y
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


class Chains:
    """Forward-backward over chains: ``p`` is the marginal of state 1 at each position."""

    def __init__(self, score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray):
        e = np.exp(np.clip(score, -30, 30))
        t, s = np.exp(trans), np.exp(start)
        self.m = np.stack(
            [
                np.where(first, s[0], t[0, 0]),
                np.where(first, s[1], t[0, 1]) * e,
                np.where(first, s[0], t[1, 0]),
                np.where(first, s[1], t[1, 1]) * e,
            ]
        )
        self.first = first
        n = len(score)
        if n == 0:
            self.p = np.zeros(0)
            return
        self.alpha = _scan(self.m)
        # beta[t] = m[t+1] beta[t+1]: the same recursion from the end, with transposed matrices
        back = np.ones((4, n))
        back[:, 1:] = self.m[[0, 2, 1, 3], 1:][:, ::-1]
        back[:, 0] = 1
        self.beta = _scan(back)[:, ::-1]
        both = self.alpha * self.beta
        self.p = both[1] / both.sum(0)

    def pairs(self) -> np.ndarray:
        """Expected number of each pair of neighbouring states."""
        inner = ~self.first[1:]
        a, b, m = self.alpha[:, :-1][:, inner], self.beta[:, 1:][:, inner], self.m[:, 1:][:, inner]
        x = np.stack([a[0] * m[0] * b[0], a[0] * m[1] * b[1], a[1] * m[2] * b[0], a[1] * m[3] * b[1]])
        return (x / x.sum(0)).sum(1).reshape(2, 2)


def count_pairs(y: np.ndarray, first: np.ndarray) -> np.ndarray:
    inner = ~first[1:]
    kind = (2 * y[:-1] + y[1:])[inner].astype(np.int64)
    return np.bincount(kind, minlength=4).reshape(2, 2).astype(float)


def pieces(first: np.ndarray, size: int) -> list[slice]:
    """Cuts of flat arrays into runs of whole chains with about ``size`` positions."""
    begins = np.flatnonzero(first)
    cuts = begins[np.unique(np.searchsorted(begins, np.arange(0, len(first), size)).clip(0, len(begins) - 1))]
    return [slice(int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(first)], strict=True)]


def fit(score_of, gradient_of, weights, y, first, steps=80, rate=0.3, penalty=1e-2, size=1 << 17):
    """Weights, trans and start that make the labels ``y`` likely, by Adam.

    ``score_of(weights, part)`` gives the scores of a slice of positions and
    ``gradient_of(residual, part)`` the sums of its residuals by weight. The penalty is on
    squared weights, for each chain. About ``size`` positions are worked on at a time.
    """
    w, trans, start = weights.copy(), np.zeros((2, 2)), np.zeros(2)
    want = np.concatenate([count_pairs(y, first).ravel(), np.bincount(y[first], minlength=2)])
    chains, parts = max(1, int(first.sum())), pieces(first, size)
    moment, square = np.zeros(len(w) + 6), np.zeros(len(w) + 6)
    for step in range(1, steps + 1):
        grad = np.concatenate([np.zeros(len(w)), want])
        for part in parts:
            c = Chains(score_of(w, part), first[part], trans, start)
            grad[: len(w)] += gradient_of(y[part] - c.p, part)
            grad[len(w) : -2] -= c.pairs().ravel()
            p1, begun = c.p[first[part]].sum(), first[part].sum()
            grad[-2:] -= begun - p1, p1
        grad = grad / chains - penalty * np.concatenate([w, trans.ravel(), start])
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w = w + move[: len(w)]
        trans = trans + move[-6:-2].reshape(2, 2)
        start = start + move[-2:]
    return w, trans, start
