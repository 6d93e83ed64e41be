"""Sums of Euclidean distances between points that lie on parallel lines, all pairs counted, with a bound on the error.

Points that differ in one coordinate only are on a line. Each line is cut into segments, whose halves
make a binary tree. Between two segments that are far apart for their lengths the distance is a smooth
function of both places, so it is worked at Chebyshev nodes: the weights of a segment's points are moved
to its nodes, and sums at the nodes of the other one are read off at its points. A pair of segments is taken
so only if the error is proven to be below ``tolerance`` for each unit of weight (the bound of Chebyshev
interpolation in a Bernstein ellipse, Trefethen 2013, theorem 8.2); if not, both are halved, and pairs
of segments that have no halves are left to be worked point by point.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NODES = 20
_ANGLES = (np.arange(NODES) + 0.5) * np.pi / NODES
_PLACES = np.cos(_ANGLES)
_ORDERS = np.arange(NODES)
_SERIES = np.cos(_ORDERS[:, None] * _ANGLES) * np.where(_ORDERS == 0, 1.0, 2.0)[:, None] / NODES
_CHUNK = 512


def basis(places: np.ndarray) -> np.ndarray:
    """Values of the Lagrange polynomials of the nodes at places in [-1, 1] (a last axis is added)."""
    return np.cos(np.arccos(np.clip(places, -1.0, 1.0))[..., None] * _ORDERS) @ _SERIES


def within(y: np.ndarray, lo, hi) -> np.ndarray:
    """Places of y in [-1, 1] of the segment from lo to hi; 0 if it is a point."""
    half = (np.asarray(hi) - lo) / 2
    return (y - (np.asarray(hi) + lo) / 2) / np.where(half > 0, half, 1.0)


def error_bound(apart, p, half, other) -> np.ndarray:
    """Bound on the error of sqrt(p^2 + (x - y)^2) read off nodes of both segments, their centres ``apart``."""
    def one(mine, theirs):
        near = np.maximum(apart - theirs, 0.0)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            axis = np.maximum((np.hypot(near - mine, p) + np.hypot(near + mine, p)) / (2 * mine), 1.0)
            rho = axis + np.sqrt(axis * axis - 1.0)
            most = p + apart + theirs + mine * axis
            e = 4 * most * np.power(rho, 1.0 - NODES) / (rho - 1.0)
        return np.where(mine > 0, np.where(np.isfinite(rho), np.where(np.isnan(e), np.inf, e), 0.0), 0.0)

    return 4 * np.maximum(one(half, other), one(other, half))  # 1 + the nodes' Lebesgue constant is below 4


@dataclass
class Tree:
    """Segments of all lines, the whole lines first; ``leaf`` is the key of a segment without halves, else -1."""
    rest: np.ndarray  # a row per line: its other coordinates
    line: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    weights: np.ndarray  # segment x node x kind of weight
    child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray


def build(rest: np.ndarray, depth: int, keys: np.ndarray, lo, hi, weights) -> Tree:
    """Tree above the segments ``keys`` = line * 2^depth + number of the segment on its line, sorted."""
    levels = [(keys, lo, hi, weights, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64))]
    for _ in range(depth):
        keys, lo, hi, weights = levels[-1][:4]
        above, first, of, many = np.unique(keys >> 1, return_index=True, return_inverse=True, return_counts=True)
        up_lo, up_hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
        up = np.zeros((len(above), *weights.shape[1:]))
        for f in range(0, len(keys), 4096):
            s, o = slice(f, f + 4096), of[f:f + 4096]
            mid, half = (hi[s] + lo[s]) / 2, (hi[s] - lo[s]) / 2
            nodes = mid[:, None] + half[:, None] * _PLACES
            moved = basis(within(nodes, up_lo[o][:, None], up_hi[o][:, None]))
            np.add.at(up, o, np.matmul(moved.transpose(0, 2, 1), weights[s]))
        levels.append((above, up_lo, up_hi, up, first, many))
    levels.reverse()
    starts = np.cumsum([0, *[len(v[0]) for v in levels]])
    cat = lambda i: np.concatenate([v[i] for v in levels])
    line = np.concatenate([v[0] >> d for d, v in enumerate(levels)])
    child = np.concatenate([v[4] + after for v, after in zip(levels, starts[1:])])
    leaf = np.concatenate([*[np.full(len(v[0]), -1, np.int64) for v in levels[:-1]], levels[-1][0]])
    return Tree(rest, line, cat(1), cat(2), cat(3), child, cat(5), leaf)


def _halved(tree: Tree, t: np.ndarray, s: np.ndarray):
    """All pairs of the halves of each pair; a segment without halves stays."""
    ct, cs = np.maximum(tree.children[t], 1), np.maximum(tree.children[s], 1)
    many = ct * cs
    of = np.repeat(np.arange(len(t)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    part = lambda v, i: np.where(tree.children[v] > 0, tree.child[v] + i, v)
    return part(t[of], k // cs[of]), part(s[of], k % cs[of])


def sums_at_line(tree: Tree, a: int, tolerance: float):
    """For line ``a``: its leaves' places in the tree, the sums at their nodes, and for each leaf the leaves left to do."""
    mine = np.flatnonzero(tree.line == a)
    p = np.sqrt(((tree.rest - tree.rest[a]) ** 2).sum(axis=1))
    mid, half = (tree.hi + tree.lo) / 2, (tree.hi - tree.lo) / 2
    sums = np.zeros((len(mine), *tree.weights.shape[1:]))
    s = np.arange(len(tree.rest))
    t = np.full(len(s), mine[0])
    left = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    while len(t):
        between = p[tree.line[s]]
        far = error_bound(np.abs(mid[t] - mid[s]), between, half[t], half[s]) <= tolerance
        # on one line the distance to another segment is linear, which nodes give as it is
        far |= (tree.line[s] == a) & ((tree.lo[t] > tree.hi[s]) | (tree.hi[t] < tree.lo[s]))
        ft, fs, fp = t[far], s[far], between[far]
        for f in range(0, len(ft), _CHUNK):
            i, j = ft[f:f + _CHUNK], fs[f:f + _CHUNK]
            x, y = (mid[v][:, None] + half[v][:, None] * _PLACES for v in (i, j))
            d = x[:, :, None] - y[:, None, :]
            d *= d
            d += (fp[f:f + _CHUNK] ** 2)[:, None, None]
            np.add.at(sums, np.searchsorted(mine, i), np.matmul(np.sqrt(d, out=d), tree.weights[j]))
        t, s = t[~far], s[~far]
        ends = (tree.children[t] == 0) & (tree.children[s] == 0)
        left.append((t[ends], s[ends]))
        t, s = _halved(tree, t[~ends], s[~ends])
    for k, v in enumerate(mine):  # sums of a segment hold for its halves, too
        for c in range(tree.child[v], tree.child[v] + tree.children[v]):
            nodes = mid[c] + half[c] * _PLACES
            sums[np.searchsorted(mine, c)] += basis(within(nodes, tree.lo[v], tree.hi[v])) @ sums[k]
    leaves = mine[tree.leaf[mine] >= 0]
    near_t, near_s = (np.concatenate(v) for v in zip(*left))
    order = np.argsort(near_t, kind="stable")
    near = np.split(tree.leaf[near_s[order]], np.searchsorted(near_t[order], leaves[1:]))
    return leaves, sums[np.searchsorted(mine, leaves)], near


def sums_on_segment(y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of |y_i - y_j| times the weights of j, y in ascending order."""
    y = y - (y[0] + y[-1]) / 2
    below, moment = np.cumsum(weights, axis=0), np.cumsum(weights * y[:, None], axis=0)
    return y[:, None] * (2 * below - below[-1]) - (2 * moment - moment[-1])
