"""Distances of all pairs of two blocks of vectors as matrices: the arithmetic of :mod:`vectors`, dimension by dimension, so sums
are in element order. Vectors must be without nulls and of one dimension."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Queries and documents of a tile: a few matrices of this size stay in a core's cache.
TILE_Q, TILE_X = 64, 1024
#: Metrics that a matrix product comes so near to that only pairs which may count are summed in element order.
PRODUCTS = ("l2", "inner_product")


def _sum(term: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """Sum over dimensions of ``term(x, y, room)``; x is a column of queries, y a row of documents."""

    def run(q: np.ndarray, x: np.ndarray, arg: float | None = None) -> np.ndarray:
        total, room = np.zeros((q.shape[1], x.shape[1])), np.empty((q.shape[1], x.shape[1]))
        for a, b in zip(q, x):
            total += term(a[:, None], b[None], room)
        return total

    return run


def _difference(a, b, room):
    return np.abs(np.subtract(a, b, out=room), out=room)


def _square(a, b, room):
    np.subtract(a, b, out=room)
    return np.multiply(room, room, out=room)


def _ratio(top: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.divide(top, below, out=np.full_like(top, np.nan), where=below != 0)


#: Metric -> function of (dimension x queries, dimension x documents, argument).
BLOCKS: dict[str, Callable] = {"l2": _sum(_square)}


def scores(metric: str, q: np.ndarray, x: np.ndarray, arg: float | None = None):
    """Tiles (first query, first document, scores) of all pairs of the rows of ``q`` and ``x``."""
    q, x = np.ascontiguousarray(q.T, np.float64), np.ascontiguousarray(x.T, np.float64)
    with np.errstate(all="ignore"):
        for b in range(0, x.shape[1], TILE_X):
            own = np.ascontiguousarray(x[:, b : b + TILE_X])
            for a in range(0, q.shape[1], TILE_Q):
                yield a, b, BLOCKS[metric](np.ascontiguousarray(q[:, a : a + TILE_Q]), own, arg)


def norms(x: np.ndarray) -> np.ndarray:
    """Squared norms of the rows of ``x``, in element order."""
    total = np.zeros(len(x))
    for column in np.ascontiguousarray(x.T):
        total += column * column
    return total


def _inner_product(a, b, room):
    return np.multiply(a, b, out=room)


BLOCKS["inner_product"] = _sum(_inner_product)


def _bray_curtis(q, x, arg=None):
    return _ratio(_sum(_difference)(q, x), _sum(lambda a, b, room: np.abs(np.add(a, b, out=room), out=room))(q, x))


BLOCKS["bray_curtis"] = _bray_curtis


def _jaccard(q, x, arg=None):
    """As Spark's least and greatest: NaN is above all numbers."""
    return _ratio(_sum(lambda a, b, room: np.fmin(a, b, out=room))(q, x), _sum(lambda a, b, room: np.maximum(a, b, out=room))(q, x))


BLOCKS["jaccard"] = _jaccard


def _jensen_shannon(q, x, arg=None):
    """Only components of at least 0 (see ``allowed``); a logarithm a side where both are positive."""
    total = np.zeros((q.shape[1], x.shape[1]))
    mean, room = np.empty_like(total), np.empty_like(total)
    for a, b in zip(q, x):
        np.add(a[:, None], b[None], out=mean)
        mean /= 2
        part = None
        for side in (a[:, None], b[None]):
            np.divide(mean, side, out=room)
            np.log(room, out=room)
            room *= -side
            if not (side > 0).all():
                np.copyto(room, 0.0, where=side == 0)
            part = room.copy() if part is None else np.add(part, room, out=part)
        total += part
    return total * 0.5


BLOCKS["jensen_shannon"] = _jensen_shannon


def _lp(q, x, arg=None):
    p = 2.0 if arg is None else float(arg)

    def term(a, b, room):
        own = _difference(a, b, room)
        if p not in (1, 2, 3, 4):
            return np.power(own, p, out=room)
        first = own.copy() if p > 2 else own
        for _ in range(int(p) - 1):
            own = np.multiply(own, first, out=room)
        return own

    return _sum(term)(q, x)


BLOCKS["lp"] = _lp


def _nan_euclidean(q, x, arg=None):
    total = BLOCKS["l2"](q, x)
    if not np.isnan(total).any():
        return total
    total, count, room = np.zeros_like(total), np.zeros_like(total), np.empty_like(total)
    for a, b in zip(q, x):
        own = _square(a[:, None], b[None], room)
        there = ~np.isnan(own)
        total += np.where(there, own, 0.0)
        count += there
    return _ratio(len(q) / np.where(count == 0, np.nan, count) * total, (count > 0).astype(float))


BLOCKS["nan_euclidean"] = _nan_euclidean


def _gower(q, x, arg=None):
    if (q >= 0).all() and (x >= 0).all():
        total, room = np.zeros((q.shape[1], x.shape[1])), np.empty((q.shape[1], x.shape[1]))
        far = np.zeros(total.shape, bool)
        for a, b in zip(q, x):
            own = _difference(a[:, None], b[None], room)
            if not (abs(a.max() - b.min()) <= 1 and abs(b.max() - a.min()) <= 1):
                far |= ~(own <= 1)
            total += own
        total[far] = np.nan
        return total / len(q)
    total, count = np.zeros((q.shape[1], x.shape[1])), np.zeros((q.shape[1], x.shape[1]))
    for a, b in zip(q, x):
        a, b = a[:, None], b[None]
        own = np.abs(a - b)
        term = np.where((a >= 0) & (b >= 0), np.where(own <= 1, own, np.nan), np.where((a < 0) & (b < 0), (a != b) * 1.0, np.nan))
        there = ~np.isnan(a) & ~np.isnan(b)
        total += np.where(there, term, 0.0)
        count += there
    return _ratio(total, count)


BLOCKS["gower"] = _gower


def best(score: np.ndarray, k: int, similar: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of scores that are not NaN and not worse than their row's ``k``-th best: ties are all there."""
    own = np.where(np.isnan(score), np.inf, -score if similar else score)
    if k < own.shape[1]:
        keep = own <= np.partition(own, k - 1, axis=1)[:, k - 1 : k]
    else:
        keep = np.ones(own.shape, bool)
    return np.nonzero(keep & ~np.isnan(score))


def of_pairs(metric: str, q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of columns ``i`` of ``q`` with columns ``j`` of ``x``, in element order, for one of PRODUCTS."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 15):
        a, b, total = i[at : at + (1 << 15)], j[at : at + (1 << 15)], out[at : at + (1 << 15)]
        for u, v in zip(q, x):
            own = u.take(a)
            if metric == "l2":
                own -= v.take(b)
                own *= own
            else:
                own *= v.take(b)
            total += own
    return out


def _near(metric: str, q: np.ndarray, x: np.ndarray):
    """Tiles (first query, scores by a matrix product, how far a query's are at most from sums in element order). Norms must not
    overflow. For L2 the norms are two dimensions more: -2 q, |q|^2, 1 times x, 1, |x|^2."""
    qq, xx = norms(q), norms(x)
    far = np.sqrt(xx.max())
    slack = 4 * (q.shape[1] + 4) * np.finfo(float).eps * ((np.sqrt(qq) + far) ** 2 if metric == "l2" else np.sqrt(qq) * far) + 1e-300
    if metric == "l2":
        q, x = np.column_stack([-2 * q, qq, np.ones(len(q))]), np.column_stack([x, np.ones(len(x)), xx])
    for a in range(0, len(q), TILE_Q):
        own = slice(a, a + TILE_Q)
        yield a, q[own] @ x.T, slack[own]


def _places(taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true: numpy is several times faster at it in one dimension."""
    return np.divmod(np.flatnonzero(taken), taken.shape[1])


def candidates(metric: str, q: np.ndarray, x: np.ndarray, pick: Callable, arg: float | None = None):
    """(rows of ``q``, rows of ``x``, scores) of the pairs that ``pick`` takes, which may be more than count.

    ``pick`` is asked of matrices: (scores, how far a row's may be from sums in element order, its rows, its columns).
    The scores handed on are sums in element order.
    """

    def summed(rows: np.ndarray, columns: np.ndarray):
        for a, b, score in scores(metric, q[rows], x[columns], arg):
            own = rows[a : a + len(score)]
            i, j = _places(pick(score, np.zeros(len(own)), own, columns[b : b + score.shape[1]]))
            yield own[i], columns[b + j], score[i, j]

    rows, columns = np.arange(len(q)), np.arange(len(x))
    if metric not in PRODUCTS:
        yield from summed(rows, columns)
        return
    with np.errstate(all="ignore"):  # norms that overflow or are no numbers
        fit_q, fit_x = ((norms(v) < 1e150) for v in (q, x))
        if not fit_q.all():
            yield from summed(rows[~fit_q], columns)
        if not fit_x.all():
            yield from summed(rows[fit_q], columns[~fit_x])
    rows, columns = rows[fit_q], columns[fit_x]
    if not len(rows) or not len(columns):
        return
    near_q, near_x = (q, x) if len(rows) == len(q) and len(columns) == len(x) else (q[rows], x[columns])
    turned_q, turned_x = np.ascontiguousarray(near_q.T), np.ascontiguousarray(near_x.T)
    for a, score, slack in _near(metric, near_q, near_x):
        own = rows[a : a + len(score)]
        i, j = _places(pick(score, slack, own, columns))
        if len(i) * 8 > score.size:  # most pairs: as matrices
            yield from summed(own, columns)
        elif len(i):
            yield own[i], columns[j], of_pairs(metric, turned_q, turned_x, a + i, j)


def _bound(score: np.ndarray, k: int, similar: bool) -> np.ndarray:
    """A column of scores that at least ``k`` of their row are not worse than: the ``k``-th best of the bests of groups, which are
    many more than ``k``. Infinite where fewer groups hold a number."""
    size = max(1, min(32, score.shape[1] // (16 * k)))
    n = score.shape[1] // size
    if size > 1:
        score = (np.fmax if similar else np.fmin).reduce(score[:, : n * size].reshape(len(score), size, n), axis=1)
    loss = np.where(np.isnan(score), np.inf, -score if similar else score)
    cut = np.partition(loss, k - 1, axis=1)[:, k - 1 : k]
    return -cut if similar else cut


def among_best(k: int, similar: bool) -> Callable:
    """A ``pick`` for :func:`candidates`: all that may be among their row's ``k`` best; NaN never is."""

    def pick(score, slack, rows=None, columns=None):
        if k >= score.shape[1]:
            return ~np.isnan(score)
        cut, slack = _bound(score, k, similar), 2 * slack[:, None]
        return score >= cut - slack if similar else score <= cut + slack

    return pick
