"""Dense numeric kernels in numpy."""

from __future__ import annotations

import numpy as np


def distances(a: np.ndarray, b: np.ndarray, bits: bool = False) -> np.ndarray:
    """Squared Euclidean distances, exact for integers; or Hamming distances of bytes."""
    if bits:
        a, b = (np.unpackbits(x.astype(np.uint8), axis=1).astype(np.float64) for x in (a, b))
    elif np.issubdtype(a.dtype, np.integer) and np.issubdtype(b.dtype, np.integer):
        a, b = a.astype(np.int64), b.astype(np.int64)
        low = max(abs(int(a.min(initial=0))), abs(int(a.max(initial=0))), abs(int(b.min(initial=0))), abs(int(b.max(initial=0))))
        if low < 1 << 20:  # products and sums stay exact in float64
            a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def match(query: np.ndarray, train: np.ndarray, ratio: float, ceiling: float, cross_check: bool, bits: bool = False, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and distances of accepted nearest neighbours; the first of equal ones."""
    n, m = len(query), len(train)
    none = np.zeros(0, dtype=np.int64)
    if not n or not m:
        return none, none, none.astype(np.float64)
    best = np.zeros(n, dtype=np.int64)
    near = np.zeros(n)
    second = np.full(n, np.inf)
    back = np.full(m, -1)
    back_near = np.full(m, np.inf)
    for i in range(0, n, block):
        d = distances(query[i : i + block], train, bits).astype(np.float64)
        k = d.argmin(axis=1)
        rows = np.arange(len(d))
        column = d.argmin(axis=0)
        low = d[column, np.arange(m)]
        better = low < back_near
        back[better], back_near[better] = column[better] + i, low[better]
        best[i : i + block], near[i : i + block] = k, d[rows, k]
        if m > 1:
            d[rows, k] = np.inf
            second[i : i + block] = d.min(axis=1)
    ok = (near <= ceiling) & ((near < ratio * second) | (m == 1))
    if cross_check:
        ok &= back[best] == np.arange(n)
    at = np.flatnonzero(ok)
    return at, best[at], near[at]


def near_lines(lines: np.ndarray, points: np.ndarray, reach: float, step: int = 32) -> np.ndarray:
    """Which points (x, y) are nearer than reach to which lines (a, b, c); a line without
    direction, or what is NaN, is near nothing."""
    x, y = np.ascontiguousarray(points[:, 0]), np.ascontiguousarray(points[:, 1])
    out = np.zeros((len(lines), len(points)), dtype=bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for k in range(0, len(lines), step):  # few lines at once, which stay in the cache
            a, b, c = (lines[k : k + step, i, None] for i in range(3))
            norm = np.sqrt(a * a + b * b)
            off = a * x
            off += b * y
            off += c
            np.abs(off, out=off)
            off /= norm
            np.less(off, reach, out=out[k : k + step])
            out[k : k + step] &= norm > 1e-12
    return out


def present_distances(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers; components that are NaN on a side count
    nothing. Exact below 2 ** 53."""
    there, other = ~np.isnan(q), ~np.isnan(t)
    whole = there.all() and other.all()
    q, t = np.where(there, q, 0), np.where(other, t, 0)
    most = max(np.abs(q).max(initial=0), np.abs(t).max(initial=0))
    kind = np.float32 if 4 * q.shape[1] * most * most < 1 << 24 else np.float64
    q, t = q.astype(kind), t.astype(kind)
    own, theirs = ((q * q).sum(1)[:, None], (t * t).sum(1)) if whole else ((q * q) @ other.T.astype(kind), there.astype(kind) @ (t * t).T)
    return own + theirs - 2 * (q @ t.T)


def least_by_row(d: np.ndarray, near: np.ndarray, limit: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the entries of d that are near and within the limit the least of each row, the
    earlier of equal ones first: rows one after another, as columns, entries, and for each
    row the number of all that are near and within the limit."""
    n = d.shape[1]
    at = np.flatnonzero(near)
    value = d.ravel()[at]
    if not (within := value <= limit).all():
        at, value = at[within], value[within]
    row = at // n
    many = np.bincount(row, minlength=len(d))
    if len(at) * 8 > d.size and keep < n and (value.max(initial=0) + 2) * n < 1 << 53:  # most are no candidates for the least
        dense = np.full(d.size, value.max(initial=0) + 1, dtype=np.float64)
        dense[at] = value
        dense = dense.reshape(d.shape) * n + np.arange(n)  # entry and column make one number
        some = dense.ravel()[at] <= np.partition(dense, keep - 1, axis=1)[row, keep - 1]
        at, value, row = at[some], value[some], row[some]
    order = np.lexsort((value, row))
    left = np.bincount(row, minlength=len(d))
    rank = np.arange(len(at)) - np.repeat(np.cumsum(left) - left, left)
    order = order[rank < keep]
    return at[order] % n, value[order].astype(np.float64), many
