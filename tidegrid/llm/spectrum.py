"""Eigenvalues and eigenvectors of a scatter matrix under rank-one updates, in numpy.

A spectrum is kept as ascending ``values`` and orthonormal columns ``vectors``. Adding
``v v'`` leaves, in the basis of the old vectors, a diagonal plus one outer product.
Entries that such an update doesn't change to working precision are deflated; for the
others the roots of the secular equation are the new values, and from these the outer
product is computed anew (Gu and Eisenstat), so that the new vectors stay orthogonal.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
_ROUNDS = 80


def secular_roots(poles: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(squares / (poles - x))``, one above each of the ascending poles.

    Returns the roots and the matrix ``poles[j] - root[i]``, whose entries are exact to
    working precision also where a root lies next to a pole.
    """
    k = len(poles)
    if k == 1:
        return poles + squares, -squares.reshape(1, 1)
    each = np.arange(k)
    above = np.append(poles[1:], poles[-1] + squares.sum())
    middle = (poles + above) / 2
    at_middle = 1 + (squares / (poles - middle[:, None])).sum(1)
    # each root is held as its distance from the nearer pole; beyond the last pole there is no other
    low_half = at_middle >= 0
    origin = np.where(low_half | (each == k - 1), each, np.minimum(each + 1, k - 1))
    shift = poles[origin]
    low = np.where(low_half, poles - shift, middle - shift)
    high = np.where(low_half, middle - shift, above - shift)
    delta = poles - shift[:, None]
    first = np.minimum(each, k - 2)
    below = (each <= first[:, None]).astype(np.float64)
    x = (low + high) / 2
    todo = each
    for _ in range(_ROUNDS):
        gap = delta[todo] - x[todo, None]
        inverse, lower = 1 / gap, below[todo]
        terms = inverse * squares
        slopes = terms * inverse
        under, whole = np.einsum("ij,ij->i", terms, lower), terms.sum(1)
        value = 1 + whole
        done = np.abs(value) <= EPS * k * (1 + np.abs(under) + np.abs(whole - under))
        low[todo] = np.where(value < 0, x[todo], low[todo])
        high[todo] = np.where(value < 0, high[todo], x[todo])
        left = np.einsum("ij,ij->i", slopes, lower)
        right = slopes.sum(1) - left
        near = np.arange(len(todo))
        d1, d2 = gap[near, first[todo]], gap[near, first[todo] + 1]
        # two poles with the slopes of both sides and a constant: a quadratic for the step
        c = value - d1 * left - d2 * right
        a = (d1 + d2) * value - d1 * d2 * (left + right)
        b = d1 * d2 * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            # the step that stays on the pole's own side: between two poles, or beyond the last
            root = np.where(todo == k - 1, -root, root)
            step = np.where(a * root <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x[todo] + step
        new = np.where((new > low[todo]) & (new < high[todo]), new, (low[todo] + high[todo]) / 2)
        done |= new == x[todo]
        x[todo] = np.where(done, x[todo], new)
        todo = todo[~done]
        if not len(todo):
            break
    return shift + x, delta - x[:, None]


def _rotated(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, kept: np.ndarray, tolerance: float) -> np.ndarray:
    """Of kept entries with all but equal values one takes the whole of ``z``; the positions still kept."""
    d, w = values[kept], z[kept]
    share = w[:-1] * w[1:] / (w[:-1] ** 2 + w[1:] ** 2)
    if not (np.diff(d) * np.abs(share) <= tolerance).any():
        return kept
    out, last = [], kept[0]
    for i in kept[1:]:
        size = np.hypot(z[last], z[i])
        cos, sin = z[i] / size, z[last] / size
        if (values[i] - values[last]) * abs(cos * sin) <= tolerance:
            one, two = vectors[:, last].copy(), vectors[:, i]
            vectors[:, i], vectors[:, last] = cos * two + sin * one, cos * one - sin * two
            spread = values[i] - values[last]
            values[i], values[last] = values[i] - sin * sin * spread, values[last] + sin * sin * spread
            z[i], z[last] = size, 0.0
        else:
            out.append(last)
        last = i
    return np.array([*out, last])


def updated(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum after ``v v'`` was added to the matrix."""
    z = vectors.T @ v
    size = float(np.linalg.norm(z))
    tolerance = 8 * EPS * max(float(values[-1]), size * size)
    kept = np.flatnonzero(np.abs(z) * size > tolerance)
    if not len(kept):
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    kept = _rotated(values, vectors, z, kept, tolerance)
    kept = kept[np.argsort(values[kept], kind="stable")]
    d, w = values[kept], z[kept]
    roots, gap = secular_roots(d, w * w)
    ratio = d[:, None] - d[None, :]
    np.fill_diagonal(ratio, 1.0)
    anew = np.sqrt(np.abs(np.prod(-gap / ratio, axis=0)))
    turn = (np.copysign(anew, w) / gap).T
    turn /= np.linalg.norm(turn, axis=0)
    values[kept] = roots
    vectors[:, kept] = vectors[:, kept] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, mean and spectrum of the scatter of rows; grows by rows and by other spectra."""

    def __init__(self, dimension: int):
        self.n, self.mean = 0, np.zeros(dimension)
        self.values, self.vectors = np.zeros(dimension), np.eye(dimension)

    def add(self, row: np.ndarray) -> None:
        """One row: its distance from the mean of all rows before it is one update."""
        self.n += 1
        off = row - self.mean
        self.mean = self.mean + off / self.n
        if self.n > 1:
            self.values, self.vectors = updated(self.values, self.vectors, off * np.sqrt((self.n - 1) / self.n))

    def add_block(self, rows: np.ndarray) -> None:
        """Rows at once: centred, they are turned into no more rows than columns with the same scatter.

        Each of these is one update, and so is the distance of the means; the result is that of
        adding row by row at a fraction of the updates.
        """
        mean = rows.mean(0)
        centred = rows - mean
        if len(rows) > rows.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        block = Spectrum(rows.shape[1])
        block.n, block.mean = len(rows), mean
        self._shift(block, centred)

    def merge(self, other: Spectrum) -> None:
        """Another spectrum: an update for each of its axes, and one for the distance of the means."""
        if other.n:
            self._shift(other, (np.sqrt(v) * axis for v, axis in zip(other.values, other.vectors.T) if v > 0))

    def _shift(self, other: Spectrum, updates) -> None:
        off, total = other.mean - self.mean, self.n + other.n
        for v in updates:
            self.values, self.vectors = updated(self.values, self.vectors, v)
        if self.n:
            self.values, self.vectors = updated(self.values, self.vectors, off * np.sqrt(self.n * other.n / total))
        self.mean = self.mean + off * (other.n / total)
        self.n = total
