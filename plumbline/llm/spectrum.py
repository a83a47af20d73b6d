"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The number of negative pivots of an LDLᵀ factorisation of A - s is the number of
eigenvalues below s. Such counts halve slices of the spectrum until each holds one
eigenvalue; Rayleigh quotient iteration then converges to it, cubically, and has to
end inside its slice, so the counts certify every number. Eigenvalues closer than
TIE times the norm share a slice: with all that no gap sets apart from them they have
a common space, found by subspace iteration with a filter, in which they are told apart.
"""

from __future__ import annotations

import numpy as np

#: Width of a slice, as a part of the norm, from which on its eigenvalues count as one cluster.
TIE = 1e-9
_STEPS = 40


def negatives(a: np.ndarray) -> int:
    """Negative eigenvalues of the symmetric matrix ``a``: signs of the pivots of LDLᵀ with symmetric pivoting (1 x 1 and 2 x 2)."""
    a = np.array(a, np.float64)
    n, k, found = len(a), 0, 0
    alpha = (1 + 17**0.5) / 8
    while k < n:
        own = abs(a[k, k])
        below = np.abs(a[k + 1 :, k])
        r = k + 1 + int(below.argmax()) if len(below) else k
        most = below[r - k - 1] if len(below) else 0.0
        size = 1
        if own < alpha * most:
            other = max(np.abs(a[r, k:r]).max(), np.abs(a[r + 1 :, r]).max(initial=0.0))
            if own * other < alpha * most**2:
                size = 1 if abs(a[r, r]) >= alpha * other else 2
                at = k + size - 1
                a[[at, r]] = a[[r, at]]
                a[:, [at, r]] = a[:, [r, at]]
        rest = a[k + size :, k : k + size]
        if size == 1:
            found += bool(a[k, k] < 0)
            if a[k, k] != 0:
                a[k + 1 :, k + 1 :] -= rest @ (rest.T / a[k, k])
        else:
            found += 1  # this pivoting takes a 2 x 2 block only where its determinant is negative
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(a[k : k + 2, k : k + 2], rest.T)
        k += size
    return found


def _solve(a: np.ndarray, shift: float, x: np.ndarray, norm: float) -> np.ndarray:
    """A unit vector along (A - shift)⁻¹ x; a shift that hits an eigenvalue is moved by a rounding error."""
    eye = np.eye(len(a))
    for nudge in (0.0, 1.0, -3.0, 9.0):
        try:
            y = np.linalg.solve(a - (shift + nudge * np.finfo(float).eps * norm) * eye, x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and y.any():
            return y / np.linalg.norm(y)
    raise ArithmeticError("no shift next to the eigenvalue can be solved")


class _Slices:
    """The spectrum of ``a`` by counts; slices are (lo, hi, first, last): eigenvalues number first to last, falling, lie in [lo, hi)."""

    def __init__(self, a: np.ndarray):
        self.a, self.n = a, len(a)
        self.norm = float(np.abs(a).sum(axis=1).max())

    def above(self, s: float) -> int:
        return self.n - negatives(self.a - s * np.eye(self.n))

    def halves(self, lo, hi, first, last):
        """The slice cut in two, larger values first; empty halves are left out."""
        mid, near = (lo + hi) / 2, TIE * self.norm / 3
        if mid == 0 and self.above(near) != self.above(-near):
            mid = -near  # a matrix of low rank has eigenvalues where the cut would be
        cut = min(max(self.above(mid), first - 1), last)
        return [s for s in ((mid, hi, first, cut), (lo, mid, cut + 1, last)) if s[2] <= s[3]]

    def isolated(self, k: int) -> list[tuple]:
        """Slices of the ``k`` largest eigenvalues, in falling order, each with one eigenvalue or a cluster."""
        edge = self.norm * (1 + 1e-12) or 1.0
        todo, out = [(-edge, edge, 1, self.n)], []
        while todo:
            piece = todo.pop()
            if piece[2] > k:
                continue
            if piece[2] == piece[3] or piece[1] - piece[0] <= TIE * self.norm:
                out.append(piece)
            else:
                todo.extend(reversed(self.halves(*piece)))
        return out


def _quotient_iteration(slices: _Slices, piece: tuple, x: np.ndarray) -> tuple[float, np.ndarray]:
    """The eigenpair of a slice with one eigenvalue."""
    a, norm = slices.a, slices.norm
    lo, hi, k, _ = piece
    tiny = 8 * np.finfo(float).eps * norm
    while True:
        shift, y, best = (lo + hi) / 2, x, np.inf
        for _ in range(_STEPS):
            y = _solve(a, shift, y, norm)
            value = float(y @ a @ y)
            off = float(np.linalg.norm(a @ y - value * y))
            if not lo - tiny <= value <= hi + tiny or off <= tiny and off >= best / 2:
                break
            if off < (hi - lo) / 2:
                shift = value  # near enough for the quotient to lead
            best = min(best, off)
        if lo - tiny <= value <= hi + tiny and off <= 64 * tiny:
            return value, y
        if hi - lo <= tiny:
            raise ArithmeticError(f"eigenvalue {k} does not converge")
        lo, hi, _, _ = slices.halves(lo, hi, k, k)[0]


def _cluster(slices: _Slices, piece: tuple, rng) -> tuple[int, np.ndarray, np.ndarray]:
    """First number, values (falling) and vectors of a slice that counts cut no further, and of all that no gap of its half width sets apart from it.

    The filter r / ((A - m)² + r²) weighs what lies within r of the middle m at least 2.5 times as much as what lies beyond
    2 r, and nothing lies between; it is the imaginary part of (A - m - ir)⁻¹, whose weights are alike all over the cluster.
    """
    a, n, norm = slices.a, slices.n, slices.norm
    lo, hi, first, last = piece
    while True:
        half = (hi - lo) / 2
        wide = lo - half, hi + half, min(first, slices.above(hi + half) + 1), max(last, slices.above(lo - half))
        if wide[2:] == (first, last):
            break
        lo, hi, first, last = wide
    middle, tiny, best = (lo + hi) / 2, 8 * np.finfo(float).eps * norm, np.inf
    centred = a - middle * np.eye(n)
    filtered = centred - 1j * half * np.eye(n)
    basis = np.linalg.qr(rng.standard_normal((n, last - first + 1)))[0]
    for _ in range(2 * _STEPS):
        basis = np.linalg.qr(np.linalg.solve(filtered, basis).imag)[0]
        small = basis.T @ (centred @ basis)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        basis = basis @ turn
        off = float(np.linalg.norm(centred @ basis - basis * values, axis=0).max())
        if off <= 64 * tiny and off >= best / 2:
            break
        best = min(best, off)
    if off > 64 * tiny:
        raise ArithmeticError(f"eigenvalues {first} to {last} do not converge")
    return first, values[::-1] + middle, basis[:, ::-1]


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues that are above rounding errors, falling, and their unit vectors as columns.

    ``a`` is symmetric without negative eigenvalues. Each count and each solution takes
    n³ steps for n rows; about 20 of either belong to an eigenvalue. A ValueError
    says that ``a`` holds numbers that are not finite.
    """
    a = np.asarray(a, np.float64)
    if not np.isfinite(a).all():
        raise ValueError("the matrix has entries that are not finite")
    slices, rng = _Slices(a), np.random.default_rng(5)
    values, vectors = [], []
    for piece in slices.isolated(min(k, len(a))) if len(a) and slices.norm else []:
        if piece[3] <= len(values):
            continue  # the cluster before holds it too
        if piece[2] == piece[3]:
            value, y = _quotient_iteration(slices, piece, rng.standard_normal(len(a)))
            values.append(value)
            vectors.append(y)
        else:
            first, several, columns = _cluster(slices, piece, rng)
            new = len(values) + 1 - first
            values.extend(several[new:].tolist())
            vectors.extend(columns.T[new:])
    least = 16 * len(a) * np.finfo(float).eps * slices.norm if len(a) else 0.0
    count = sum(v > least for v in values[:k])
    q = np.zeros((len(a), count))
    for i, y in enumerate(vectors[:count]):
        for _ in range(2):  # neighbours in the spectrum are parallel by rounding errors over their distance
            y = y - q[:, :i] @ (q[:, :i].T @ y)
        q[:, i] = y / np.linalg.norm(y)
    return np.array(values[:count]), q
