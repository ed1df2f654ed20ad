"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The signs of the pivots of ``A - s I = L D Lᵀ`` count the eigenvalues above ``s`` (Sylvester's
law of inertia). Bisection on such counts brackets each leading eigenvalue alone, Rayleigh
quotient iteration then converges cubically inside the bracket, and two more counts certify
that the result is the eigenvalue of its number and no neighbour.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Fixed value: bound of element growth in the choice between 1x1 and 2x2 pivots.
PIVOT = (1 + 17 ** 0.5) / 8
EPS = float(np.finfo(float).eps)


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """Numbers of positive, zero and negative eigenvalues, from a pivoted LDLᵀ factorisation."""
    a = np.array(matrix, float)
    size, signs, k = len(a), [0, 0, 0], 0

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < size:
        below = np.abs(a[k + 1:, k])
        largest = below.max() if len(below) else 0.0
        step = 1
        if largest > 0 and abs(a[k, k]) < PIVOT * largest:
            r = k + 1 + int(below.argmax())
            others = np.abs(a[r, k:])
            others[r - k] = 0
            if abs(a[k, k]) * others.max() < PIVOT * largest ** 2:
                if abs(a[r, r]) >= PIVOT * others.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    step = 2
        rest = a[k + step:, k:k + step]
        if step == 1:
            pivot = a[k, k]
            signs[0 if pivot > 0 else 1 if pivot == 0 else 2] += 1
            if pivot:
                a[k + 1:, k + 1:] -= np.outer(rest[:, 0], rest[:, 0] / pivot)
        else:  # such a block has one eigenvalue of each sign
            signs[0] += 1
            signs[2] += 1
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(a[k:k + 2, k:k + 2], rest.T)
        k += step
    return signs[0], signs[1], signs[2]


def _solve(a: np.ndarray, shift: float, x: np.ndarray, nudge: float) -> np.ndarray:
    while True:
        try:
            y = np.linalg.solve(a - shift * np.eye(len(a)), x)
            if np.isfinite(y).all():
                return y / np.linalg.norm(y)
        except np.linalg.LinAlgError:
            pass
        shift += nudge
        nudge *= 2


def _converge(a: np.ndarray, shift: float, found: np.ndarray, start: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Two steps of inverse iteration, then Rayleigh quotients; always orthogonal to ``found``."""
    def clean(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - found @ (found.T @ x)
        return x / np.linalg.norm(x)

    x = clean(start)
    for _ in range(2):
        x = clean(_solve(a, shift, x, EPS * scale))
    best = (np.inf, 0.0, x)
    for _ in range(40):
        rho = float(x @ a @ x)
        off = float(np.linalg.norm(a @ x - rho * x))
        if off < best[0]:
            best = (off, rho, x)
        elif best[0] < len(a) * EPS * scale:
            break
        x = clean(_solve(a, rho, x, EPS * scale))
    return best[1], best[2]


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as columns.

    For positive semidefinite matrices; fewer come back where the rank is lower: eigenvalues
    that rounding cannot tell from zero have no component. Equal eigenvalues get any
    orthonormal basis of their space.
    """
    size = len(a)
    scale = float(np.abs(a).sum(axis=1).max()) if size else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((size, 0))
    counts: dict[float, int] = {scale * (1 + 1e-9): 0}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(a - shift * np.eye(size))[0]
        return counts[shift]

    floor = 8 * size * EPS * scale
    k = min(k, above(floor))
    width = 16 * size * EPS * scale
    rng = np.random.default_rng(0)
    values, vectors = np.zeros(k), np.zeros((size, k))
    for i in range(k):
        low, high = bracket(counts, i)
        alone = False
        while not alone:
            while high - low > width and above(low) - above(high) > 1:
                low, high = halve(above, low, high, i)
            rho, x = _converge(a, (low + high) / 2, vectors[:, :i], rng.standard_normal(size), scale)
            alone = high - low <= width or (low < rho <= high)
            if not alone:  # drawn to a neighbour: start from a tighter bracket
                for _ in range(4):
                    low, high = halve(above, low, high, i)
        # Certificate: at most i eigenvalues lie above, at least i + 1 at or above.
        if not (above(rho + width) <= i < above(rho - width)):
            raise ArithmeticError(f"eigenvalue {i + 1} could not be certified")
        values[i], vectors[:, i] = rho, x
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def bracket(counts: dict[float, int], i: int) -> tuple[float, float]:
    """The tightest known shifts around eigenvalue number i (from 0): (low, high)."""
    return max(s for s, c in counts.items() if c > i), min(s for s, c in counts.items() if c <= i)


def halve(above: Callable[[float], int], low: float, high: float, i: int) -> tuple[float, float]:
    middle = (low + high) / 2
    return (middle, high) if above(middle) > i else (low, middle)
