"""The largest eigenpairs of a small symmetric matrix by contour integrals.

Counting negative pivots of a shifted matrix (its inertia) tells how many
eigenvalues lie above any number, without finding one.  Those counts choose
intervals that hold few eigenvalues each.  For an interval, the resolvent is
integrated along a circle around it: quadrature nodes are complex shifts, at
each of which a linear system is solved.  That filters a random block onto
the eigenvectors inside, from which a Rayleigh-Ritz step takes the pairs.
The count of the interval says whether one was missed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Nodes on the upper half of a circle, and most eigenvalues in one circle.
NODES, IN_A_CIRCLE = 12, 24
EPS = np.finfo(float).eps


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared subdiagonal of an orthogonally similar matrix."""
    a = v.copy()
    for i in range(len(a) - 2):
        x = a[i + 1:, i].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = x @ x
        if size == 0:
            continue
        a[i + 1:] -= np.outer(x, x @ a[i + 1:]) * (2 / size)
        a[:, i + 1:] -= np.outer(a[:, i + 1:] @ x, x) * (2 / size)
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def inertia(v: np.ndarray) -> Callable[[float], int]:
    """A function that counts the eigenvalues above a shift."""
    diagonal, squares = tridiagonal(v)
    tiny = EPS * EPS * max(1e-300, np.abs(v).max())

    def above(shift: float) -> int:
        pivot, count = 1.0, 0
        for d, s in zip(diagonal, [0.0, *squares]):
            pivot = d - shift - s / pivot
            pivot = pivot or tiny
            count += pivot > 0
        return count
    return above


def intervals(above: Callable[[float], int], floor: float, top: float,
              wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) that hold the ``wanted`` largest at least.

    ``top`` exceeds all eigenvalues, ``wanted`` of them exceed ``floor``.
    """
    least = 1e-12 * top
    low, high = floor, top
    while above(low) > wanted + max(2, wanted // 2) and high - low > least:
        middle = (low + high) / 2
        if above(middle) >= wanted:
            low = middle
        else:
            high = middle
    high = top
    while above(middle := (low + high) / 2) == 0 and high - low > least:
        high = middle
    found, todo = [], [(low, high)]
    while todo:
        low, high = todo.pop()
        count = above(low) - above(high)
        if count > IN_A_CIRCLE and high - low > least:
            middle = (low + high) / 2
            todo += [(low, middle), (middle, high)]
        elif count:
            found.append((low, high, count))
    return found


def project(v: np.ndarray, block: np.ndarray, low: float,
            high: float) -> np.ndarray:
    """``block`` filtered onto the eigenvectors of the interval."""
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for node, weight in zip(*np.polynomial.legendre.leggauss(NODES)):
        turn = radius * np.exp(0.5j * np.pi * (node + 1))
        shifted = -v.astype(complex)
        shifted[np.diag_indices(len(v))] += centre + turn
        out += 0.5 * weight * (turn * np.linalg.solve(shifted, block)).real
    return out


def inside(v: np.ndarray, low: float, high: float, count: int,
           scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``count`` pairs of an interval.

    A block that turns out too narrow is widened; ``scale`` bounds the
    eigenvalues of the whole matrix.
    """
    size = len(v)
    # a circle of no radius has no inside
    margin = max(EPS * 64 * scale, 1e-3 * (high - low))
    width = min(size, count + max(4, count // 2))
    while True:
        block = np.random.default_rng(7).standard_normal((size, width))
        before = np.inf
        for _ in range(30):
            basis, _ = np.linalg.qr(project(v, block, low - margin,
                                            high + margin))
            small = basis.T @ v @ basis
            values, turned = np.linalg.eigh((small + small.T) / 2)
            block = basis @ turned
            # the nearest to the interval, by the count all inside of it
            away = np.maximum(low - values, values - high)
            chosen = np.sort(np.argsort(away, kind="stable")[:count])
            error = np.abs(v @ block[:, chosen]
                           - block[:, chosen] * values[chosen]).max()
            if error <= 8 * EPS * scale or (
                    error <= 1e-11 * scale and error > before / 2):
                break
            before = error
        if (error <= 1e-11 * scale
                and (away[chosen] <= 1e-10 * scale).all()):
            return values[chosen], block[:, chosen]
        if width == size:
            raise ArithmeticError(
                f"{count} eigenvalues counted from {low} to {high}, "
                f"not all found")
        width = min(size, width * 2)


def largest(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a positive semidefinite matrix,
    falling, and their unit eigenvectors as rows.

    Eigenvalues that rounding cannot tell from zero are left out, so that
    there may be fewer.  The largest entry of a vector by size is positive.
    """
    scale = float(np.abs(v).sum(axis=1).max()) if len(v) else 0.0
    if not scale > 0:
        return np.empty(0), np.empty((0, len(v)))
    above, floor, top = inertia(v), scale * len(v) * EPS * 4, scale * 1.01
    wanted = min(wanted, above(floor))
    if not wanted:
        return np.empty(0), np.empty((0, len(v)))
    pairs = [inside(v, low, high, count, scale) for low, high, count
             in intervals(above, floor, top, wanted)]
    values = np.concatenate([p[0] for p in pairs])
    vectors = np.concatenate([p[1].T for p in pairs])
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order], vectors[order]
    signs = np.sign(np.take_along_axis(
        vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1))
    return values, vectors * signs
