"""Simplex-constrained weights (Arkhangelsky et al. 2021), matrix-free.

The solvers see the paths of the candidates and of the target and never a matrix of
products between candidates.  They say whether they converged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Fit:
    weights: np.ndarray
    converged: bool
    iterations: int


#: gradients closer than this share of their spread count as equal: the first vertex goes first
TIE = 1e-9


def first_least(g: np.ndarray) -> int:
    """The first of the least entries."""
    low = g.min()
    return int(np.flatnonzero(g <= low + TIE * (abs(low) + np.abs(g).max()))[0])


def fw_step(slope: float, curve: float) -> tuple[float, float]:
    """Exact line search: step towards a vertex and the decrease of the objective, from half the
    slope against it (current value minus the vertex's) and the curvature along it."""
    if curve <= 0:
        return 0.0, 0.0
    step = min(1.0, max(0.0, slope / curve))
    return step, 2 * step * slope - step * step * curve


def fw_paths(A: np.ndarray, b: np.ndarray, n: float, ridge: float, max_iter: int = 10_000, min_decrease: float = 1e-8,
             num_iter_no_change: int = 1, good_gap: float = 0.0) -> Fit:
    """Frank-Wolfe for ``min |A'w - b|^2 / n + ridge |w|^2`` over the simplex; a row of ``A`` for
    each weight.  Matrix-free: it keeps ``A'w`` and never forms ``A A'`` or ``A'A``.

    Stops when the objective decreases by less than ``min_decrease**2`` in
    ``num_iter_no_change`` consecutive steps.  After ``max_iter`` steps it has converged if half
    the duality gap, which bounds half the distance to the optimum, is at most ``good_gap``.
    """
    K = len(A)
    if K == 1:
        return Fit(np.ones(1), True, 0)
    w = np.full(K, 1.0 / K)
    x = w @ A
    calm = 0
    for it in range(1, max_iter + 1):
        g = A @ (x - b) / n + ridge * w
        i = first_least(g)
        d = -w
        d[i] += 1.0
        step, fell = fw_step(-(g @ d), ((A[i] - x) @ (A[i] - x)) / n + ridge * (d @ d))
        w = w + step * d
        x = x + step * (A[i] - x)
        calm = calm + 1 if fell < min_decrease ** 2 else 0
        if calm >= num_iter_no_change:
            return Fit(w, True, it)
    g = A @ (x - b) / n + ridge * w
    return Fit(w, bool(g @ w - g.min() <= good_gap), max_iter)


def project_simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection onto the probability simplex (sort-based)."""
    u = np.sort(v)[::-1]
    css = np.cumsum(u) - 1.0
    k = np.arange(1, len(v) + 1)
    rho = np.nonzero(u - css / k > 0)[0][-1]
    return np.maximum(v - css[rho] / (rho + 1), 0.0)


#: a duality gap below this share of the candidates' mean square distance to the target is no gap
NO_GAP = 1e-12


def pg_paths(A: np.ndarray, b: np.ndarray, n: float, max_iter: int = 20_000, tol: float = 1e-14) -> Fit:
    """Accelerated projected gradient for ``min |A'w - b|^2 / n`` over the simplex, matrix-free; reaches
    optima on a face of the simplex, where synthetic controls usually sit.

    Weights sum to one, so ``A'w - b`` is ``(A - b)'w``: the steps see the distances to the target
    only, not the level that all paths share (it would make them as slow as the level is high).
    The momentum restarts when it points uphill.  After ``max_iter`` steps, weights whose duality
    gap is nil have converged.
    """
    K = len(A)
    if K == 1:
        return Fit(np.ones(1), True, 0)
    D = A - b
    L = 2 * np.linalg.norm(D, 2) ** 2 / n or 1.0
    w = np.full(K, 1.0 / K)
    z, t = w.copy(), 1.0
    for it in range(1, max_iter + 1):
        w_new = project_simplex(z - (2 * (D @ (z @ D)) / n) / L)
        if (z - w_new) @ (w_new - w) > 0:
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = w_new + (t - 1) / t_new * (w_new - w)
        step = np.abs(w_new - w).max()
        w, t = w_new, t_new
        if step < tol:
            return Fit(w, True, it)
    g = D @ (w @ D) / n
    return Fit(w, bool(g @ w - g.min() <= NO_GAP * float(np.mean(D * D)) * D.shape[1] / n), max_iter)
