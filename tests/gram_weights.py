"""Dense Frank-Wolfe on a matrix of products, the reference of the matrix-free solvers."""

import numpy as np

from forumshift.functions.weights import Fit


def fw_gram(Q: np.ndarray, c: np.ndarray, max_iter: int = 10_000, min_decrease: float = 1e-8,
            num_iter_no_change: int = 1) -> Fit:
    """Frank-Wolfe with exact line search for ``min w'Qw - 2c'w`` over the simplex.

    Stops when the objective decreases by less than ``min_decrease**2`` in
    ``num_iter_no_change`` consecutive steps.
    """
    K = len(c)
    if K == 1:
        return Fit(np.ones(1), True, 0)
    w = np.full(K, 1.0 / K)
    Qw = Q @ w
    f = w @ Qw - 2 * c @ w
    calm = 0
    for it in range(1, max_iter + 1):
        g = 2 * (Qw - c)
        i = int(np.argmin(g))
        d = -w.copy()
        d[i] += 1.0
        Qd = Q[:, i] - Qw
        dQd = d @ Qd
        if dQd <= 0:
            return Fit(w, True, it)
        gamma = min(1.0, max(0.0, (c @ d - w @ Qd) / dQd))
        w = w + gamma * d
        Qw = Qw + gamma * Qd
        f_new = w @ Qw - 2 * c @ w
        calm = calm + 1 if f - f_new < min_decrease ** 2 else 0
        f = f_new
        if calm >= num_iter_no_change:
            return Fit(w, True, it)
    return Fit(w, False, max_iter)
