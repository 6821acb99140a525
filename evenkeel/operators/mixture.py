"""Weights of a mixture of classifiers under constraints, by linear programming."""

from __future__ import annotations

from typing import Tuple

import numpy as np

_ZERO = 1e-11


def best_mixture(errors: np.ndarray, slacks: np.ndarray, top: float) -> Tuple[np.ndarray, float, np.ndarray]:
    """(weights, value, multipliers) of the mixture with the least error and priced violation.

    ``errors``: one per member; ``slacks``: members x constraints, positive where violated. The weights
    are a distribution q over the members that minimises

        q . errors + top * max(0, greatest component of q . slacks).

    Solved through its dual, maximise u over multipliers l >= 0 of sum <= top with
    u <= errors_i + l . slacks_i for every member: a tableau of members + 1 rows, whatever the number
    of constraints. u stays basic; its row is the objective and ends up holding the weights.
    Dantzig's rule picks columns, Bland's once progress stalls, so it ends.
    """
    errors, slacks = np.asarray(errors, float), np.asarray(slacks, float)
    m, k = slacks.shape
    t = np.zeros((m + 1, k + m + 2))  # columns: multipliers, slack of each member, slack of the sum, right side
    t[:m, :k], t[m, :k] = -slacks, 1.0
    t[:, k:k + m + 1] = np.eye(m + 1)
    t[:m, -1], t[m, -1] = errors, top
    goal = int(errors.argmin())
    others = np.arange(m) != goal
    t[:m][others] -= t[goal]
    basis = k + np.arange(m + 1)
    stalled = 0
    while True:
        gain = t[goal, :-1]
        open_ = np.flatnonzero(gain < -_ZERO)
        if not len(open_):
            break
        j = int(open_[0]) if stalled > 2 * (m + k) else int(open_[gain[open_].argmin()])
        rows = np.flatnonzero((t[:, j] > _ZERO) & (np.arange(m + 1) != goal))
        ratio = t[rows, -1] / t[rows, j]
        ties = rows[ratio <= ratio.min() + _ZERO]
        r = int(ties[basis[ties].argmin()])
        before = t[goal, -1]
        t[r] /= t[r, j]
        hit = np.arange(m + 1) != r
        t[hit] -= np.outer(t[hit, j], t[r])
        basis[r] = j
        stalled = 0 if t[goal, -1] > before + _ZERO else stalled + 1
    weights = np.clip(t[goal, k:k + m], 0, None)
    multipliers = np.zeros(k + m + 1)
    keep = np.arange(m + 1) != goal
    multipliers[basis[keep]] = t[keep, -1]
    return weights / weights.sum(), float(t[goal, -1]), np.clip(multipliers[:k], 0, None)
