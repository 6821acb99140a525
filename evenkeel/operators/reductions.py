"""Fair classifier by exponentiated-gradient reduction.

After Agarwal et al. (2018), demographic parity over every value of the
sensitive attribute: constraints +/-(P(h=1|a) - P(h=1)) <= bound.
A round is one weighted logistic regression on relabelled rows (the best
response to the current multipliers), warm-started at the last one; the pass
that confirms it also counts the member's predictions per group. Multipliers
come in turn from exponentiated gradients and from the linear program that
weighs the members found so far (``mixture.best_mixture``). The response to
the program's multipliers bounds what any further member could still gain:
the duality gap at which the game ends. The driver keeps two numbers per
group and member.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import List, Tuple

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.scalar import null_category
from evenkeel.operators import newton
from evenkeel.operators.mixture import best_mixture

BOUND = 0.05        # fixed values: difference bound, eps and round limit as published
EPS = 0.05
MAX_ROUNDS = 50
GAP = 0.01          # duality gap at which the game is solved
MAX_GROUPS = 10_000  # the driver keeps two multipliers per group
#: Mean gradient, and promised drop of the mean loss, at which a round's fit has converged. A round's
#: relabelling is often separable by group, where coefficients grow without changing a vote.
ROUND_TOLERANCE, ROUND_DECREASE = 1e-6, 1e-5

Member = Tuple[List[float], float, float]


def mixture_score(members: List[Member], features: str = "features") -> Column:
    """Share of the mixture that predicts 1 (the randomised classifier's P(y=1))."""
    x = vector_to_array(features)
    total = F.lit(0.0)
    for w, b, share in members:
        total = total + F.when(newton.margin(x, w, b) > 0, F.lit(float(share))).otherwise(0.0)
    return total


@dataclass
class FairFit:
    """members: (weights, intercept, share) of the mixture, shares sum to 1; history: one entry per round
    (round, violation of the best mixture so far, duality gap, inf before the first is known); status:
    ``ok``, or ``bound_not_met`` when no mixture keeps the bound; passes: reads of the training rows."""
    members: List[Member]
    history: List[Tuple[int, float, float]]
    status: str
    violation: float
    gap: float
    error: float = 0.0
    passes: int = 0


def fit_fair(train: DataFrame, attribute: str, label: str = "y_true", features: str = "features",
             max_rounds: int = MAX_ROUNDS, gap: float = GAP) -> FairFit:
    """Play the game between a learner and the multipliers until its duality gap closes.

    The mixture returned has the least error among the mixtures of all members that keep the
    bound (if none does, the least priced violation). Null groups are the group MISSING.
    """
    tr = train.select(null_category(attribute).alias("_a"), F.col(label).cast("int").alias("_y"),
                      vector_to_array(features).alias("_x"))
    n_groups = tr.agg(F.approx_count_distinct("_a").alias("k")).first()["k"]
    if n_groups > MAX_GROUPS:
        raise ValueError(f"{attribute} has about {n_groups} groups; the reduction keeps state for at most {MAX_GROUPS}")
    game = _Game(tr)
    try:
        return game.play(max_rounds, gap)
    finally:
        game.blocks.unpersist()


class _Game:
    """Rows ``_a``, ``_y``, ``_x`` and what is known of them: cells, groups, width."""

    def __init__(self, rows: DataFrame) -> None:
        got = rows.groupBy("_a", "_y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_x")).alias("d")).collect()
        if not got:
            raise ValueError("no rows to fit")
        self.groups = sorted({r["_a"] for r in got})
        self.width = max(r["d"] for r in got)
        if self.width > newton.MAX_FEATURES:
            raise ValueError(f"{self.width} features; the reduction takes at most {newton.MAX_FEATURES}")
        self.cells = np.zeros((len(self.groups), 2))
        for r in got:
            self.cells[self.groups.index(r["_a"]), r["_y"]] = r["n"]
        self.counts = self.cells.sum(axis=1)
        self.n = float(self.counts.sum())
        self.last, self.passes = {}, 0
        self.blocks = newton.packed(rows, self.groups)

    def slacks(self, share: np.ndarray) -> np.ndarray:
        """Both constraints of every group, given the rows per group that are predicted 1."""
        off = share / self.counts - share.sum() / self.n
        return np.concatenate([off, -off]) - BOUND

    def answer(self, multipliers: np.ndarray, kind: bool):
        """The learner's best response: (weights, intercept), error, slacks; starts at the last of its kind."""
        k = len(self.groups)
        push = multipliers[:k] - multipliers[k:]
        per_group = push / self.counts - push.sum() / self.n
        cost = np.stack([1 / self.n + per_group, -1 / self.n + per_group], axis=1)  # of predicting 1, by (group, label)
        wanted, weight = (cost < 0).astype(float), np.abs(cost) * self.n
        total = float((weight * self.cells).sum())
        named = (self.cells > 0) & (weight > 0)
        if not named.any() or len(np.unique(wanted[named])) == 1:  # one answer for every row: no fit
            one = float(wanted[named].max()) if named.any() else 0.0
            share = self.counts * one
            error = float(self.cells[:, 0].sum() if one else self.cells[:, 1].sum()) / self.n
            return ([0.0] * self.width, 1.0 if one else -1.0), error, self.slacks(share)

        def targets(block):
            return wanted[block.a, block.y], weight[block.a, block.y]

        def votes(block, z):
            h = (z > 0).astype(float)
            return np.append(np.bincount(block.a, h, k), np.abs(h - block.y).sum())

        fit = newton.minimise(self.blocks, self.width, targets, total, self.last.get(kind), ROUND_TOLERANCE,
                              votes, k + 1, ROUND_DECREASE)
        self.last[kind] = fit.start
        self.passes += fit.passes
        return (fit.coefficients.tolist(), fit.intercept), float(fit.extra[-1]) / self.n, self.slacks(fit.extra[:-1])

    def play(self, max_rounds: int, gap: float) -> FairFit:
        top = 1.0 / EPS                     # bound on the sum of multipliers
        eta = 2.0 / top
        theta = np.zeros(2 * len(self.groups))
        members, errors, slacks, history = [], [], [], []
        width, shares, value, priced = math.inf, None, math.inf, theta
        for t in range(max_rounds):
            by_program = t % 2 == 1
            if by_program:
                lam = priced
            else:
                high = max(0.0, theta.max())
                lam = top * np.exp(theta - high) / (math.exp(-high) + np.exp(theta - high).sum())
            member, error, slack = self.answer(lam, by_program)
            if by_program:  # no mixture of further members has a lower value than this response
                width = max(0.0, value - (error + float(lam @ slack)))
            else:
                theta = theta + eta * slack
            members.append(member)
            errors.append(error)
            slacks.append(slack)
            shares, value, priced = best_mixture(np.array(errors), np.array(slacks), top)
            worst = float((shares @ np.array(slacks)).max())
            worst = 0.0 if 0 < worst < 1e-9 else worst
            history.append((t, worst, width))
            if width <= gap:
                break
        used = shares > 1e-9
        chosen = [(w, b, float(s)) for (w, b), s, u in zip(members, shares / shares[used].sum(), used) if u]
        return FairFit(chosen, history, "ok" if worst <= 0 else "bound_not_met", worst, width,
                       float(shares @ np.array(errors)), self.passes)


def fair_classifier(ctx):
    """M15 strategy: (fit, predictions, detail)."""
    fit = fit_fair(ctx.train, ctx.attribute)
    score = mixture_score(fit.members)
    keys = [k for k in ctx.keep]
    u = (F.pmod(F.xxhash64(*[F.col(k) for k in keys if k != "y_true"], F.lit(42)), F.lit(1 << 30))
         / float(1 << 30))
    pred = ctx.test.select(*keys, score.alias("score")).withColumn(
        "y_pred", (u < F.col("score")).cast("int")).withColumn("model", F.lit("fair_classifier"))
    return fit, pred, f"members={len(fit.members)}; violation={fit.violation:.4f}; gap={fit.gap:.4f}"
