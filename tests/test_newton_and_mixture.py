"""Newton fits against Spark ML and numpy, the mixture program against its vertices, the reduction's optimum."""

import itertools

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from evenkeel.operators import models, newton, reductions
from evenkeel.operators.mixture import best_mixture


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=(800, 3)), rng.integers(0, 2, (800, 2))])
    y = (x @ [1.0, -2.0, 0.3, 0.8, -0.5] + rng.normal(size=800) > 0).astype(int)
    w = rng.choice([0.25, 1.0, 3.0], 800)
    data = [(int(a), float(b), Vectors.dense(v)) for a, b, v in zip(y, w, x)]
    return spark.createDataFrame(data, ["y_true", "w", "features"])


@pytest.mark.parametrize("weight", [None, "w"])
def test_newton_equals_spark_ml(rows, weight):
    got = newton.fit(rows, weight)
    total = rows.agg(F.sum(weight or F.lit(1.0))).first()[0]
    ml = LogisticRegression(labelCol="y_true", regParam=1 / total, standardization=False, tol=1e-14, maxIter=1000,
                            **({"weightCol": weight} if weight else {})).fit(rows)
    assert got.gradient <= newton.TOLERANCE
    assert np.allclose(got.coefficients, ml.coefficients.toArray(), atol=1e-5)
    assert got.intercept == pytest.approx(ml.intercept, abs=1e-5)
    ours = newton.score(got, rows, "m", ["y_true"]).agg(F.sum("y_pred"), F.sum("score")).first()
    assert ours[0] == ml.transform(rows).agg(F.sum("prediction")).first()[0]


def test_the_present_estimator_agrees(rows):
    got, (m, _) = newton.fit(rows), models.fit("logistic_regression", rows)
    assert np.allclose(got.coefficients, m.coefficients.toArray(), atol=2e-3)


def test_warm_start_saves_passes_and_partitions_do_not_matter(rows, monkeypatch):
    cold = newton.fit(rows)
    warm = newton.fit(rows, "w", start=cold.start)
    assert newton.fit(rows, start=cold.start).passes == 1 and warm.passes <= newton.fit(rows, "w").passes
    monkeypatch.setattr(newton, "DRIVER_SUMS", 2)
    assert np.allclose(newton.fit(rows.repartition(9)).coefficients, cold.coefficients, atol=1e-8)


def test_halvings_of_a_step_take_one_pass(rows):
    """From a start that is sure of other labels: the steps of one halving after the other, in fewer passes."""
    start = -50 * newton.fit(rows).start
    held = rows.select(vector_to_array("features").alias("x"), "y_true").collect()
    x, y = np.column_stack([[r["x"] for r in held], np.ones(len(held))]), np.array([r["y_true"] for r in held])
    ridge = np.append(np.full(x.shape[1] - 1, 1 / models.C), 0.0)

    def at(beta):
        z = x @ beta
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        return ((np.logaddexp(0, z) - y * z).sum() + 0.5 * ridge @ beta**2, x.T @ (p - y) + ridge * beta,
                x.T @ (x * (p * (1 - p))[:, None]) + np.diag(ridge))

    beta, (value, gradient, gram), passes = start, at(start), 1
    while np.abs(gradient).max() > newton.TOLERANCE * len(y):
        step, share = np.linalg.lstsq(gram, gradient, rcond=None)[0], 1.0
        while (got := at(beta - share * step))[0] > value + 1e-12 * abs(value):
            share, passes = share / 2, passes + 1
        beta, (value, gradient, gram), passes = beta - share * step, got, passes + 1
    ours = newton.fit(rows, start=start)
    assert np.allclose(ours.start, beta, atol=1e-7)
    assert ours.passes < passes


def test_rows_are_packed_into_small_blocks_and_come_back(spark, monkeypatch):
    monkeypatch.setattr(newton, "BLOCK_BYTES", 3 * 2 * 8)
    data = [("b" if i % 3 else "a", i % 2, 0.5 * i, [float(i), -1.0]) for i in range(10)]
    df = spark.createDataFrame(data, "_a string, _y int, _w double, _x array<double>").repartition(3)
    blocks = newton.packed(df, ["a", "b"])
    got = [newton._unpacked(b) for b in blocks.collect()]
    blocks.unpersist()
    assert all(len(b.y) <= 3 for b in got)
    back = sorted(("ab"[a], int(y), float(w), x.tolist()) for b in got for x, y, w, a in zip(b.x, b.y, b.w, b.a))
    assert back == sorted(data)


def test_one_class_and_no_rows(spark, rows):
    one = newton.fit(rows.where("y_true = 1"))
    assert one.intercept == float("inf") and not one.coefficients.any()
    assert newton.score(one, rows, "m", []).where("y_pred <> 1 OR score <> 1").count() == 0
    with pytest.raises(ValueError, match="no rows"):
        newton.fit(rows.where("false"))


def vertices(errors, slacks, top):
    """Least value over all vertices of {q, s: q >= 0, s >= 0, sum q = 1, s >= q . slacks}."""
    m, k = slacks.shape
    rows = [np.eye(m + 1)[i] for i in range(m + 1)] + [np.append(-slacks[:, j], 1.0) for j in range(k)]
    best = np.inf
    for some in itertools.combinations(rows, m):
        a = np.array([np.append(np.ones(m), 0.0), *some])
        if abs(np.linalg.det(a)) > 1e-12:
            x = np.linalg.solve(a, np.append(1.0, np.zeros(m)))
            if all(r @ x >= -1e-9 for r in rows):
                best = min(best, errors @ x[:m] + top * x[m])
    return best


def test_mixture_equals_the_best_vertex():
    rng = np.random.default_rng(3)
    for t in range(150):
        m, k = rng.integers(1, 5), 2 * rng.integers(1, 3)
        errors, slacks = rng.random(m), rng.normal(size=(m, k)) - 0.3
        if t % 4 == 0:  # ties and repeated members
            errors, slacks = np.round(errors, 1), np.round(slacks, 0)
        q, value, lam = best_mixture(errors, slacks, 5.0)
        assert (q >= 0).all() and q.sum() == pytest.approx(1) and lam.sum() <= 5 + 1e-9
        assert value == pytest.approx(errors @ q + 5 * max(0, (q @ slacks).max()), abs=1e-8)
        assert value == pytest.approx(vertices(errors, slacks, 5.0), abs=1e-7)


def test_many_constraints_are_few_rows():
    rng = np.random.default_rng(1)
    q, value, lam = best_mixture(rng.random(40), rng.normal(size=(40, 5000)) * 0.1, 20.0)
    assert q.sum() == pytest.approx(1) and (lam >= 0).all()


def test_reduction_reaches_the_best_mixture(spark):
    """One binary feature equal to the group: every classifier is one of four, so the optimum is known."""
    n = {("p", 1): 240, ("p", 0): 60, ("u", 1): 60, ("u", 0): 240}
    data = [(g, y, Vectors.dense([float(g == "p")])) for (g, y), k in n.items() for _ in range(k)]
    df = spark.createDataFrame(data, ["g", "y_true", "features"])
    fit = reductions.fit_fair(df, "g")
    errors, slacks = [], []
    for p, u in itertools.product((0, 1), repeat=2):
        errors.append(sum(k * abs((p if g == "p" else u) - y) for (g, y), k in n.items()) / 600)
        off = np.array([p - (p + u) / 2, u - (p + u) / 2])
        slacks.append(np.concatenate([off, -off]) - reductions.BOUND)
    best = vertices(np.array(errors), np.array(slacks), 1 / reductions.EPS)
    assert fit.status == "ok" and fit.gap <= reductions.GAP and len(fit.history) <= 12
    assert fit.error == pytest.approx(best, abs=reductions.GAP)
    assert sum(s for _, _, s in fit.members) == pytest.approx(1)
    rate = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.avg(reductions.mixture_score(fit.members)).alias("q")).collect()}
    assert abs(rate["p"] - rate["u"]) / 2 <= reductions.BOUND + 1e-6


def test_margin_reads_arrays(rows):
    got = rows.select(newton.margin(vector_to_array("features"), [1, 2, 3, 4, 5], 0.5).alias("m"), "features").first()
    assert got["m"] == pytest.approx(0.5 + np.dot(got["features"].toArray(), [1, 2, 3, 4, 5]))
