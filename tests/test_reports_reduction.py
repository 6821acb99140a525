"""Report rankings (W6, W7, A32 with T11) and the fair-classifier reduction."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from evenkeel.operators import reductions, report


def test_recommended_skips_baseline_and_failed(spark):
    rows = [("baseline", 0.90, 0.99, 0.1), ("reweighing", 0.80, 0.70, 0.1),
            ("thresholds", 0.70, 0.95, 0.0), ("fair_classifier", None, None, None)]
    m = spark.createDataFrame(rows, "strategy string, accuracy double, dir double, dpd double")
    r = report.recommended(m).first()
    # 0.6*0.95 + 0.4*0.70 = 0.85 beats 0.6*0.70 + 0.4*0.80 = 0.74
    assert r.strategy == "thresholds"


def test_best_model_and_bias_matrix(spark):
    mm = spark.createDataFrame([("a", 0.8, 0.5), ("b", 0.8, 0.7)], "model string, accuracy double, f1 double")
    best = {r.metric: r.best_model for r in report.best_model(mm).collect()}
    assert best == {"accuracy": "a", "f1": "b"}
    sm = spark.createDataFrame([("a", "g", -0.3, 0.05, 0.0)],
                               "model string, attribute string, worst_dpd double, worst_eod double, worst_dir double")
    b = report.bias_matrix(sm).first()
    assert (b.abs_dpd, b.abs_eod, b.dir_gap) == (0.3, 0.05, 1.0)   # DIR 0 is maximal bias (T11)


def test_reduction_reduces_parity_gap(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        g = "p" if i % 2 == 0 else "u"
        x = rng.normal() + (1.0 if g == "p" else -1.0)
        y = int(x + rng.normal() * 0.3 > 0)
        rows.append((i, g, y, Vectors.dense([x, 1.0 if g == "p" else 0.0])))
    df = spark.createDataFrame(rows, ["row_id", "g", "y_true", "features"])
    fit = reductions.fit_fair(df, "g", max_rounds=30)
    members, history = fit.members, fit.history
    assert history[0][1] > 0.2          # first best response violates the bound
    assert fit.status == "ok" and fit.violation <= 0.0 and 1 <= len(members) <= len(history) <= 30
    score = reductions.mixture_score(members)
    rates = {r.g: r.q for r in df.groupBy("g").agg(F.avg(score).alias("q")).collect()}
    assert abs(rates["p"] - rates["u"]) <= 2 * reductions.BOUND + 0.02
