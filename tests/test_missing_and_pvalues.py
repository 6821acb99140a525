"""Missing values, infinities, p-values at any size, readers that keep every row."""
import math

import pytest
from pyspark.sql import functions as F

from evenkeel.functions.stats import chi2_sf
from evenkeel.operators import detect, metrics, mitigate, profile, reductions
from evenkeel.operators.quantile import exact_medians
from evenkeel.sources import readers

NAN, INF = float("nan"), float("inf")


def _tail(dof, x):
    """Chi-squared tail by the closed sum for even dof, in log space (reference values)."""
    a = dof // 2
    half = x / 2
    k = min(a - 1, int(half))  # largest terms around half
    logs = {k: -half + k * math.log(half) - math.lgamma(k + 1)}
    total, t = 0.0, logs[k]
    j, term = k, math.exp(t)
    peak = term
    while j >= 0 and term > peak * 1e-18:
        total += term
        term *= j / half
        j -= 1
    j, term = k + 1, peak * half / (k + 1)
    while j < a and term > peak * 1e-18:
        total += term
        j += 1
        term *= half / j
    return total


@pytest.mark.parametrize("dof", [2, 10, 100, 1000, 10 ** 4])
@pytest.mark.parametrize("z", [-1.0, 0.0, 1.6, 3.0])
def test_chi_squared_tail(dof, z):
    x = max(dof + z * math.sqrt(2 * dof), 0.1)
    assert chi2_sf(x, dof) == pytest.approx(_tail(dof, x), rel=1e-9)


@pytest.mark.parametrize("dof", [10 ** 5, 10 ** 6, 10 ** 7, 10 ** 8])
@pytest.mark.parametrize("z", [-1.0, 0.0, 1.6, 3.0])
def test_chi_squared_tail_at_large_dof(dof, z):
    """Against the Cornish-Fisher (Wilson-Hilferty corrected) normal form, exact to about 1 / dof."""
    x = dof + z * math.sqrt(2 * dof)
    # Edgeworth expansion of the standardised sum: skewness sqrt(8/dof), excess kurtosis 12/dof
    g, k = math.sqrt(8 / dof), 12 / dof
    phi = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = 0.5 * math.erfc(z / math.sqrt(2))
    want = upper + phi * (g / 6 * (z * z - 1) + k / 24 * (z ** 3 - 3 * z) + g * g / 72 * (z ** 5 - 10 * z ** 3 + 15 * z))
    assert chi2_sf(x, dof) == pytest.approx(want, rel=5e-5 if dof == 10 ** 5 else 1e-5)
    assert chi2_sf(float(dof), dof) < 0.5


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, "a", 1), (NAN, "b", 0), (None, None, 1), (3.0, "a", 0)], "x double, s string, y int")
    got = {r["column"]: r["n_missing"] for r in profile.missing_profile(df).collect()}
    assert got == {"x": 2, "s": 1, "y": 0}
    assert profile.dataset_summary(df, "y", 1).first()["missing_cells"] == 3


@pytest.mark.parametrize("values,want", [
    ([INF] * 2 + [1.0, 2.0, 3.0], 3.0), ([-INF] * 3 + [1.0], -INF), ([1.0, INF], INF), ([NAN, None, 4.0, 6.0], 5.0),
    ([NAN, None], None), ([1e308, -1e308, 1.7e308], 1e308)])
def test_medians_of_odd_numbers(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_medians(df, ["x"])["x"] == want


def test_median_with_an_outlier_over_many_rows(spark):
    df = spark.range(10_001).select(F.when(F.col("id") == 7, INF).otherwise(F.col("id").cast("double")).alias("x"))
    assert exact_medians(df, ["x"])["x"] == 5001.0


def test_targets_without_two_values_are_errors(spark):
    for ddl, rows in (("y string", [("a",), ("a",)]), ("y string", [(None,)]), ("y double", [(None,), (NAN,)]),
                      ("y int", [(1,), (1,)])):
        with pytest.raises(ValueError, match="single value"):
            detect.encode_target(spark.createDataFrame(rows, ddl), "y")


def test_target_scan_without_features(spark):
    df = spark.createDataFrame([(0,), (1,)], "y int")
    assert detect.target_association(df, "y", 1).count() == 0


def test_auc_with_an_outlier(spark):
    df = spark.range(20_000).select(F.lit("m").alias("model"), (F.col("id") % 2).alias("y_true"),
                                    F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 20_000).alias("score"))
    rows = df.collect()
    order = sorted(rows, key=lambda r: r["score"])
    below = u = 0
    for r in order:
        if r["y_true"]:
            u += below
        else:
            below += 1
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx(u / 10_000 ** 2, rel=1e-12)


def test_scored_rows_do_not_move_for_thresholds(spark):
    scored = spark.range(1000).select((F.col("id") % 5).cast("string").alias("g"), F.rand(1).alias("score"))
    t = spark.createDataFrame([(str(i), i / 10) for i in range(4)], "group string, threshold double")
    out = mitigate.apply_thresholds(scored, t, "g")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(g" not in plan
    assert out.where("g = '4' AND y_pred <> 0").count() == 0


def test_reduction_takes_null_groups(spark):
    from pyspark.ml.linalg import Vectors
    rows = [("a" if i % 3 else None, int(i % 2 == 0), Vectors.dense([float(i % 7), float(i % 2)])) for i in range(200)]
    df = spark.createDataFrame(rows, ["g", "y_true", "features"])
    fit = reductions.fit_fair(df, "g", max_rounds=3)
    assert fit.status in ("ok", "bound_not_met") and fit.members and len(fit.history) <= 3


def test_census_reader_keeps_every_row(spark, tmp_path):
    line = "{age}, Private, 1, Bachelors, 13, Never-married, Sales, Husband, White, Male, 0, 0, 40, Cuba, <=50K."
    lines = [line.format(age=a) for a in ("39", "?", "50.5", "40.0")] + ["1, short line"]
    path = tmp_path / "census.csv"
    path.write_text("\n".join(lines) + "\n")
    rows = readers.read_census_csv(spark, str(path)).collect()
    assert len(rows) == 5
    assert [r["age"] for r in rows[:4]] == [39, None, 50, 40] and {r["income"] for r in rows[:4]} == {"<=50K"}
    assert rows[4]["_corrupt_record"] == "1, short line" and rows[0]["_corrupt_record"] is None


def test_split_of_identical_keys(spark):
    from evenkeel.operators.prepare import stratified_split
    df = spark.range(1000).select(F.lit(7).alias("k"), (F.col("id") % 2).cast("int").alias("y")).repartition(6)
    got = {r["y"]: (r["n"], r["t"]) for r in stratified_split(df, "y", ["k"]).groupBy("y").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert got == {0: (500, 100), 1: (500, 100)}
