"""Hand-computed fixtures (FIXTURES.md part C)."""

import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from evenkeel.operators import audit, detect, explain, metrics, mitigate, prepare
from evenkeel.functions.stats import chi2_sf, corr_p_value


def _pred_rows(group, tp, fp, tn, fn, model="m"):
    return ([(model, group, 1, 1)] * tp + [(model, group, 0, 1)] * fp
            + [(model, group, 0, 0)] * tn + [(model, group, 1, 0)] * fn)


@pytest.fixture
def c1(spark):
    rows = _pred_rows("A", 30, 10, 50, 10) + _pred_rows("B", 10, 5, 75, 10)
    return spark.createDataFrame(rows, "model string, g string, y_true int, y_pred int")


def test_c1_group_stats(c1):
    gs = {r["group"]: r for r in audit.group_stats(c1, ["g"], {"g": "A"}).collect()}
    a, b = gs["A"], gs["B"]
    assert (a.tp, a.fp, a.tn, a.fn, a.n) == (30, 10, 50, 10, 100)
    assert a.pos_pred_rate == pytest.approx(0.40) and b.pos_pred_rate == pytest.approx(0.15)
    assert a.true_pos_rate == pytest.approx(0.75) and b.true_pos_rate == pytest.approx(0.50)
    assert a.false_pos_rate == pytest.approx(10 / 60) and b.false_pos_rate == pytest.approx(0.0625)
    assert a.accuracy == pytest.approx(0.80) and b.accuracy == pytest.approx(0.85)
    assert a.is_privileged is True and b.is_privileged is False
    for r in gs.values():
        assert r.tp + r.fp + r.tn + r.fn == r.n


def test_c1_pairwise_and_summary(c1):
    gs = audit.group_stats(c1, ["g"], {"g": "A"})
    p = audit.pairwise(gs).first()
    assert p.privileged_group == "A" and p.group == "B"
    assert p.dpd == pytest.approx(0.25) and p.eod == pytest.approx(0.25)
    assert p.dir == pytest.approx(0.375)
    assert p.dpd_biased and p.eod_biased and p.dir_biased and p.any_bias
    s = audit.summary(gs).first()
    assert s.worst_dpd == pytest.approx(0.25) and s.worst_dir == pytest.approx(0.375) and s.is_biased


def test_c1_edges(spark):
    # a group without positives -> TPR 0; privileged with no predicted positive -> DIR 0
    rows = [("m", "A", 0, 0)] * 10 + [("m", "A", 0, 1)] * 5 + [("m", "B", 1, 0)] * 5 + [("m", "B", 0, 0)] * 5
    df = spark.createDataFrame(rows, "model string, g string, y_true int, y_pred int")
    gs = {r["group"]: r for r in audit.group_stats(df, ["g"], {"g": "A"}).collect()}
    assert gs["B"].true_pos_rate == 0.0
    p = audit.pairwise(audit.group_stats(df, ["g"], {"g": "A"})).first()
    assert p.dir == 0.0 and p.dir_biased
    # one group only: no pairs, summary 0 / 0 / 1, fair
    one = spark.createDataFrame([("m", "A", 1, 1), ("m", "A", 0, 0)], "model string, g string, y_true int, y_pred int")
    g1 = audit.group_stats(one, ["g"], {"g": "A"})
    assert audit.pairwise(g1).count() == 0
    s = audit.summary(g1).first()
    assert (s.worst_dpd, s.worst_eod, s.worst_dir, s.is_biased) == (0.0, 0.0, 1.0, False)


def test_privileged_fallback_tie_goes_to_first(spark):
    rows = _pred_rows("b", 5, 0, 5, 0) + _pred_rows("a", 5, 0, 5, 0) + _pred_rows("c", 1, 0, 9, 0)
    df = spark.createDataFrame(rows, "model string, g string, y_true int, y_pred int")
    s = audit.summary(audit.group_stats(df, ["g"])).first()
    assert s.privileged_group == "a"


def test_c2_reweighing(spark):
    rows = [("A", 1)] * 40 + [("A", 0)] * 60 + [("B", 1)] * 20 + [("B", 0)] * 80
    df = spark.createDataFrame(rows, "g string, y_true int")
    w = {(r.is_priv, r.y): r.weight for r in mitigate.reweighing_weights(df, "g", "A").collect()}
    assert w[(True, 1)] == pytest.approx(0.75) and w[(True, 0)] == pytest.approx(1.166667, abs=1e-6)
    assert w[(False, 1)] == pytest.approx(1.5) and w[(False, 0)] == pytest.approx(0.875)
    a = mitigate.apply_weights(df, mitigate.reweighing_weights(df, "g", "A"), "g", "A")
    assert a.agg(F.sum("weight")).first()[0] == pytest.approx(200.0)
    # invariant: weighted positive rates are equal across groups
    r = a.groupBy("g").agg((F.sum(F.col("weight") * F.col("y_true")) / F.sum("weight")).alias("r")).collect()
    assert r[0].r == pytest.approx(r[1].r)


def test_c3_chi_squared_yates(spark):
    ct = spark.createDataFrame([("f", "x", "1", 30), ("f", "x", "0", 10), ("f", "y", "1", 15),
                                ("f", "y", "0", 25)], "feature string, value string, class string, n long")
    yates = detect.chi2_stats(ct, ["feature"]).first()
    assert yates.dof == 1 and yates.chi2 == pytest.approx(9.9556, abs=1e-4)
    assert yates.cramers_v == pytest.approx(0.3528, abs=1e-4)
    plain = detect.chi2_stats(ct, ["feature"], yates=False).first()
    assert plain.chi2 == pytest.approx(11.4286, abs=1e-4) and plain.cramers_v == pytest.approx(0.3780, abs=1e-4)
    assert chi2_sf(9.9556, 1) == pytest.approx(0.0016036, rel=1e-3)


def test_p_values():
    assert chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    # r = 0.5 from 12 pairs: t = 1.8257, dof 10, two-sided p = 0.0979
    assert corr_p_value(0.5, 12) == pytest.approx(0.097863, abs=1e-5)


def test_c4_auc(spark):
    df = spark.createDataFrame([("m", 0, 0.1), ("m", 0, 0.4), ("m", 1, 0.35), ("m", 1, 0.8)],
                               "model string, y_true int, score double")
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(0.75)
    neg = df.withColumn("score", -F.col("score"))
    assert metrics.roc_auc(neg).first().roc_auc == pytest.approx(0.25)
    eq = df.withColumn("score", F.lit(0.3))
    assert metrics.roc_auc(eq).first().roc_auc == pytest.approx(0.5)
    one = df.where("y_true = 1")
    assert metrics.roc_auc(one).first().roc_auc is None


def test_c5_di_scan(spark):
    rows = ([("x", 1)] * 8 + [("x", 0)] * 2 + [("y", 1)] * 3 + [("y", 0)] * 7 + [("z", 0)] * 4
            + [(None, 1)] * 5)
    df = spark.createDataFrame(rows, "f string, y int")
    r = detect.disparate_impact_scan(df, ["f"], F.col("y")).first()
    assert r.n_groups == 2 and r.max_rate_group == "x" and r.min_rate_group == "y"
    assert r.max_rate == pytest.approx(0.8) and r.min_rate == pytest.approx(0.3)
    assert r.rate_spread == pytest.approx(0.5) and r.disparate_impact == pytest.approx(0.375) and r.flagged


def test_c6_thresholds(spark):
    rows = [("P", 1, s) for s in (0.9, 0.6, 0.6, 0.2)] + [("U", 1, s) for s in (0.45, 0.35, 0.25, 0.15)]
    df = spark.createDataFrame(rows, "g string, y_true int, score double")
    t = {r.group: r for r in mitigate.group_thresholds(df, "g", "P").collect()}
    assert t["P"].threshold == 0.5 and t["U"].target_tpr == pytest.approx(0.75)
    assert t["U"].threshold == pytest.approx(0.16) and t["U"].gap == pytest.approx(0.0)
    # group without positives: TPR 0 everywhere, first grid point wins
    rows2 = rows + [("N", 0, 0.7)]
    t2 = {r.group: r for r in mitigate.group_thresholds(spark.createDataFrame(rows2, df.schema), "g", "P").collect()}
    assert t2["N"].threshold == pytest.approx(0.10)


def test_c7_preparation(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0), ("a", 4.0), (None, 5.0), (None, 9.0)],
                               "k string, x double")
    imp = prepare.Imputer.fit(df, ["k"], ["x"])
    assert imp.modes["k"] == "a" and imp.medians["x"] == pytest.approx(3.5)
    sc = prepare.Scaler.fit(df, ["x"])
    assert sc.stats["x"][1] == pytest.approx(2.581989, abs=1e-6)
    oh = prepare.OneHot.fit(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), ["k"])
    assert oh.names() == ["k_b", "k_c"]


def test_exact_median_large(spark):
    from evenkeel.operators.quantile import exact_medians
    df = spark.range(0, 100001).select((F.col("id") * 7 % 100001).cast("double").alias("v"),
                                       (F.col("id") % 10).cast("double").alias("w"))
    m = exact_medians(df, ["v", "w"])
    assert m["v"] == 50000.0 and m["w"] == 4.0


def test_c8_linear_attribution(spark):
    class M:  # a fitted linear model's public surface
        coefficients = Vectors.dense([2.0, -1.0])
        intercept = 0.0
    bg = spark.createDataFrame([(Vectors.dense([0.0, 2.0]),), (Vectors.dense([2.0, 4.0]),)], ["features"])
    rows = spark.createDataFrame([(1, Vectors.dense([2.0, 1.0]))], ["row_id", "features"])
    phi = {r.feature: r.phi for r in explain.linear_attribution(M, rows, bg, ["a", "b"], ["row_id"]).collect()}
    assert phi == {"a": pytest.approx(2.0), "b": pytest.approx(2.0)}
    assert sum(phi.values()) == pytest.approx((2 * 2 - 1) - (2 * 1 - 3))


def test_c9_confidence(spark):
    assoc = spark.createDataFrame([("f1", 0.3, True), ("f2", 0.3, True), ("f3", 0.01, False)],
                                  "feature string, statistic double, flagged boolean")
    px = spark.createDataFrame([("f1", "sex", 0.5, True), ("f1", "race", 0.4, True), ("f2", "sex", 0.3, True),
                                ("f4", "sex", 0.3, True)],
                               "feature string, sensitive_attr string, cramers_v double, flagged_as_proxy boolean")
    di = spark.createDataFrame([("f1", 0.5, True), ("f2", 0.9, False)],
                               "feature string, disparate_impact double, flagged boolean")
    fl = {r.feature: r for r in detect.flagged_features(assoc, px, di).collect()}
    assert fl["f1"].methods_flagged == 3 and fl["f1"].confidence == "High"
    assert fl["f2"].methods_flagged == 2 and fl["f2"].confidence == "Medium"
    assert fl["f4"].methods_flagged == 1 and fl["f4"].confidence == "Low"
    assert fl["f1"].reasons == "target_corr=0.300 | proxy_for=['sex', 'race'] | DI=0.500"
    s = detect.detection_summary(detect.flagged_features(assoc, px, di), 4).first()
    assert (s.features_flagged, s.high_confidence, s.medium_confidence, s.low_confidence) == (3, 1, 1, 1)
