"""Invariants of the model-based and detection queries on the driver tables (sf0.001)."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as E
from evenkeel.operators import detect, explain, models
from evenkeel.plans import model_queries as mq
from evenkeel.sources import views

SF = "/root/testdata/sf0.001"


def test_linear_attribution_sums_to_margin(spark):
    p = mq._order_prepared(spark, SF)
    m, _ = models.fit("logistic_regression", p.train)
    attr = explain.linear_attribution(m, p.test, p.train, p.feature_names, ["row_id"])
    s = attr.groupBy("row_id").agg(F.sum("phi").alias("s"))
    w = [float(v) for v in m.coefficients.toArray()]
    mean = explain.background_mean(p.train, len(w))
    base = sum(a * b for a, b in zip(w, mean)) + m.intercept
    raw = m.transform(p.test).select("row_id", vector_to_array("rawPrediction")[1].alias("margin"))
    got = s.join(raw, "row_id").collect()
    assert len(got) == p.test.count() > 0
    for r in got:
        assert r.s == pytest.approx(r.margin - base, abs=1e-6)


def test_nation_is_flagged_as_region_proxy(spark):
    r = detect.full_detection(views.order_detect(spark, SF), "y_true", 1, ["c_mktsegment", "r_name"])
    fl = {x.feature: x for x in r["flagged_features"].collect()}
    assert "n_name" in fl
    assert "proxy_for=" in fl["n_name"].reasons and "'r_name'" in fl["n_name"].reasons
    s = r["summary"].first()
    assert s.total_features_scanned == 6 and s.features_flagged == len(fl)


def test_mitigation_rows_have_status(spark):
    rows = {r.strategy: r for r in E.queries()["before_after"](spark, SF).collect()}
    assert set(rows) == {"baseline", "resampling", "reweighing", "fair_classifier", "thresholds"}
    assert all(r.accuracy is not None for r in rows.values())
