"""Invariants from the survey's test plan."""

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import audit, detect, metrics, prepare
from evenkeel.sources import views

SF = "/root/testdata/sf0.001"


def test_confusion_sums_and_repartition(spark):
    v = views.order_audit(spark, SF)
    gs1 = audit.group_stats(v.long(), v.attributes, v.privileged)
    assert gs1.where("tp + fp + tn + fn != n").count() == 0
    gs2 = audit.group_stats(v.long().repartition(7), v.attributes, v.privileged)
    cols = ["model", "attribute", "group", "n", "tp", "fp", "tn", "fn"]
    assert sorted(gs1.select(cols).collect()) == sorted(gs2.select(cols).collect())


def test_cramers_v_in_unit_interval(spark):
    d = views.order_detect(spark, SF)
    px = detect.proxy_scan(d, ["o_orderstatus", "o_orderpriority", "n_name"], ["c_mktsegment", "r_name"])
    vals = [r.cramers_v for r in px.collect()]
    assert vals and all(0.0 <= v <= 1.0 + 1e-12 for v in vals)
    # nation determines region exactly
    assert max(vals) == pytest.approx(1.0)


def test_auc_mirror(spark):
    v = views.doc_audit(spark, SF)
    a = {r.model: r.roc_auc for r in metrics.roc_auc(v.long()).collect()}
    b = {r.model: r.roc_auc for r in metrics.roc_auc(v.long().withColumn("score", -F.col("score"))).collect()}
    for k in a:
        assert a[k] + b[k] == pytest.approx(1.0)


def test_split_is_exact_and_disjoint(spark):
    d = views.order_audit(spark, SF).df
    s = prepare.stratified_split(d, "y_true", ["row_id"])
    c = {(r.y_true, r.is_test): r["count"] for r in s.groupBy("y_true", "is_test").count().collect()}
    for y in (0, 1):
        n = c.get((y, True), 0) + c.get((y, False), 0)
        import math
        assert c.get((y, True), 0) == math.ceil(0.2 * n - 1e-9)
    assert s.select("row_id").distinct().count() == d.count()


def test_view_row_counts(spark):
    # FIXTURES B: rows at sf0.001
    assert views.doc_audit(spark, SF).df.count() == 87
    assert views.order_audit(spark, SF).df.count() == 1500
    assert views.line_audit(spark, SF).df.count() == 6000
    assert views.event_audit(spark, SF).df.count() == 1000
    n = views.line_nulls(spark, SF)
    assert n.where("l_returnflag IS NULL").count() > 0 and n.where("l_tax IS NULL").count() > 0


def test_split_with_identical_keys_straddling_cut(spark):
    rows = [(7, 0)] * 10 + [(i, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, y_true int")
    s = prepare.stratified_split(df, "y_true", ["k"])
    c = {(r.y_true, r.is_test): r["count"] for r in s.groupBy("y_true", "is_test").count().collect()}
    assert c[(0, True)] == 2 and c[(0, False)] == 8
    assert c[(1, True)] == 4 and c[(1, False)] == 16
