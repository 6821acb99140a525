"""Spec validation (S8), role inference (P8) and target encoding fallbacks."""

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import detect
from evenkeel.spec import AuditSpec


def test_validate_rejects_unknown_columns(spark):
    df = spark.createDataFrame([(1, "a")], "y int, s string")
    with pytest.raises(ValueError):
        AuditSpec(target="income").validate(df)
    with pytest.raises(ValueError):
        AuditSpec(target="y", sensitive=["sex"]).validate(df)
    assert AuditSpec(target="y", sensitive=["s"]).feature_columns(df) == ["s"]


def test_infer_roles(spark):
    rows = [(i, i % 3, f"s{i % 2}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, small int, name string, x double")
    r = detect.infer_roles(df, ["id", "small", "name", "x"])
    assert r.categorical == ["small", "name"] and r.numeric == ["id", "x"]


def test_encode_target_fallbacks(spark):
    s = spark.createDataFrame([("no",), ("no",), ("yes",), (None,)], "t string")
    assert [r[0] for r in s.select(detect.encode_target(s, "t").alias("y")).collect()] == [0, 0, 1, 1]
    # 0/1 column with majority 1 passes through (T3 decision), not y > median
    b = spark.createDataFrame([(1,), (1,), (0,)], "t int")
    assert [r[0] for r in b.select(detect.encode_target(b, "t").alias("y")).collect()] == [1, 1, 0]
    n = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "t double")
    assert [r[0] for r in n.select(detect.encode_target(n, "t").alias("y")).collect()] == [0, 0, 1, 1]
    # positive= wins
    assert [r[0] for r in s.select(detect.encode_target(s, "t", "no").alias("y")).collect()] == [1, 1, 0, 0]


def test_proxy_scan_empty_without_known(spark):
    df = spark.createDataFrame([("a", "x")], "f string, g string")
    assert detect.proxy_scan(df, ["f"], []).count() == 0
