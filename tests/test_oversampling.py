"""Exact neighbours against brute force, synthetic rows between their ends, balanced cells."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from evenkeel.operators import neighbours, oversample
from evenkeel.plans.model_queries import _order_prepared

SF = "/root/testdata/sf0.001"
SCHEMA = "cell long, row long, codes array<int>, x array<double>, wanted boolean"


def brute(rows, k):
    out = set()
    for cell in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == cell]
        codes, x = np.array([r[2] for r in mine]).reshape(len(mine), -1), np.array([r[3] for r in mine]).reshape(len(mine), -1)
        d = neighbours.squared_distances(codes, x, codes, x)
        for i, r in enumerate(mine):
            if r[4]:
                order = sorted((float(d[i, j]), mine[j][1]) for j in range(len(mine)) if j != i)[:k]
                out |= {(r[1], place, n, d2) for place, (d2, n) in enumerate(order)}
    return out


def made(n, kind, seed=0):
    rng = np.random.default_rng(seed)
    codes = {"few": rng.integers(0, 2, (n, 2)), "many": rng.integers(0, 9, (n, 4)), "none": np.zeros((n, 0), int),
             "ties": rng.integers(0, 2, (n, 1))}[kind]
    x = rng.integers(0, 3, (n, 2)).astype(float) if kind == "ties" else rng.normal(size=(n, 3)) * [1, 5, 0.1]
    cells = np.where(np.arange(n) < 4, 9, rng.choice([0, 1, 2], n, p=[0.6, 0.3, 0.1]))
    return [(int(c), 7 * i, [int(v) for v in a], [float(v) for v in b], bool(c != 0 or i % 3 == 0))
            for i, (c, a, b) in enumerate(zip(cells, codes, x))]


@pytest.mark.parametrize("kind", ["few", "many", "none", "ties"])
@pytest.mark.parametrize("leaf,run,fan", [(64, 8192, 32), (8, 100, 3)])
def test_neighbours_equal_brute_force(spark, kind, leaf, run, fan):
    rows = made(700, kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {tuple(r) for r in neighbours.nearest(df, 5, leaf, run, fan).collect()}
    assert got == brute(rows, 5)


def test_no_numbers_and_repeated_rows(spark):
    rows = [(0, i, [i % 2, 1], [], True) for i in range(40)] + [(1, 100 + i, [1, 1], [], True) for i in range(3)]
    got = {tuple(r) for r in neighbours.nearest(spark.createDataFrame(rows, SCHEMA), 5, 4, 16, 2).collect()}
    assert got == brute(rows, 5)


def test_prepared_distances_are_vector_distances():
    codes, x = np.array([[0, 2], [1, 2], [3, 0]]), np.array([[0.5], [1.0], [1.0]])
    vectors = np.zeros((3, 1 + 3 + 2))
    vectors[:, 0] = x[:, 0]
    for i, (a, b) in enumerate(codes):
        if a:
            vectors[i, a] = 1
        if b:
            vectors[i, 3 + b] = 1
    want = ((vectors[:, None] - vectors[None]) ** 2).sum(axis=2)
    assert np.allclose(neighbours.squared_distances(codes, x, codes, x), want)


def test_most_leaf_pairs_are_ruled_out(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, [int(i % 3), int(i % 5)], [float(rng.normal())], True) for i in range(6000)]
    leaves = neighbours.build_leaves(spark.createDataFrame(rows, SCHEMA).repartition(4), 5, 2, 1)
    n, pairs = leaves.count(), neighbours.leaf_pairs(leaves, 2, 1)
    assert n > 90 and pairs.count() < 14 * n  # in proportion to the leaves, not to their pairs
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def prepared(spark):
    return _order_prepared(spark, SF)


def test_orders_are_balanced_and_synthetic_rows_lie_between(spark, prepared):
    args = (prepared.train, "c_mktsegment", "BUILDING", ["row_id"])
    out = oversample.oversample(*args, layout=prepared.layout)
    sizes = {(r["y_true"], r["is_priv"]): r["count"] for r in out.groupBy("y_true", "is_priv").count().collect()}
    own = {(r["y"], r["is_priv"]): r["n"] for r in oversample.cell_plan(*args[:3]).collect()}
    assert set(sizes.values()) == {max(own.values())} and sizes.keys() == own.keys()
    synth = oversample.synthesise(*args, layout=prepared.layout)
    rows = synth.select("base", "neighbour", "share", vector_to_array("features").alias("f")).collect()
    again = synth.select("base", "neighbour", "share").collect()
    assert sorted((r["base"], r["neighbour"], r["share"]) for r in rows) == sorted(tuple(r) for r in again)
    assert len(rows) == sum(max(own.values()) - n for n in own.values()) and all(r["base"] != r["neighbour"] for r in rows)
    # Each synthetic row is on the line between two rows of its cell, a neighbour of rank 5 or better.
    x = np.array([r["features"].toArray() for r in prepared.train.select("features").collect()])
    for r in rows[:40]:
        f = np.array(r["f"])
        d = np.sqrt(((x - f) ** 2).sum(axis=1))
        assert d.min() <= 1.5 and np.isfinite(f).all()


def test_small_cells_fall_back_to_classes_and_then_fail(spark):
    def frame(sizes):
        rows = [(i * 100 + j, y, g, Vectors.dense([float(j % 7), float(i)])) for i, ((y, g), n) in enumerate(sizes.items())
                for j in range(n)]
        return spark.createDataFrame(rows, ["id", "y_true", "g", "features"])

    few = frame({(0, "p"): 30, (0, "u"): 20, (1, "p"): 20, (1, "u"): 4})
    out = oversample.oversample(few, "g", "p", ["id"])
    assert {r["y_true"]: r["count"] for r in out.groupBy("y_true").count().collect()} == {0: 50, 1: 50}
    with pytest.raises(ValueError, match="at most 3 rows"):
        oversample.oversample(frame({(0, "p"): 30, (1, "u"): 3}), "g", "p", ["id"])


def test_a_tiny_cell_is_multiplied_many_times(spark):
    rows = [(i, int(i >= 6), "p", Vectors.dense([float(i % 11), i / 7])) for i in range(6 + 9000)]
    df = spark.createDataFrame(rows, ["id", "y_true", "g", "features"])
    out = oversample.synthesise(df, "g", "p", ["id"])
    got = out.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("neighbour").alias("k")).collect()
    assert len(got) == 6 and sum(r["n"] for r in got) == 8994 and {r["n"] for r in got} == {1499} and {r["k"] for r in got} == {5}


def test_balanced_rows_need_nothing(spark):
    rows = [(i, i % 2, "pu"[i // 2 % 2], Vectors.dense([float(i)])) for i in range(40)]
    df = spark.createDataFrame(rows, ["id", "y_true", "g", "features"])
    assert oversample.synthesise(df, "g", "p", ["id"]).count() == 0
