"""The forest grown on cells has the trees that Spark ML grows on the rows (M9)."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from evenkeel.operators import forest, models
from evenkeel.operators.treeshap import load_trees


def _rows(spark, n, values):
    h = F.abs(F.xxhash64("id", F.lit(3)))
    a, b, c = h % values, (h / 1000).cast("long") % 3, (h / 77777).cast("long") % 2
    y = ((a / values + b * 0.3 + F.abs(F.xxhash64("id")) % 1000 / 1000) > 1.0).cast("int")
    x = F.array(*[v.cast("double") for v in (a, b == 1, b == 2, c)])
    return spark.range(0, n, 1, 4).select("id", y.alias("y_true"), array_to_vector(x).alias("features"))


def _equal(a, b):
    return len(a) == len(b) and all(
        x.cats == y.cats and all(np.array_equal(getattr(x, k), getattr(y, k))
                                 for k in ("left", "right", "feat", "thr", "value", "cover", "rows", "gain"))
        for x, y in zip(a, b))


@pytest.mark.parametrize("values,on_cells", [(20, True), (100_000_000, False)])
def test_the_trees_are_those_of_the_rows(spark, monkeypatch, tmp_path, values, on_cells):
    train = _rows(spark, 6000, values)
    train.write.parquet(f"{tmp_path}/train")
    train = spark.read.schema(train.schema).parquet(f"{tmp_path}/train")
    tables = []

    def recorded(df, name, written=forest.written):
        out = written(df, name)
        tables.append((name, out.count()))
        return out
    monkeypatch.setattr(forest, "written", recorded)
    estimator = models.build("random_forest", 6000.0).setNumTrees(7)
    monkeypatch.setattr(models, "build", lambda *_: estimator)
    fitted, _ = models.fit("random_forest", train)
    if on_cells:  # the levels read at most 20 x 3 x 2 cells of two classes
        assert len(tables) == 1 and tables[0][1] <= 240
    else:
        assert not tables
    grown = estimator.fit(train)
    assert _equal(load_trees(fitted.grown), load_trees(grown))
    assert fitted.grown.getNumTrees == 7 and fitted.grown.numClasses == grown.numClasses == 2 and fitted.grown.featureImportances == grown.featureImportances


def test_rows_of_a_cell_have_the_score_of_the_trees(spark):
    train = _rows(spark, 3000, 50)
    estimator = models.build("random_forest", 3000.0).setNumTrees(5)
    fitted = models.Forest(forest.grow(estimator, train))
    odd = spark.createDataFrame([(-1, 0, [float("nan"), 1.0, 0.0, 1.0]), (-2, 1, [1e9, 0.0, 0.0, 0.0]), (-3, 1, [-0.0, 0.0, 1.0, 0.0])],
                                "id long, y_true int, x array<double>").withColumn("features", array_to_vector("x")).drop("x")
    rows = train.unionByName(odd)
    got = {r["id"]: r["score"] for r in fitted.transform(rows).select("id", "score").collect()}
    at = rows.select("id", "features").collect()
    x = np.array([r["features"].toArray() for r in at])
    want = np.mean([t.predict(x) for t in fitted.trees], axis=0)
    assert [got[r["id"]] for r in at] == pytest.approx(want.tolist(), abs=1e-15) and len(got) == 3003


def test_a_failed_pass_is_not_taken_for_missing_classes(spark):
    train = _rows(spark, 100, 5).withColumn("y_true", F.when(F.col("id") == 7, -1).otherwise(F.col("y_true")))
    with pytest.raises(Exception, match="(?i)label|class"):
        forest.grow(models.build("random_forest", 100.0).setNumTrees(2), train)
