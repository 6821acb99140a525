"""Baseline classifiers with Spark ML.

Hyper-parameters follow the reference's configuration (fixed values):
logistic regression with L2, C = 1, up to 1000 iterations; decision tree of
depth 10 with at least 10 rows per leaf (so no node under 20 is split); forest
of 100 trees of depth 10, nodes under 20 rows not split (``Forest``).
The L2 penalty of ``0.5 * ||w||^2 / C`` on a summed loss equals Spark's
``regParam = 1 / (C * sum of weights)`` on its averaged loss, with
standardisation off (features are already scaled).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Dict, Optional, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators import forest
from evenkeel.operators.metrics import model_metrics
from evenkeel.session import written

SEED = 42
C = 1.0
LR_MAX_ITER = 1000
TREE_DEPTH = 10
TREE_MIN_LEAF = 10
FOREST_TREES = 100
MIN_SPLIT = 20
MAX_BINS = 256  # candidate thresholds per number
SCORED_CELLS = 200_000  # cells whose score a task keeps

MODEL_NAMES = ["logistic_regression", "decision_tree", "random_forest"]


def build(name: str, total_weight: float, weight_col: Optional[str] = None,
          label: str = "y_true", features: str = "features"):
    """M7 / M8 / M9 estimator for ``name``."""
    common = dict(featuresCol=features, labelCol=label, probabilityCol="probability",
                  rawPredictionCol="rawPrediction", predictionCol="prediction")
    if weight_col:
        common["weightCol"] = weight_col
    if name == "logistic_regression":
        return LogisticRegression(maxIter=LR_MAX_ITER, regParam=1.0 / (C * max(total_weight, 1.0)),
                                  elasticNetParam=0.0, standardization=False, family="binomial",
                                  tol=1e-6, **common)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=TREE_DEPTH, minInstancesPerNode=TREE_MIN_LEAF,
                                      maxBins=MAX_BINS, seed=SEED, **common)
    if name == "random_forest":
        # Node ids are kept per row and tree: else every level walks all rows down every tree again.
        return RandomForestClassifier(numTrees=FOREST_TREES, maxDepth=TREE_DEPTH, featureSubsetStrategy="sqrt",
                                      maxBins=MAX_BINS, seed=SEED, cacheNodeIds=True, checkpointInterval=-1, **common)
    raise ValueError(f"unknown model {name!r}; known: {', '.join(MODEL_NAMES)}")


class Forest:
    """A fitted forest whose nodes of fewer than ``min_split`` rows are leaves (M9): Spark ML grows the
    trees, this minimum is applied to them. Scores rows in Arrow batches, rows of one cell once."""

    def __init__(self, model, min_split: int = MIN_SPLIT) -> None:
        from evenkeel.operators.treeshap import Cells, load_trees
        self.grown, self.min_split = model, min_split
        self.trees = load_trees(model, min_split)
        self.cells = Cells(self.trees, model.numFeatures)
        shares = np.mean([t.importances(model.numFeatures) for t in self.trees], axis=0)
        self.featureImportances = Vectors.dense(shares / shares.sum() if shares.sum() > 0 else shares)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score`` = mean class-1 probability of the trees."""
        name = "_x"
        while name in df.columns:
            name = "_" + name
        held = df.withColumn(name, vector_to_array("features")).drop("features")
        shared = df.sparkSession.sparkContext.broadcast((self.trees, self.cells))

        def run(batches):
            trees, cells = shared.value
            used = [f for f, m in enumerate(cells.marks) if len(m)]
            known: Dict[bytes, float] = {}
            for batch in batches:
                n = batch.num_rows
                x = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                codes = np.ascontiguousarray(cells.codes(x)[:, used])
                raw, wide = codes.tobytes(), codes.shape[1] * codes.itemsize
                keys = [raw[i:i + wide] for i in range(0, n * wide, wide)] if wide else [b""] * n
                if len(known) > SCORED_CELLS:
                    known.clear()
                new = {key: i for i, key in enumerate(keys) if key not in known}
                if new:
                    rows, p = x[list(new.values())], 0.0
                    for t in trees:
                        p = p + t.predict(rows)
                    known.update(zip(new, (p / len(trees)).tolist()))
                yield batch.drop_columns([name]).append_column("score", pa.array([known[key] for key in keys], pa.float64()))

        schema = T.StructType([f for f in held.schema.fields if f.name != name] + [T.StructField("score", T.DoubleType())])
        return held.mapInArrow(run, schema)

    def write(self):
        return self.grown.write()


def fit(name: str, train: DataFrame, weight_col: Optional[str] = None):
    """Fit one estimator; returns (model, wall seconds)."""
    if weight_col:
        total = train.agg(F.sum(weight_col)).first()[0] or 0.0
    else:
        total = float(train.count())
    start = time.time()
    if name == "random_forest":
        model = Forest(forest.grow(build(name, total, weight_col), train))
    else:
        model = build(name, total, weight_col).fit(train)
    return model, time.time() - start


def score(model, df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """Predictions as (keep..., model, y_pred, score) with score = P(y = 1)."""
    if isinstance(model, Forest):
        out = model.transform(df.select(*dict.fromkeys(keep), "features"))
        return out.select(*keep, F.lit(name).alias("model"), (F.col("score") > 0.5).cast("int").alias("y_pred"), "score")
    out = model.transform(df)
    return out.select(*keep, F.lit(name).alias("model"),
                      F.col("prediction").cast("int").alias("y_pred"),
                      vector_to_array("probability")[1].alias("score"))


@dataclass
class TrainResult:
    """Fitted models, one predictions table, one metrics table."""
    models: Dict[str, object] = field(default_factory=dict)
    predictions: Optional[DataFrame] = None
    metrics: Optional[DataFrame] = None

    def get_model(self, name: str):
        if name not in self.models:
            raise ValueError(f"model {name!r} was not fitted; fitted: {', '.join(self.models)}")
        return self.models[name]

    def get_predictions(self, name: str) -> DataFrame:
        if name not in self.models:
            raise ValueError(f"model {name!r} was not fitted; fitted: {', '.join(self.models)}")
        return self.predictions.where(F.col("model") == name)


def train_all(train: DataFrame, test: DataFrame, keep: Sequence[str],
              names: Sequence[str] = MODEL_NAMES) -> TrainResult:
    """Fit every model, score the test rows, metrics + fit time per model."""
    spark: SparkSession = train.sparkSession
    models, preds, times = {}, [], []
    for n in names:
        m, secs = fit(n, train)
        models[n] = m
        times.append((n, round(secs, 3)))
        preds.append(score(m, test, n, keep))
    pred = preds[0]
    for p in preds[1:]:
        pred = pred.unionByName(p)
    pred = written(pred, "predictions")  # every row is scored once, however many tables are made of it
    t = spark.createDataFrame(times, "model string, train_time_sec double")
    return TrainResult(models, pred, model_metrics(pred).join(t, "model", "left"))


def save_model(model, path: str) -> None:
    """Spark ML persistence in place of pickles (a ``Forest`` saves the trees that Spark ML grew;
    wrap the loaded model again to apply the split minimum)."""
    model.write().overwrite().save(path)
