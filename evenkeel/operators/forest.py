"""Spark ML's forest grown on cells instead of rows (M9).

A forest's histograms tell rows apart by their class and binned features only,
and what they add up of a row is how often each tree drew it. Rows of one cell
(class, bins) are therefore added up first: thresholds, draws (same seed, same
partitions) and the growing itself are Spark ML's own, and as these are sums
of whole numbers the trees are the ones that it grows on the rows. Every row is
drawn for every tree in one pass; the levels then read cells.

Where cells are nearly as many as rows, or Spark's classes are not as in 4.1,
the public estimator fits the rows.
"""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import tasks, written

#: Rows per cell from which growing on cells pays.
WORTH = 4


def grow(estimator: RandomForestClassifier, train: DataFrame) -> RandomForestClassificationModel:
    """``estimator.fit(train)``; a weighted fit stays on rows."""
    if estimator.hasParam("weightCol") and estimator.isDefined("weightCol"):
        return estimator.fit(train)
    try:
        model = _on_cells(estimator, train)
    except (Py4JError, TypeError) as e:  # no such class, method or field; a failed job is an error
        if isinstance(e, Py4JJavaError):
            raise
        warnings.warn(f"the forest is grown on rows: {e}")
        model = None
    return model if model is not None else estimator.fit(train)


def _object(jvm, name: str):
    """A Scala object (or a class, with ``name`` ending in it) by its full name."""
    at = jvm
    for part in name.split("."):
        at = getattr(at, part)
    return at


def _singleton(jvm, name: str):
    return getattr(_object(jvm, name + "$"), "MODULE$")


def _bagged_encoder(jvm):
    """Encoder of BaggedPoint(TreePoint(label, binnedFeatures, weight), subsampleCounts, sampleWeight)."""
    encoders = "org.apache.spark.sql.catalyst.encoders.AgnosticEncoders"
    none, empty = jvm.scala.Option.apply(None), jvm.org.apache.spark.sql.types.Metadata.empty()
    double = _singleton(jvm, f"{encoders}$PrimitiveDoubleEncoder")
    ints = _object(jvm, f"{encoders}$ArrayEncoder")(_singleton(jvm, f"{encoders}$PrimitiveIntEncoder"), False)

    def product(name: str, fields: list):
        kind = jvm.java.lang.Class.forName(name, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        made = jvm.java.util.ArrayList()
        for n, e in fields:
            made.add(_object(jvm, f"{encoders}$EncoderField")(n, e, False, empty, none, none))
        seq = jvm.org.apache.spark.api.python.PythonUtils.toSeq(made)
        return _object(jvm, f"{encoders}$ProductEncoder")(jvm.scala.reflect.ClassTag.apply(kind), seq, none)

    tree = "org.apache.spark.ml.tree.impl"
    point = product(f"{tree}.TreePoint", [("label", double), ("binnedFeatures", ints), ("weight", double)])
    bagged = product(f"{tree}.BaggedPoint", [("datum", point), ("subsampleCounts", ints), ("sampleWeight", double)])
    return jvm.org.apache.spark.sql.catalyst.encoders.ExpressionEncoder.apply(bagged)


def _on_cells(estimator: RandomForestClassifier, train: DataFrame) -> RandomForestClassificationModel | None:
    """The forest as RandomForest.run grows it, with the drawn points added up; None if that saves too little."""
    spark = train.sparkSession
    sc, jvm = spark.sparkContext, spark._jvm
    impl = jvm.org.apache.spark.ml.tree.impl
    estimator._transfer_params_to_java()
    java, jdf = estimator._java_obj, train._jdf
    n_classes = java.getNumClasses(jdf, getattr(java, "getNumClasses$default$2")())
    if n_classes < 2:
        return None
    n_trees, seed, ways = estimator.getNumTrees(), estimator.getSeed(), estimator.getFeatureSubsetStrategy()
    field = jdf.schema().apply(estimator.getFeaturesCol())
    strategy = java.getOldStrategy(_singleton(jvm, "org.apache.spark.ml.util.MetadataUtils").getCategoricalFeatures(field),
                                   n_classes, jvm.org.apache.spark.mllib.tree.configuration.Algo.Classification(),
                                   java.getOldImpurity())
    getattr(strategy, "bootstrap_$eq")(estimator.getBootstrap())

    instances = _singleton(jvm, "org.apache.spark.ml.util.DatasetUtils").extractInstances(
        java, jdf, jvm.scala.Option.apply(n_classes))
    metadata = impl.DecisionTreeMetadata.buildMetadata(instances, strategy, n_trees, ways)
    splits = _singleton(jvm, "org.apache.spark.ml.tree.impl.RandomForest").findSplits(instances, metadata, seed)
    points = impl.TreePoint.convertToTreeRDD(instances, splits, metadata)
    bagged = impl.BaggedPoint.convertToBaggedRDD(
        points, estimator.getSubsamplingRate(), n_trees, estimator.getBootstrap(),
        getattr(impl.BaggedPoint, "convertToBaggedRDD$default$5")(), seed)

    encoder = _bagged_encoder(jvm)
    rows = DataFrame(spark._jsparkSession.createDataset(bagged, encoder), spark)
    cell = [F.col("datum.label").alias("label"), F.col("datum.binnedFeatures").alias("bins")]
    drawn = rows.select(*cell, *[F.col("subsampleCounts")[i].alias(f"n{i}") for i in range(n_trees)])
    # Counted before anything is drawn: a draw for every tree is most of the pass below.
    bins = DataFrame(spark._jsparkSession.createDataset(_undrawn(impl, points, seed), encoder), spark).select(*cell)
    n = bins.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("label", "bins")).alias("cells")).first()
    if n["cells"] * WORTH > n["rows"]:
        return None
    cells = written(
        drawn.groupBy("label", "bins").agg(*[F.sum(f"n{i}").cast("int").alias(f"n{i}") for i in range(n_trees)])
        .select("label", "bins", F.array(*[f"n{i}" for i in range(n_trees)]).alias("subsampleCounts"))
        .repartition(tasks(spark)), "forest_cells")
    summed = cells.select(F.struct("label", F.col("bins").alias("binnedFeatures"), F.lit(1.0).alias("weight")).alias("datum"),
                          "subsampleCounts", F.lit(1.0).alias("sampleWeight"))
    held = getattr(jvm.org.apache.spark.api.java.JavaSparkContext, "toSparkContext")(sc._jsc).broadcast(
        splits, jvm.scala.reflect.ClassTag.apply(splits.getClass()))
    trees = impl.RandomForest.runBagged(
        getattr(summed._jdf, "as")(encoder).rdd(), metadata, held, strategy, n_trees, ways, seed,
        jvm.scala.Option.apply(None), getattr(impl.RandomForest, "runBagged$default$9")(), getattr(impl.RandomForest, "runBagged$default$10")(),
        getattr(impl.RandomForest, "runBagged$default$11")())
    kind = jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel
    typed = sc._gateway.new_array(kind, n_trees)
    for i in range(n_trees):
        typed[i] = trees[i]
    model = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        java.uid(), typed, metadata.numFeatures(), n_classes)
    java.copyValues(model, getattr(java, "copyValues$default$2")())
    return estimator._copyValues(estimator._create_model(model))


def _undrawn(impl, points, seed: int):
    """The points with one draw each that takes every row: to count cells."""
    return impl.BaggedPoint.convertToBaggedRDD(points, 1.0, 1, False,
                                               getattr(impl.BaggedPoint, "convertToBaggedRDD$default$5")(), seed)
