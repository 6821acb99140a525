"""Mitigation building blocks that are pure DataFrame plans.

A27 + J6 reweighing weights, A28 + W8 threshold search, J5 threshold
application. The model-fitting strategies (M12-M17) are in
``evenkeel.operators.strategies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import written

GRID_LO, GRID_HI = 10, 90          # fixed values: thresholds 0.10 .. 0.90 step 0.01
DEFAULT_T = 0.5
WEIGHT_EPS = 1e-8


def is_privileged(attribute: str, privileged: str) -> Column:
    """Null-safe membership of the privileged group (nulls are 'other')."""
    return F.coalesce(F.col(attribute).cast("string") == F.lit(str(privileged)), F.lit(False))


def reweighing_weights(df: DataFrame, attribute: str, privileged: str,
                       y: str = "y_true") -> DataFrame:
    """w(g, y) = P(g) P(y) / max(P(g, y), 1e-8) for the (group, label) cells.

    One partially aggregated count of at most four cells; the margins come
    from windows over those four rows.
    """
    cells = df.groupBy(is_privileged(attribute, privileged).alias("is_priv"),
                       F.col(y).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())
    pg = F.sum("n").over(Window.partitionBy("is_priv")) / tot
    py = F.sum("n").over(Window.partitionBy("y")) / tot
    pgy = F.col("n") / tot
    return cells.select("is_priv", "y", "n",
                        (pg * py / F.greatest(pgy, F.lit(WEIGHT_EPS))).alias("weight"))


def apply_weights(df: DataFrame, weights: DataFrame, attribute: str, privileged: str,
                  y: str = "y_true", out: str = "weight") -> DataFrame:
    """Attach each row's cell weight. The weight table has at most four
    rows (boolean x binary label), so broadcasting it is size-proven."""
    w = F.broadcast(weights.select("is_priv", F.col("y").alias("_wy"), F.col("weight").alias(out)))
    d = df.withColumn("_ip", is_privileged(attribute, privileged))
    return (d.join(w, (d["_ip"] == w["is_priv"]) & (d[y].cast("int") == w["_wy"]), "left")
             .drop("_ip", "is_priv", "_wy"))


def _grid_cell(score: Column) -> Column:
    """Highest grid index i (t = i/100) with t <= score; null below the grid."""
    c0 = F.floor(score * 100).cast("int")
    c1 = (F.when((c0 + 1) / 100.0 <= score, c0 + 1)
            .when(c0 / 100.0 > score, c0 - 1).otherwise(c0))
    c1 = F.least(c1, F.lit(GRID_HI))
    return F.when(c1 >= GRID_LO, c1)


def tpr_curve(scored: DataFrame, group: str, score: str = "score", y: str = "y_true") -> DataFrame:
    """TPR of every group at every grid threshold, in one pass.

    One aggregation counts rows per (group, k): k is the highest grid cell
    not above a positive's score (-1 below the grid) and -2 for negatives,
    so at most 83 rows per group. Each of those rows is spread over the 81
    grid points and a second small aggregation gives
    TP(t) = #positives with score >= t and the group's positives. Groups
    without positives still get all 81 rows (TPR 0).
    """
    return _curve_of(_grid_counts(scored, group, score, y))


def _grid_counts(scored: DataFrame, group: str, score: str, y: str) -> DataFrame:
    """(group, k, c): rows per group and grid cell."""
    g = F.col(group).cast("string")
    k = F.when(F.col(y) == 1, F.coalesce(_grid_cell(F.col(score)), F.lit(-1))).otherwise(F.lit(-2))
    return scored.groupBy(g.alias("group"), k.alias("k")).agg(F.count(F.lit(1)).alias("c"))


def _curve_of(a: DataFrame) -> DataFrame:
    e = a.select("group", "k", "c", F.explode(F.sequence(F.lit(GRID_LO), F.lit(GRID_HI))).alias("i"))
    t = e.groupBy("group", "i").agg(
        F.sum(F.when(F.col("k") >= F.col("i"), F.col("c")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("k") >= -1, F.col("c")).otherwise(0)).alias("n_pos"))
    return t.select("group", "i", (F.col("i") / 100.0).alias("threshold"), "n_pos", "tp",
                    F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).otherwise(0.0).alias("tpr"))


def group_thresholds(scored: DataFrame, group: str, privileged: str, score: str = "score",
                     y: str = "y_true") -> DataFrame:
    """Per non-privileged group the grid threshold whose TPR is closest to
    the privileged group's TPR at 0.5 (lowest threshold on ties); the
    privileged group keeps 0.5. Target is 0.5 if it has no positives.
    """
    counts = written(_grid_counts(scored, group, score, y), "grid")  # the only pass over the scored rows
    curve = _curve_of(counts)
    priv = str(privileged)
    r = counts.where((F.col("group") == priv) & (F.col("k") >= -1)).agg(
        F.sum("c").alias("p"), F.sum(F.when(F.col("k") >= int(DEFAULT_T * 100), F.col("c"))).alias("tp")).first()
    target = (r["tp"] or 0) / r["p"] if r["p"] else DEFAULT_T
    c = curve.where(F.col("group") != priv).withColumn("target_tpr", F.lit(target))
    c = c.withColumn("gap", F.abs(F.col("tpr") - F.col("target_tpr")))
    best = c.groupBy("group").agg(
        F.min_by(F.struct("i", "tpr", "gap", "target_tpr"), F.struct("gap", "i")).alias("b"))
    others = best.select("group", (F.col("b.i") / 100.0).alias("threshold"),
                         F.col("b.target_tpr").alias("target_tpr"), F.col("b.tpr").alias("tpr"),
                         F.col("b.gap").alias("gap"))
    p = curve.where((F.col("group") == priv) & (F.col("i") == int(DEFAULT_T * 100))).select(
        "group", F.lit(DEFAULT_T).alias("threshold"), F.lit(target).alias("target_tpr"),
        F.col("tpr"), F.lit(0.0).alias("gap"))
    return others.unionByName(p)


def apply_thresholds(scored: DataFrame, thresholds: DataFrame, group: str, score: str = "score",
                     out: str = "y_pred") -> DataFrame:
    """y_pred = score >= threshold of the row's group (0 if none).

    The threshold table has one row per group. It is written first, so the
    planner knows its size: under the broadcast limit it is broadcast and
    the scored rows stay where they are, otherwise it is a shuffle join
    whose hot groups AQE splits.
    """
    t = written(thresholds.select(F.col("group").alias("_g"), F.col("threshold").alias("_t")), "thresholds")
    d = scored.join(t, F.col(group).cast("string") == F.col("_g"), "left")
    return d.withColumn(out, F.coalesce((F.col(score) >= F.col("_t")).cast("int"), F.lit(0))) \
            .withColumnRenamed("_t", "threshold").drop("_g")
