"""Classification metrics per model (A25) and exact ROC-AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.scalar import safe_div
from evenkeel.session import written

AUC_BINS = 64


def confusion_counts() -> list:
    """Aggregate expressions of the confusion matrix."""
    yt, yp = F.col("y_true"), F.col("y_pred")
    return [F.count_if((yp == 1) & (yt == 1)).alias("tp"),
            F.count_if((yp == 1) & (yt == 0)).alias("fp"),
            F.count_if((yp == 0) & (yt == 0)).alias("tn"),
            F.count_if((yp == 0) & (yt == 1)).alias("fn")]


def confusion_rates() -> list:
    """Accuracy, precision, recall, F1 over ``confusion_counts`` (0 when undefined)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return [safe_div(tp + tn, tp + fp + tn + fn).alias("accuracy"),
            safe_div(tp, tp + fp).alias("precision"),
            safe_div(tp, tp + fn).alias("recall"),
            safe_div(2 * tp, 2 * tp + fp + fn).alias("f1")]


def confusion_metrics(pred: DataFrame, keys=("model",)) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (0 when undefined)."""
    a = pred.groupBy(*keys).agg(*confusion_counts())
    return a.select(*keys, "tp", "fp", "tn", "fn", *confusion_rates())


def roc_auc(pred: DataFrame, keys=("model",), score: str = "score",
            bins: int = AUC_BINS) -> DataFrame:
    """Exact, tie-aware ROC-AUC (Mann-Whitney) per model.

    AUC = sum_s p_s * (negatives below s + n_s / 2) / (P * N), over distinct
    scores s. Rows are first collapsed to distinct scores (partial
    aggregation), written once. The running count of negatives below each
    score is computed in two levels so that no window spans all scores of a
    model: scores fall into ``bins`` bins between approximate quantiles of
    the model's distinct scores (so outliers can't crowd them); a window
    over the bin totals gives the negatives before each bin, and a window
    partitioned by (model, bin) adds the negatives of lower scores inside
    the bin. The result is exact; binning only spreads the work. NaN scores
    count as missing. Null for a single class.
    """
    keys = list(keys)
    yt = F.col("y_true")
    x = F.col(score).cast("double")
    valid = pred.where(F.col(score).isNotNull() & ~F.isnan(x)).withColumn(score, x)
    d = written(valid.groupBy(*keys, score).agg(F.sum(yt).cast("double").alias("p_s"),
                                                F.sum(1 - yt).cast("double").alias("n_s")), "scores")
    cuts = d.groupBy(*keys).agg(F.percentile_approx(score, [i / bins for i in range(1, bins)], 20 * bins).alias("_cuts"))
    cuts = written(cuts, "cuts")  # one row per model, sized by the planner from its file
    d = (d.join(cuts, keys).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col(score)))).drop("_cuts"))
    bt = d.groupBy(*keys, "_bin").agg(F.sum("n_s").alias("_bn"), F.sum("p_s").alias("_bp"))
    wk = Window.partitionBy(*keys)
    bt = bt.select(*keys, "_bin",
                   F.coalesce(F.sum("_bn").over(wk.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0.0)).alias("_before"),
                   F.sum("_bp").over(wk).alias("P"), F.sum("_bn").over(wk).alias("N"))
    w_in = Window.partitionBy(*keys, "_bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    j = d.join(bt, keys + ["_bin"]).withColumn(
        "_below", F.col("_before") + F.coalesce(F.sum("n_s").over(w_in), F.lit(0.0)))
    agg = j.groupBy(*keys).agg(
        F.sum(F.col("p_s") * (F.col("_below") + F.col("n_s") / 2)).alias("_u"),
        F.max("P").alias("P"), F.max("N").alias("N"))
    return agg.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                    F.col("_u") / (F.col("P") * F.col("N"))).alias("roc_auc"))


def model_metrics(pred: DataFrame, keys=("model",), score: str = "score") -> DataFrame:
    """A25 + A26 in one table per model."""
    keys = list(keys)
    m = confusion_metrics(pred, keys)
    if score in pred.columns:
        m = m.join(roc_auc(pred, keys, score), keys, "left")
    else:
        m = m.withColumn("roc_auc", F.lit(None).cast("double"))
    return m
