"""Report tables behind the reference's charts and printouts."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.scalar import strategy_short_name
from evenkeel.spec import FairnessThresholds


def accuracy_vs_fairness(model_metrics: DataFrame, summary: DataFrame, attribute: str,
                         th: FairnessThresholds = FairnessThresholds()) -> DataFrame:
    """R1 + J3: accuracy against worst DIR, with the zone at the DIR limit."""
    s = summary.where(F.col("attribute") == attribute).select("model", "worst_dir")
    j = model_metrics.select("model", "accuracy").join(s, "model", "left")
    return j.withColumn("zone", F.when(F.col("worst_dir") >= th.dir, "fair").otherwise("biased"))


def bias_matrix(summary: DataFrame) -> DataFrame:
    """Bias magnitudes per (model, attribute); DIR 0 stays biased."""
    return summary.select("model", "attribute", F.abs("worst_dpd").alias("abs_dpd"),
                          F.abs("worst_eod").alias("abs_eod"),
                          (1.0 - F.least(F.col("worst_dir"), F.lit(1.0))).alias("dir_gap"))


def before_after(mitigation: DataFrame) -> DataFrame:
    """Accuracy and DIR per strategy with short labels."""
    return mitigation.select("strategy", strategy_short_name("strategy").alias("label"),
                             "accuracy", "dir")


def multi_model_table(model_metrics: DataFrame, summary: DataFrame, attribute: str) -> DataFrame:
    """R5 + J3: accuracy, F1, AUC and worst fairness per model for one attribute."""
    s = summary.where(F.col("attribute") == attribute).select(
        "model", "worst_dpd", "worst_eod", "worst_dir", "is_biased")
    return model_metrics.select("model", "accuracy", "f1", "roc_auc").join(s, "model", "left")


def audit_report_rows(model_metrics: DataFrame, summary: DataFrame, dataset: str) -> DataFrame:
    """One downloadable row per (model, attribute)."""
    j = summary.join(model_metrics.select("model", "accuracy"), "model", "left")
    return j.select("model", F.lit(dataset).alias("dataset"), "attribute",
                    F.col("worst_dpd").alias("dpd"), F.col("worst_eod").alias("eod"),
                    F.col("worst_dir").alias("dir"), F.col("is_biased").alias("biased"), "accuracy")


def best_model(model_metrics: DataFrame, measures: Sequence[str] = ("accuracy", "precision", "recall",
                                                                     "f1", "roc_auc")) -> DataFrame:
    """Best model per measure (ties: first model name)."""
    ms = [m for m in measures if m in model_metrics.columns]
    long = model_metrics.select("model", *[F.col(m).cast("double").alias(m) for m in ms]).unpivot(
        ["model"], ms, "metric", "value").where(F.col("value").isNotNull())
    return long.groupBy("metric").agg(
        F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("best_model"),
        F.max("value").alias("value"))


def recommended(mitigation: DataFrame, w_dir: float = 0.6, w_acc: float = 0.4) -> DataFrame:
    """Strategy with the best 0.6*DIR + 0.4*accuracy; baseline and failed
    rows are left out."""
    ok = mitigation.where((F.col("strategy") != "baseline") & F.col("accuracy").isNotNull()
                          & F.col("dir").isNotNull())
    sc = F.lit(w_dir) * F.col("dir") + F.lit(w_acc) * F.col("accuracy")
    return ok.agg(F.min_by(F.struct("strategy", "accuracy", "dir", "dpd"),
                           F.struct(-sc, F.col("strategy"))).alias("b")).select("b.*").where(
        F.col("strategy").isNotNull())


def top_flagged(scan: DataFrame, flag: str, order_by: str, ascending: bool = False,
                n: int = 10) -> DataFrame:
    """W1 + W2: the first n flagged rows of a scan (a top-n report)."""
    o = F.asc(order_by) if ascending else F.desc(order_by)
    return scan.where(F.col(flag)).orderBy(o, F.asc("feature")).limit(n)


def rank_flagged(flagged: DataFrame) -> DataFrame:
    """Flagged features by number of methods (desc), then name."""
    return flagged.orderBy(F.desc("methods_flagged"), F.asc("feature"))
