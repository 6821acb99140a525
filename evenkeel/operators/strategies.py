"""Mitigation strategies that fit models.

Each strategy returns (model, predictions, detail). Predictions stay
distributed; the metrics rows of all strategies are one aggregate over their
written scores (A25, A26, A8). Fits are Newton steps (``newton``) that start
from the baseline's coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import List, Optional, Sequence, Tuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import metrics, mitigate, newton
from evenkeel.operators.audit import binary_counts, binary_metrics
from evenkeel.operators.oversample import oversample
from evenkeel.session import written
from evenkeel.spec import FairnessThresholds

# Strategy names in the order they are run.
STRATEGIES = ["baseline", "resampling", "reweighing", "fair_classifier", "thresholds"]

ROW_SCHEMA = ("strategy string, accuracy double, f1 double, roc_auc double, dpd double, "
              "eod double, dir double, biased boolean, status string, error string, detail string")


def evaluate(pred: DataFrame, attribute: str, privileged: str, strategy: Optional[str] = None,
             th: FairnessThresholds = FairnessThresholds(), detail: Optional[str] = None) -> DataFrame:
    """One metrics row per strategy: accuracy, F1, AUC and privileged-vs-rest fairness.

    ``strategy`` names the rows of ``pred``; without it their ``model`` column does. Confusion
    counts and the privileged/other counts come from ONE aggregation over the scored rows; the
    AUC is the only other pass. Both read one written narrow table, so a model scores every row once.
    """
    name = F.lit(strategy) if strategy is not None else F.col("model")
    p = written(pred.select(name.alias("model"), attribute, "y_true", "y_pred", "score"), "scored")
    a = p.groupBy("model").agg(*metrics.confusion_counts(), *binary_counts(attribute, privileged))
    m = a.select("model", *metrics.confusion_rates(), *binary_metrics())
    j = m.join(metrics.roc_auc(p), "model", "left")
    biased = (F.abs("dpd") > th.dpd) | (F.abs("eod") > th.eod) | (F.col("dir") < th.dir)
    return j.select(F.col("model").alias("strategy"), "accuracy", "f1", "roc_auc", "dpd", "eod", "dir",
                    biased.alias("biased"), F.lit("ok").alias("status"),
                    F.lit(None).cast("string").alias("error"), F.lit(detail).cast("string").alias("detail"))


@dataclass
class Context:
    """Prepared splits and what the strategies need to know of them; ``key`` tells rows apart and
    ``layout`` says which features are numbers and which one-hot blocks (``Prepared.layout``)."""
    train: DataFrame
    test: DataFrame
    attribute: str
    privileged: str
    keep: Sequence[str]
    key: Sequence[str] = ("row_id",)
    layout: Optional[Tuple[int, Sequence[int]]] = None

    @property
    def spark(self) -> SparkSession:
        return self.train.sparkSession


def baseline(ctx: Context, model: Optional[newton.LogisticFit] = None):
    """Plain logistic regression."""
    if model is None:
        model = newton.fit(ctx.train)
    pred = newton.score(model, ctx.test, "baseline", ctx.keep)
    return model, pred, None


def resampling(ctx: Context, base: Optional[newton.LogisticFit] = None):
    """Group-balanced oversampling, then a fit on the real and synthetic rows."""
    rows = written(oversample(ctx.train, ctx.attribute, ctx.privileged, ctx.key, layout=ctx.layout)
                   .select("features", "y_true"), "oversampled")
    model = newton.fit(rows, start=base.start if base is not None else None)
    pred = newton.score(model, ctx.test, "resampling", ctx.keep)
    detail = f"n_train_after={rows.count()}"
    return model, pred, detail


def reweighing(ctx: Context, base: Optional[newton.LogisticFit] = None):
    """Kamiran-Calders weights (A27) on the training rows, weighted fit."""
    w = mitigate.reweighing_weights(ctx.train, ctx.attribute, ctx.privileged)
    ws = [r["weight"] for r in w.collect()]          # at most four cells
    tr = mitigate.apply_weights(ctx.train, w, ctx.attribute, ctx.privileged)
    model = newton.fit(tr, "weight", start=base.start if base is not None else None)
    pred = newton.score(model, ctx.test, "reweighing", ctx.keep)
    detail = f"weight_range=[{min(ws):.3f}, {max(ws):.3f}]"
    return model, pred, detail


def thresholds(ctx: Context, base_model: newton.LogisticFit, fit_on: Optional[DataFrame] = None):
    """Equal-opportunity thresholds on the baseline scores; the first result is their table.

    Fitting and applying are separate; by default the thresholds are
    fitted on the rows they are applied to, as in the reference (T15).
    """
    scored = written(newton.score(base_model, ctx.test, "thresholds", ctx.keep), "scored")
    fit_rows = scored if fit_on is None else newton.score(base_model, fit_on, "thresholds", ctx.keep)
    t = mitigate.group_thresholds(fit_rows, ctx.attribute, ctx.privileged)
    pred = mitigate.apply_thresholds(scored.drop("y_pred"), t, ctx.attribute).drop("threshold")
    return t, pred, None


def run_all(ctx: Context, include: Sequence[str] = STRATEGIES) -> DataFrame:
    """Every strategy in the fixed order, one row each.

    Resampling or a fair classifier that fails becomes a row with its error (T14); any
    other failure is raised.
    """
    from evenkeel.operators.reductions import fair_classifier
    unknown = [n for n in include if n not in STRATEGIES]
    if unknown:
        raise ValueError(f"unknown strategy {unknown[0]}")
    base = newton.fit(ctx.train) if set(include) - {"fair_classifier"} else None
    run = {"baseline": lambda: baseline(ctx, base), "resampling": lambda: resampling(ctx, base),
           "reweighing": lambda: reweighing(ctx, base), "thresholds": lambda: thresholds(ctx, base),
           "fair_classifier": lambda: fair_classifier(ctx)}
    preds: List[DataFrame] = []
    notes: List[tuple] = []
    for place, name in enumerate(include):
        try:
            model, pred, detail = run[name]()
            preds.append(pred.select("model", ctx.attribute, "y_true", "y_pred", "score"))
            notes.append((place, name, getattr(model, "status", "ok"), None, detail))
        except Exception as e:
            if name not in ("resampling", "fair_classifier"):
                raise
            notes.append((place, name, "failed", f"{type(e).__name__}: {e}", None))
    said = ctx.spark.createDataFrame(notes, "place int, strategy string, status string, error string, detail string")
    if not preds:
        got = ctx.spark.createDataFrame([], ROW_SCHEMA)
    else:
        got = evaluate(reduce(DataFrame.unionByName, preds), ctx.attribute, ctx.privileged)
    out = said.join(got.drop("status", "error", "detail"), "strategy", "left").orderBy("place")
    return out.select(*[c.split()[0] for c in ROW_SCHEMA.split(", ")])
