"""Group audit.

Input is a *long* predictions table ``(model, y_true, y_pred, <attrs>)``.
All attributes and all models are audited in ONE aggregation: the
attributes are unpivoted (an Expand node) and the confusion counts are
partially aggregated in the same task before the shuffle, so the shuffle
carries one row per (task, model, attribute, group) whatever the data
size, and a hot group costs nothing extra. Everything after that works
on the tiny ``group_stats`` table.
"""

from __future__ import annotations

from typing import Mapping, Optional, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.scalar import privileged_lookup, privileged_marker, safe_div
from evenkeel.session import written
from evenkeel.spec import FairnessThresholds

GROUP_KEYS = ["model", "attribute", "group"]


def attach_attributes(pred: DataFrame, table: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Predictions joined to the sensitive columns of their rows by id."""
    return pred.join(table, row_id, "inner")


def melt_attributes(pred: DataFrame, attributes: Sequence[str], null_group: str = "drop",
                    extra: Sequence[str] = ()) -> DataFrame:
    """(model, y_true, y_pred, attrs...) -> (model, y_true, y_pred, attribute, group)."""
    ids = ["model", "y_true", "y_pred", *extra]
    cols = [F.col(a).cast("string").alias(a) for a in attributes]
    long = pred.select(*ids, *cols).unpivot(ids, list(attributes), "attribute", "group")
    if null_group == "drop":
        return long.where(F.col("group").isNotNull())
    return long.withColumn("group", F.coalesce("group", F.lit(null_group)))


def group_counts(pred: DataFrame, attributes: Sequence[str], null_group: str = "drop") -> DataFrame:
    """A1: confusion counts per (model, attribute, group), of a table or a stream."""
    long = melt_attributes(pred, attributes, null_group)
    yt, yp = F.col("y_true"), F.col("y_pred")
    return long.groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(yt).cast("long").alias("n_positive_true"),
        F.sum(yp).cast("long").alias("n_predicted_pos"),
        F.count_if((yp == 1) & (yt == 1)).alias("tp"),
        F.count_if((yp == 1) & (yt == 0)).alias("fp"),
        F.count_if((yp == 0) & (yt == 0)).alias("tn"),
        F.count_if((yp == 0) & (yt == 1)).alias("fn"),
    )


def group_rates(counts: DataFrame, privileged: Optional[Mapping[str, str]] = None,
                round_rates: Optional[int] = None) -> DataFrame:
    """A2: rates and privileged marker from ``group_counts``."""
    rate = (lambda c: F.bround(c, round_rates)) if round_rates is not None else (lambda c: c)
    priv = privileged_lookup(F.col("attribute"), privileged)
    return counts.select(
        *GROUP_KEYS, "n", "n_positive_true", "n_predicted_pos",
        rate(safe_div("n_predicted_pos", "n")).alias("pos_pred_rate"),
        rate(safe_div("tp", F.col("tp") + F.col("fn"))).alias("true_pos_rate"),
        rate(safe_div("fp", F.col("fp") + F.col("tn"))).alias("false_pos_rate"),
        rate(safe_div(F.col("tp") + F.col("tn"), "n")).alias("accuracy"),
        "tp", "fp", "tn", "fn",
        privileged_marker("group", priv).alias("is_privileged"),
    )


def group_stats(pred: DataFrame, attributes: Sequence[str],
                privileged: Optional[Mapping[str, str]] = None,
                null_group: str = "drop", round_rates: Optional[int] = None) -> DataFrame:
    """A1 + A2: confusion counts and rates per (model, attribute, group)."""
    return group_rates(group_counts(pred, attributes, null_group), privileged, round_rates)


def privileged_groups(stats: DataFrame) -> DataFrame:
    """A5: the privileged group per (model, attribute).

    The configured value when it occurs, else the group with the highest
    positive prediction rate (ties: first group in sort order).
    """
    return stats.groupBy("model", "attribute").agg(
        F.coalesce(
            F.max(F.when(F.col("is_privileged"), F.col("group"))),
            F.min_by("group", F.struct(-F.col("pos_pred_rate"), F.col("group"))),
        ).alias("privileged_group"))


def annotate_pairs(stats: DataFrame) -> DataFrame:
    """A5 + J1 + A3: every group row with its (model, attribute)'s privileged
    group, that group's rates and DPD / EOD / DIR against it.

    ``stats`` is small (one row per model x attribute x group) but is needed
    twice (privileged rows, all rows), so it is first written once in the
    shared folder: the source is read once, not once per branch. The
    privileged rows (one per model and attribute) are written too: the
    planner knows their size and broadcasts them when they are small, so
    the group rows don't move; else it is a shuffle join.
    """
    st = written(stats, "group_stats")
    rates = F.struct("group", "pos_pred_rate", "true_pos_rate")
    best = F.struct(-F.col("pos_pred_rate"), F.col("group"))
    pick = F.coalesce(F.max(F.when(F.col("is_privileged"), rates)), F.min_by(rates, best))
    prow = written(st.groupBy("model", "attribute").agg(pick.alias("p")).select(
        "model", "attribute", F.col("p.group").alias("privileged_group"),
        F.col("p.pos_pred_rate").alias("_ppr_p"), F.col("p.true_pos_rate").alias("_tpr_p")), "privileged")
    a = st.join(prow, ["model", "attribute"])
    is_p = F.col("group") == F.col("privileged_group")
    dpd = F.col("_ppr_p") - F.col("pos_pred_rate")
    eod = F.col("_tpr_p") - F.col("true_pos_rate")
    dir_ = F.when(F.col("_ppr_p") > 0, F.col("pos_pred_rate") / F.col("_ppr_p")).otherwise(0.0)
    return a.select("*", dpd.alias("dpd"), eod.alias("eod"), dir_.alias("dir"), is_p.alias("_is_priv_row"))


def pairwise(stats: DataFrame, thresholds: FairnessThresholds = FairnessThresholds()) -> DataFrame:
    """J1 + A3 + P13: privileged group against each other group."""
    a = annotate_pairs(stats).where(~F.col("_is_priv_row"))
    out = a.select("model", "attribute", "privileged_group", "group", "dpd", "eod", "dir")
    return out.select(
        "*",
        (F.abs("dpd") > thresholds.dpd).alias("dpd_biased"),
        (F.abs("eod") > thresholds.eod).alias("eod_biased"),
        (F.col("dir") < thresholds.dir).alias("dir_biased"),
    ).withColumn("any_bias", F.col("dpd_biased") | F.col("eod_biased") | F.col("dir_biased"))


def summary(stats: DataFrame, pairs: Optional[DataFrame] = None,
            thresholds: FairnessThresholds = FairnessThresholds()) -> DataFrame:
    """A4 + A7: worst pair per (model, attribute).

    Worst DPD / EOD are the signed values of largest magnitude (0 when no
    pair; ties go to the first group in sort order); worst DIR is the
    smallest ratio, never above 1 (so reverse bias shows in DPD only).
    Computed from the annotated stats in one aggregation (``pairs`` is
    accepted for API symmetry and not needed).
    """
    a = annotate_pairs(stats)
    other = ~F.col("_is_priv_row")
    g = a.groupBy("model", "attribute").agg(
        F.max("privileged_group").alias("privileged_group"),
        F.sum("n").alias("n"), F.sum("n_predicted_pos").alias("_npp"),
        F.min_by(F.when(other, F.col("dpd")),
                 F.when(other, F.struct(-F.abs("dpd"), F.col("group")))).alias("_wdpd"),
        F.min_by(F.when(other, F.col("eod")),
                 F.when(other, F.struct(-F.abs("eod"), F.col("group")))).alias("_weod"),
        F.min(F.when(other, F.col("dir"))).alias("_wdir"))
    wdpd = F.when(F.abs(F.coalesce("_wdpd", F.lit(0.0))) > 0, F.col("_wdpd")).otherwise(0.0)
    weod = F.when(F.abs(F.coalesce("_weod", F.lit(0.0))) > 0, F.col("_weod")).otherwise(0.0)
    wdir = F.least(F.coalesce("_wdir", F.lit(1.0)), F.lit(1.0))
    out = g.select("model", "attribute", "privileged_group", "n",
                   safe_div("_npp", "n").alias("overall_pos_rate"),
                   wdpd.alias("worst_dpd"), weod.alias("worst_eod"), wdir.alias("worst_dir"))
    return out.withColumn(
        "is_biased",
        (F.abs("worst_dpd") > thresholds.dpd) | (F.abs("worst_eod") > thresholds.eod)
        | (F.col("worst_dir") < thresholds.dir))


def full_audit(pred: DataFrame, attributes: Sequence[str],
               privileged: Optional[Mapping[str, str]] = None,
               thresholds: FairnessThresholds = FairnessThresholds(),
               null_group: str = "drop", round_rates: Optional[int] = None):
    """(group_stats, pairwise, summary) for every model and attribute."""
    gs = group_stats(pred, attributes, privileged, null_group, round_rates)
    pw = pairwise(gs, thresholds)
    return gs, pw, summary(gs, pw, thresholds)


def binary_counts(attribute: str, privileged: str) -> list:
    """Aggregate expressions of A8: privileged vs all other rows pooled
    (nulls count as other)."""
    is_p = F.coalesce(F.col(attribute).cast("string") == F.lit(str(privileged)), F.lit(False))
    yt, yp = F.col("y_true"), F.col("y_pred")
    return [
        F.count_if(is_p).alias("n_p"), F.count_if(~is_p).alias("n_u"),
        F.sum(F.when(is_p, yp)).alias("pp_p"), F.sum(F.when(~is_p, yp)).alias("pp_u"),
        F.count_if(is_p & (yp == 1) & (yt == 1)).alias("tp_p"),
        F.count_if(is_p & (yp == 0) & (yt == 1)).alias("fn_p"),
        F.count_if(~is_p & (yp == 1) & (yt == 1)).alias("tp_u"),
        F.count_if(~is_p & (yp == 0) & (yt == 1)).alias("fn_u")]


def binary_metrics() -> list:
    """DPD, EOD, DIR columns over the ``binary_counts`` aggregate."""
    rate_p = safe_div(F.coalesce("pp_p", F.lit(0)), "n_p")
    rate_u = safe_div(F.coalesce("pp_u", F.lit(0)), "n_u")
    tpr_p = safe_div("tp_p", F.col("tp_p") + F.col("fn_p"))
    tpr_u = safe_div("tp_u", F.col("tp_u") + F.col("fn_u"))
    return [(rate_p - rate_u).alias("dpd"), (tpr_p - tpr_u).alias("eod"),
            F.when(rate_p > 0, rate_u / rate_p).otherwise(0.0).alias("dir")]


def binary_fairness(pred: DataFrame, attribute: str, privileged: str) -> DataFrame:
    """Privileged group against ALL other rows pooled (nulls count as other).

    One global aggregation per model with conditional sums; distinct from
    the worst-pair metrics of ``pairwise``.
    """
    a = pred.groupBy("model").agg(*binary_counts(attribute, privileged))
    return a.select("model", F.lit(attribute).alias("attribute"), *binary_metrics())


def compare_models(summary_df: DataFrame) -> DataFrame:
    """One row per (model, attribute) with the worst values."""
    return summary_df.select("model", "attribute", "worst_dpd", "worst_eod", "worst_dir", "is_biased")
