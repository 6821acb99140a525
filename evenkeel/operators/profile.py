"""Table profile (A9-A12): missing values, value shares, favourable rates.

Each profile is one scan: per-column null counts are one global
aggregate; value distributions unpivot the columns and aggregate
partially before the shuffle; totals come from small windows over the
aggregated table (never a window over raw rows, never a cross join).
"""

from __future__ import annotations

from typing import Any, Mapping, Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.scalar import binarize, is_missing, privileged_lookup, safe_div


def missing_profile(df: DataFrame, columns: Optional[Sequence[str]] = None) -> DataFrame:
    """Nulls (and NaN) and percent missing per column."""
    cols = list(columns or df.columns)
    a = df.agg(F.count(F.lit(1)).alias("_rows"),
               *[F.count_if(is_missing(df, c)).alias(c) for c in cols])
    long = a.unpivot(["_rows"], cols, "column", "n_missing")
    return long.select("column", F.col("n_missing").cast("long").alias("n_missing"),
                       (100.0 * safe_div("n_missing", "_rows")).alias("pct_missing"))


def value_distribution(df: DataFrame, columns: Sequence[str],
                       privileged: Optional[Mapping[str, str]] = None) -> DataFrame:
    """A10: count and percent (of all rows, nulls included) per value.

    The denominator is the table's row count, the same for every column: a
    fitted scalar from one narrow aggregate. The counts are one unpivot +
    partially aggregated ``groupBy``; no window spans a column's values.
    """
    cols = list(columns)
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value").where(F.col("value").isNotNull())
    g = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    priv = privileged_lookup(F.col("column"), privileged)
    return g.select("column", "value", "n", (100.0 * F.col("n") / F.lit(float(total or 1))).alias("pct"),
                    F.when(priv.isNotNull(), F.col("value") == priv).alias("is_privileged"))


def favourable_rate(df: DataFrame, target: str, positive: Any, attributes: Sequence[str],
                    signal_gap: float = 0.10) -> DataFrame:
    """Positive-outcome rate per group against the overall rate.

    The outcome is always ``target == positive`` (also for numeric targets).
    The overall rate covers every row (null groups included), the same for
    every attribute: a fitted scalar from one narrow aggregate.
    """
    cols = list(attributes)
    y = binarize(target, positive)
    o = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p")).first()
    overall = F.lit(float(o["p"] or 0) / float(o["n"] or 1))
    long = df.select(y.alias("_y"), *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        ["_y"], cols, "attribute", "group").where(F.col("group").isNotNull())
    g = long.groupBy("attribute", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_pos"))
    rate = F.col("_pos") / F.col("n")
    return g.select("attribute", "group", "n", rate.alias("rate"), overall.alias("overall_rate"),
                    F.abs(rate - overall).alias("gap"), (F.abs(rate - overall) > signal_gap).alias("bias_signal"))


def dataset_summary(df: DataFrame, target: str, positive: Any) -> DataFrame:
    """Rows, feature count, missing cells, positive rate (one scan)."""
    cols = df.columns
    missing = sum((F.count_if(is_missing(df, c)) for c in cols), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(cols) - 1).cast("long").alias("n_features"),
        missing.cast("long").alias("missing_cells"),
        F.avg(binarize(target, positive).cast("double")).alias("positive_rate"))


def mean_of_group_rates(group_stats: DataFrame) -> DataFrame:
    """Unweighted mean of the non-privileged groups' positive rates.

    Also carries the privileged group's rate (chart R4 input).
    """
    from evenkeel.operators.audit import privileged_groups
    priv = privileged_groups(group_stats)
    j = group_stats.join(priv, ["model", "attribute"])
    is_p = F.col("group") == F.col("privileged_group")
    return j.groupBy("model", "attribute").agg(
        F.max(F.when(is_p, F.col("pos_pred_rate"))).alias("privileged_rate"),
        F.avg(F.when(~is_p, F.col("pos_pred_rate"))).alias("mean_of_group_rates"))
