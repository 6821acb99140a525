"""Registered reweighing / threshold / preparation queries with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import mitigate, prepare
from evenkeel.plans.common import report_round
from evenkeel.plans.oracle_views import LINE_AUDIT, LINE_NULLS, ORDER_AUDIT, with_views
from evenkeel.sources import views


def q_reweighing_weights(spark: SparkSession, sf: str) -> DataFrame:
    d = views.order_audit(spark, sf).df
    return report_round(mitigate.reweighing_weights(d, "c_mktsegment", "BUILDING"))


def q_weighted_rates(spark: SparkSession, sf: str) -> DataFrame:
    d = views.order_audit(spark, sf).df
    w = mitigate.reweighing_weights(d, "c_mktsegment", "BUILDING")
    a = mitigate.apply_weights(d, w, "c_mktsegment", "BUILDING")
    g = a.groupBy(mitigate.is_privileged("c_mktsegment", "BUILDING").alias("is_priv")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("sum_weight"),
        (F.sum(F.col("weight") * F.col("y_true")) / F.sum("weight")).alias("weighted_pos_rate"))
    return report_round(g)


def q_threshold_tpr_curve(spark: SparkSession, sf: str) -> DataFrame:
    d = views.order_audit(spark, sf).df
    return report_round(mitigate.tpr_curve(d, "c_mktsegment").drop("i"))


def q_group_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    d = views.order_audit(spark, sf).df
    return report_round(mitigate.group_thresholds(d, "c_mktsegment", "BUILDING"))


def q_threshold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    d = views.order_audit(spark, sf).df
    t = mitigate.group_thresholds(d, "c_mktsegment", "BUILDING")
    a = mitigate.apply_thresholds(d, t, "c_mktsegment")
    return report_round(a.select("row_id", "c_mktsegment", "score", "threshold", "y_pred"))


def q_impute_mode_median(spark: SparkSession, sf: str) -> DataFrame:
    d = views.line_nulls(spark, sf)
    imp = prepare.Imputer.fit(d, ["l_returnflag", "l_linestatus"], ["l_tax", "l_quantity"])
    return imp.table(spark)


def q_standardise(spark: SparkSession, sf: str) -> DataFrame:
    d = views.line_nulls(spark, sf)
    return report_round(prepare.Scaler.fit(d, ["l_quantity", "l_extendedprice", "l_tax"]).table(spark))


def q_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Ones per dummy, summed from the assembled feature vector (one vector
    aggregate instead of one sum per dummy column)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer
    d = views.line_nulls(spark, sf)
    oh = prepare.OneHot.fit(d, ["l_linestatus", "p_brand", "p_size"])
    names = oh.names()
    vec = VectorAssembler(inputCols=oh.vector_names(), outputCol="features").transform(oh.encode(d, []))
    tot = vec.select(Summarizer.sum(F.col("features")).alias("s")).select(vector_to_array("s").alias("s"))
    label = F.array(*[F.lit(n) for n in names])
    return tot.select(F.posexplode("s").alias("pos", "n_ones")).select(
        F.element_at(label, F.col("pos") + 1).alias("feature"), F.col("n_ones").cast("long").alias("n_ones"))


def q_stratified_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = views.line_audit(spark, sf).df
    s = prepare.stratified_split(d, "y_true", ["l_orderkey", "l_linenumber", "l_quantity",
                                              "l_extendedprice", "l_discount", "l_tax",
                                              "l_linestatus", "l_returnflag", "p_type", "p_brand"])
    return s.groupBy("y_true", "is_test").agg(F.count(F.lit(1)).alias("n"))


W_SQL = with_views(ORDER_AUDIT) + """,
c AS (SELECT coalesce(c_mktsegment = 'BUILDING', false) AS is_priv, y_true AS y, count(*) AS n
      FROM order_audit GROUP BY ALL),
w AS (SELECT is_priv, y, n,
        (sum(n) OVER (PARTITION BY is_priv) / sum(n) OVER ()) * (sum(n) OVER (PARTITION BY y) / sum(n) OVER ())
        / greatest(n / sum(n) OVER (), 1e-8) AS weight FROM c)"""

REWEIGH_SQL = W_SQL + """
SELECT is_priv, y, CAST(n AS BIGINT) AS n, round(weight, 6) AS weight FROM w"""

WRATES_SQL = W_SQL + """
SELECT a.is_priv, CAST(count(*) AS BIGINT) AS n, round(sum(w.weight), 6) AS sum_weight,
       round(sum(w.weight * a.y_true) / sum(w.weight), 6) AS weighted_pos_rate
FROM (SELECT coalesce(c_mktsegment = 'BUILDING', false) AS is_priv, y_true FROM order_audit) a
JOIN w ON a.is_priv = w.is_priv AND a.y_true = w.y GROUP BY a.is_priv"""

CURVE_SQL = with_views(ORDER_AUDIT) + """,
grid AS (SELECT unnest(range(10, 91)) AS i),
grp AS (SELECT CAST(c_mktsegment AS VARCHAR) AS grp, count_if(y_true = 1) AS n_pos FROM order_audit GROUP BY 1),
curve AS (
  SELECT g.grp, gr.i, g.n_pos,
         (SELECT count(*) FROM order_audit o WHERE o.c_mktsegment = g.grp AND o.y_true = 1
            AND o.score >= gr.i / 100.0) AS tp
  FROM grp g, grid gr)"""

CURVE_Q = CURVE_SQL + """
SELECT grp AS "group", round(i / 100.0, 6) AS threshold, CAST(n_pos AS BIGINT) AS n_pos, CAST(tp AS BIGINT) AS tp,
       round(CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0.0 END, 6) AS tpr FROM curve"""

THRESH_SQL = CURVE_SQL + """,
tgt AS (SELECT coalesce((SELECT CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0.5 END FROM curve
                         WHERE grp = 'BUILDING' AND i = 50), 0.5) AS t),
c2 AS (SELECT c.*, CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0.0 END AS tpr, tgt.t AS target_tpr,
              abs(CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0.0 END - tgt.t) AS gap
       FROM curve c, tgt WHERE c.grp <> 'BUILDING'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY gap, i) AS rk FROM c2) WHERE rk = 1),
th AS (
  SELECT grp, i / 100.0 AS threshold, target_tpr, tpr, gap FROM best
  UNION ALL
  SELECT grp, 0.5, (SELECT t FROM tgt), CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0.0 END, 0.0
  FROM curve WHERE grp = 'BUILDING' AND i = 50)"""

THRESH_Q = THRESH_SQL + """
SELECT grp AS "group", round(threshold, 6) AS threshold, round(target_tpr, 6) AS target_tpr,
       round(tpr, 6) AS tpr, round(gap, 6) AS gap FROM th"""

THRESH_PRED_Q = THRESH_SQL + """
SELECT o.row_id, o.c_mktsegment, round(o.score, 6) AS score, round(th.threshold, 6) AS threshold,
       CAST(coalesce(o.score >= th.threshold, false) AS INTEGER) AS y_pred
FROM order_audit o LEFT JOIN th ON CAST(o.c_mktsegment AS VARCHAR) = th.grp"""

IMPUTE_SQL = with_views(LINE_AUDIT, LINE_NULLS) + """,
m AS (SELECT 'l_returnflag' AS col, l_returnflag AS v FROM line_nulls WHERE l_returnflag IS NOT NULL
      UNION ALL SELECT 'l_linestatus', l_linestatus FROM line_nulls WHERE l_linestatus IS NOT NULL),
c AS (SELECT col, v, count(*) AS n FROM m GROUP BY ALL),
md AS (SELECT col, v FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rk FROM c) WHERE rk = 1)
SELECT col AS "column", 'most_frequent' AS strategy, v AS fill_value FROM md
UNION ALL SELECT 'l_tax', 'median', CAST(median(l_tax) AS VARCHAR) FROM line_nulls
UNION ALL SELECT 'l_quantity', 'median', CAST(median(l_quantity) AS VARCHAR) FROM line_nulls"""

STD_SQL = with_views(LINE_AUDIT, LINE_NULLS) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, "
    f"round(CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS std FROM line_nulls"
    for c in ["l_quantity", "l_extendedprice", "l_tax"])

ONEHOT_SQL = with_views(LINE_AUDIT, LINE_NULLS) + """,
m AS (SELECT 'l_linestatus' AS col, CAST(l_linestatus AS VARCHAR) AS v, 0 AS k FROM line_nulls
      UNION ALL SELECT 'p_brand', p_brand, 0 FROM line_nulls
      UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), p_size FROM line_nulls),
c AS (SELECT col, v, k, count(*) AS n FROM m WHERE v IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY k, v) AS rk FROM c)
SELECT col || '_' || v AS feature, CAST(n AS BIGINT) AS n_ones FROM r WHERE rk > 1"""

SPLIT_SQL = with_views(LINE_AUDIT) + """,
c AS (SELECT y_true, count(*) AS n FROM line_audit GROUP BY y_true)
SELECT y_true, true AS is_test, CAST(ceil(n * 0.2 - 1e-9) AS BIGINT) AS n FROM c
UNION ALL SELECT y_true, false, CAST(n - ceil(n * 0.2 - 1e-9) AS BIGINT) FROM c"""

QUERIES = {
    "reweighing_weights": q_reweighing_weights,
    "weighted_rates": q_weighted_rates,
    "threshold_tpr_curve": q_threshold_tpr_curve,
    "group_thresholds": q_group_thresholds,
    "threshold_predictions": q_threshold_predictions,
    "impute_mode_median": q_impute_mode_median,
    "standardise": q_standardise,
    "one_hot": q_one_hot,
    "stratified_split_counts": q_stratified_split_counts,
}

ORACLE = {
    "reweighing_weights": REWEIGH_SQL,
    "weighted_rates": WRATES_SQL,
    "threshold_tpr_curve": CURVE_Q,
    "group_thresholds": THRESH_Q,
    "threshold_predictions": THRESH_PRED_Q,
    "impute_mode_median": IMPUTE_SQL,
    "standardise": STD_SQL,
    "one_hot": ONEHOT_SQL,
    "stratified_split_counts": SPLIT_SQL,
}


def q_oversample_cells(spark: SparkSession, sf: str) -> DataFrame:
    from evenkeel.operators.oversample import cell_plan
    return cell_plan(views.order_audit(spark, sf).df, "c_mktsegment", "BUILDING")


OVERSAMPLE_SQL = with_views(ORDER_AUDIT) + """,
c AS (SELECT y_true * 2 + CAST(coalesce(c_mktsegment = 'BUILDING', false) AS INTEGER) AS cell,
             y_true AS y, coalesce(c_mktsegment = 'BUILDING', false) AS is_priv, count(*) AS n
      FROM order_audit GROUP BY ALL)
SELECT cell, y, is_priv, CAST(n AS BIGINT) AS n, CAST(max(n) OVER () - n AS BIGINT) AS deficit,
       (max(n) OVER () - n = 0) OR n > 5 AS enough_neighbours FROM c"""

QUERIES["oversample_cells"] = q_oversample_cells
ORACLE["oversample_cells"] = OVERSAMPLE_SQL
