"""Registered audit queries (A1-A8, A25, A26) with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.operators import audit, metrics
from evenkeel.plans.common import report_round, sql_melt
from evenkeel.plans.oracle_views import (DOC_AUDIT, DOC_LONG, ORDER_AUDIT, ORDER_LONG,
                                         with_views)
from evenkeel.sources import views

ORDER_ATTRS = ["c_mktsegment", "r_name", "o_orderstatus"]
DOC_ATTRS = ["lang", "source"]


def q_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    v = views.order_audit(spark, sf)
    return report_round(audit.group_stats(v.long(), v.attributes, v.privileged))


def q_pairwise_fairness(spark: SparkSession, sf: str) -> DataFrame:
    v = views.order_audit(spark, sf)
    return report_round(audit.pairwise(audit.group_stats(v.long(), v.attributes, v.privileged)))


def q_audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = views.order_audit(spark, sf)
    return report_round(audit.summary(audit.group_stats(v.long(), v.attributes, v.privileged)))


def q_privileged_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """doc view: 'source' has no privileged value, so the fallback picks it."""
    v = views.doc_audit(spark, sf)
    return report_round(audit.summary(audit.group_stats(v.long(), v.attributes, v.privileged)))


def q_binary_fairness(spark: SparkSession, sf: str) -> DataFrame:
    v = views.order_audit(spark, sf)
    return report_round(audit.binary_fairness(v.long(), "c_mktsegment", "BUILDING"))


def q_model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    v = views.order_audit(spark, sf)
    return report_round(metrics.model_metrics(v.long()))


def q_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    v = views.doc_audit(spark, sf)
    return report_round(metrics.roc_auc(v.long()))


def _gs_sql(views_sql: str, long: str, attrs: list[str], priv: dict) -> str:
    priv_case = " ".join(f"WHEN attribute = '{a}' THEN grp = '{p}'" for a, p in priv.items())
    priv_expr = f"CASE {priv_case} END" if priv else "CAST(NULL AS BOOLEAN)"
    return f"""{views_sql},
melted AS (
  {sql_melt(long, ['model', 'y_true', 'y_pred'], attrs)}
),
agg AS (
  SELECT model, attribute, grp, count(*) AS n, sum(y_true) AS npt, sum(y_pred) AS npp,
         count_if(y_pred = 1 AND y_true = 1) AS tp, count_if(y_pred = 1 AND y_true = 0) AS fp,
         count_if(y_pred = 0 AND y_true = 0) AS tn, count_if(y_pred = 0 AND y_true = 1) AS fn
  FROM melted WHERE grp IS NOT NULL GROUP BY model, attribute, grp
),
gs AS (
  SELECT model, attribute, grp, CAST(n AS BIGINT) AS n,
         CAST(npt AS BIGINT) AS n_positive_true, CAST(npp AS BIGINT) AS n_predicted_pos,
         CASE WHEN n > 0 THEN npp / n ELSE 0.0 END AS pos_pred_rate,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS true_pos_rate,
         CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS false_pos_rate,
         CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END AS accuracy,
         CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
         CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
         {priv_expr} AS is_privileged
  FROM agg
),
priv AS (
  SELECT model, attribute, grp AS privileged_group, pos_pred_rate AS ppr_p, true_pos_rate AS tpr_p
  FROM (SELECT *, row_number() OVER (PARTITION BY model, attribute
          ORDER BY coalesce(is_privileged, false) DESC, pos_pred_rate DESC, grp) AS rk FROM gs) t
  WHERE rk = 1
),
pw AS (
  SELECT g.model, g.attribute, p.privileged_group, g.grp,
         p.ppr_p - g.pos_pred_rate AS dpd, p.tpr_p - g.true_pos_rate AS eod,
         CASE WHEN p.ppr_p > 0 THEN g.pos_pred_rate / p.ppr_p ELSE 0.0 END AS dir
  FROM gs g JOIN priv p ON g.model = p.model AND g.attribute = p.attribute
  WHERE g.grp <> p.privileged_group
),
worst AS (
  SELECT model, attribute,
         max(CASE WHEN rd = 1 THEN dpd END) AS wdpd, max(CASE WHEN re = 1 THEN eod END) AS weod,
         min(dir) AS wdir
  FROM (SELECT *,
          row_number() OVER (PARTITION BY model, attribute ORDER BY abs(dpd) DESC, grp) AS rd,
          row_number() OVER (PARTITION BY model, attribute ORDER BY abs(eod) DESC, grp) AS re
        FROM pw) t
  GROUP BY model, attribute
),
sm AS (
  SELECT p.model, p.attribute, p.privileged_group, CAST(t.n AS BIGINT) AS n,
         t.npp / t.n AS overall_pos_rate,
         coalesce(w.wdpd, 0.0) + 0.0 AS worst_dpd, coalesce(w.weod, 0.0) + 0.0 AS worst_eod,
         least(coalesce(w.wdir, 1.0), 1.0) AS worst_dir
  FROM priv p JOIN (SELECT model, attribute, sum(n) AS n, sum(n_predicted_pos) AS npp FROM gs
                    GROUP BY model, attribute) t ON p.model = t.model AND p.attribute = t.attribute
  LEFT JOIN worst w ON p.model = w.model AND p.attribute = w.attribute
)"""


def _gs_select() -> str:
    return """
SELECT model, attribute, grp AS "group", n, n_positive_true, n_predicted_pos,
       round(pos_pred_rate, 6) AS pos_pred_rate, round(true_pos_rate, 6) AS true_pos_rate,
       round(false_pos_rate, 6) AS false_pos_rate, round(accuracy, 6) AS accuracy,
       tp, fp, tn, fn, is_privileged FROM gs"""


def _pw_select() -> str:
    return """
SELECT model, attribute, privileged_group, grp AS "group", round(dpd, 6) AS dpd,
       round(eod, 6) AS eod, round(dir, 6) AS dir, abs(dpd) > 0.10 AS dpd_biased,
       abs(eod) > 0.10 AS eod_biased, dir < 0.80 AS dir_biased,
       abs(dpd) > 0.10 OR abs(eod) > 0.10 OR dir < 0.80 AS any_bias FROM pw"""


def _sm_select() -> str:
    return """
SELECT model, attribute, privileged_group, n, round(overall_pos_rate, 6) AS overall_pos_rate,
       round(worst_dpd, 6) AS worst_dpd, round(worst_eod, 6) AS worst_eod,
       round(worst_dir, 6) AS worst_dir,
       abs(worst_dpd) > 0.10 OR abs(worst_eod) > 0.10 OR worst_dir < 0.80 AS is_biased FROM sm"""


ORDER_GS = _gs_sql(with_views(ORDER_AUDIT, ORDER_LONG), "order_long", ORDER_ATTRS,
                   {"c_mktsegment": "BUILDING"})
DOC_GS = _gs_sql(with_views(DOC_AUDIT, DOC_LONG), "doc_long", DOC_ATTRS, {"lang": "en"})

BINARY_SQL = with_views(ORDER_AUDIT, ORDER_LONG) + """,
a AS (
  SELECT model,
    count_if(coalesce(c_mktsegment = 'BUILDING', false)) AS n_p,
    count_if(NOT coalesce(c_mktsegment = 'BUILDING', false)) AS n_u,
    sum(CASE WHEN coalesce(c_mktsegment = 'BUILDING', false) THEN y_pred END) AS pp_p,
    sum(CASE WHEN NOT coalesce(c_mktsegment = 'BUILDING', false) THEN y_pred END) AS pp_u,
    count_if(coalesce(c_mktsegment = 'BUILDING', false) AND y_pred = 1 AND y_true = 1) AS tp_p,
    count_if(coalesce(c_mktsegment = 'BUILDING', false) AND y_pred = 0 AND y_true = 1) AS fn_p,
    count_if(NOT coalesce(c_mktsegment = 'BUILDING', false) AND y_pred = 1 AND y_true = 1) AS tp_u,
    count_if(NOT coalesce(c_mktsegment = 'BUILDING', false) AND y_pred = 0 AND y_true = 1) AS fn_u
  FROM order_long GROUP BY model
),
r AS (
  SELECT model,
    CASE WHEN n_p > 0 THEN coalesce(pp_p, 0) / n_p ELSE 0.0 END AS rp,
    CASE WHEN n_u > 0 THEN coalesce(pp_u, 0) / n_u ELSE 0.0 END AS ru,
    CASE WHEN tp_p + fn_p > 0 THEN tp_p / (tp_p + fn_p) ELSE 0.0 END AS tprp,
    CASE WHEN tp_u + fn_u > 0 THEN tp_u / (tp_u + fn_u) ELSE 0.0 END AS tpru
  FROM a
)
SELECT model, 'c_mktsegment' AS attribute, round(rp - ru, 6) AS dpd, round(tprp - tpru, 6) AS eod,
       round(CASE WHEN rp > 0 THEN ru / rp ELSE 0.0 END, 6) AS dir FROM r"""

METRICS_SQL = with_views(ORDER_AUDIT, ORDER_LONG) + """,
c AS (
  SELECT model, count_if(y_pred = 1 AND y_true = 1) AS tp, count_if(y_pred = 1 AND y_true = 0) AS fp,
         count_if(y_pred = 0 AND y_true = 0) AS tn, count_if(y_pred = 0 AND y_true = 1) AS fn
  FROM order_long GROUP BY model
),
d AS (
  SELECT model, score, sum(y_true)::DOUBLE AS p_s, sum(1 - y_true)::DOUBLE AS n_s
  FROM order_long GROUP BY model, score
),
u AS (
  SELECT model, sum(p_s * (coalesce(below, 0) + n_s / 2)) AS u, sum(p_s) AS P, sum(n_s) AS N
  FROM (SELECT *, sum(n_s) OVER (PARTITION BY model ORDER BY score
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM d) t
  GROUP BY model
)
SELECT c.model, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn,
       CAST(fn AS BIGINT) AS fn,
       round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0.0 END, 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
       round(CASE WHEN P > 0 AND N > 0 THEN u / (P * N) END, 6) AS roc_auc
FROM c LEFT JOIN u ON c.model = u.model"""

AUC_SQL = with_views(DOC_AUDIT, DOC_LONG) + """,
d AS (
  SELECT model, score, sum(y_true)::DOUBLE AS p_s, sum(1 - y_true)::DOUBLE AS n_s
  FROM doc_long WHERE score IS NOT NULL GROUP BY model, score
),
u AS (
  SELECT model, sum(p_s * (coalesce(below, 0) + n_s / 2)) AS u, sum(p_s) AS P, sum(n_s) AS N
  FROM (SELECT *, sum(n_s) OVER (PARTITION BY model ORDER BY score
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM d) t
  GROUP BY model
)
SELECT model, round(CASE WHEN P > 0 AND N > 0 THEN u / (P * N) END, 6) AS roc_auc FROM u"""

QUERIES = {
    "group_stats": q_group_stats,
    "pairwise_fairness": q_pairwise_fairness,
    "audit_summary": q_audit_summary,
    "privileged_fallback": q_privileged_fallback,
    "binary_fairness": q_binary_fairness,
    "model_metrics": q_model_metrics,
    "roc_auc": q_roc_auc,
}

ORACLE = {
    "group_stats": ORDER_GS + _gs_select(),
    "pairwise_fairness": ORDER_GS + _pw_select(),
    "audit_summary": ORDER_GS + _sm_select(),
    "privileged_fallback": DOC_GS + _sm_select(),
    "binary_fairness": BINARY_SQL,
    "model_metrics": METRICS_SQL,
    "roc_auc": AUC_SQL,
}


def q_event_audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Group audit of the events view (4 user buckets, no privileged value:
    the highest-rate bucket is taken)."""
    v = views.event_audit(spark, sf)
    return report_round(audit.summary(audit.group_stats(v.long(), v.attributes, v.privileged)))


def q_event_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    v = views.event_audit(spark, sf)
    return report_round(audit.group_stats(v.long(), v.attributes, v.privileged))


from evenkeel.plans.oracle_views import EVENT_AUDIT, EVENT_LONG  # noqa: E402

EVENT_GS = _gs_sql(with_views(EVENT_AUDIT, EVENT_LONG), "event_long", ["user_bucket"], {})
QUERIES["event_group_stats"] = q_event_group_stats
QUERIES["event_audit_summary"] = q_event_audit_summary
ORACLE["event_group_stats"] = EVENT_GS + _gs_select()
ORACLE["event_audit_summary"] = EVENT_GS + _sm_select()
