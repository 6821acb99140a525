"""Model-side operators on given rules and weights, so that SQL can check them.

Fitted models have no SQL form; the operators that read them do, once the
weights, the predictions or the fills are given.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import audit, detect, explain, prepare, report, strategies
from evenkeel.plans.common import report_round
from evenkeel.plans.detect_queries import ORDER_SENS, _chi2_sql
from evenkeel.plans.oracle_views import LINE_AUDIT, LINE_NULLS, ORDER_AUDIT, ORDER_DETECT, ORDER_LONG, with_views
from evenkeel.sources import views

WEIGHTS = {"balance": 0.4, "finished": -1.2, "urgent": 0.7}
#: Rule-based predictions in the place of fitted strategies.
RULES = {"baseline": "acctbal", "reweighing": "priority", "thresholds": "status_f"}


def _features(spark: SparkSession, sf: str) -> DataFrame:
    d = views.order_audit(spark, sf).df
    x = F.array((F.col("c_acctbal") / 1000).cast("double"), (F.col("o_orderstatus") == "F").cast("double"),
                (F.col("o_orderpriority") == "1-URGENT").cast("double"))
    return d.select("row_id", "c_mktsegment", array_to_vector(x).alias("features"))


def _attribution(spark: SparkSession, sf: str) -> DataFrame:
    d = _features(spark, sf)
    return explain.weighted_attribution(list(WEIGHTS.values()), d, d, list(WEIGHTS), ["row_id", "c_mktsegment"])


def q_weighted_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """E3 with given weights."""
    return report_round(_attribution(spark, sf))


def q_weighted_mean_abs(spark: SparkSession, sf: str) -> DataFrame:
    """A29 + W3 over the given weights."""
    return report_round(explain.mean_abs_attribution(_attribution(spark, sf)))


def q_weighted_group_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """A30 + P16 over the given weights."""
    return report_round(explain.group_attribution(_attribution(spark, sf), "c_mktsegment", "BUILDING"))


def q_weighted_top_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    """W5 over the given weights (a top-2 report)."""
    g = explain.group_attribution(_attribution(spark, sf), "c_mktsegment", "BUILDING")
    return report_round(explain.top_by_total_magnitude(g, 2))


def _rule_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = views.order_audit(spark, sf).df
    rows = [strategies.evaluate(d.withColumn("y_pred", F.col(f"pred_{rule}")), "c_mktsegment", "BUILDING", name)
            for name, rule in RULES.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def q_rule_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics row of each strategy (A8, A25, A26) for given predictions."""
    return report_round(_rule_rows(spark, sf).drop("error", "detail"))


def q_rule_before_after(spark: SparkSession, sf: str) -> DataFrame:
    """R3 + P17 for given predictions."""
    return report_round(report.before_after(_rule_rows(spark, sf)))


def q_rule_recommended(spark: SparkSession, sf: str) -> DataFrame:
    """W7 for given predictions."""
    return report_round(report.recommended(_rule_rows(spark, sf)))


def q_attached_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """J2 + A1: predictions by id, joined to their sensitive columns, counted."""
    d = views.order_audit(spark, sf).df
    pred = d.select("row_id", "y_true", F.col("pred_acctbal").alias("y_pred"))
    joined = audit.attach_attributes(pred, d.select("row_id", "c_mktsegment", "r_name"))
    return joined.groupBy("c_mktsegment", "r_name", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def q_imputed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """M1 applied: fills counted with the values around them."""
    d = views.line_nulls(spark, sf)
    out = prepare.Imputer.fit(d, ["l_returnflag"], ["l_tax"]).transform(d)
    return report_round(out.groupBy("l_returnflag", "l_tax").agg(F.count(F.lit(1)).alias("n")))


def q_scaled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """M4 applied: the scaled column of every order."""
    d = views.order_audit(spark, sf).df
    s = prepare.Scaler.fit(d, ["c_acctbal"])
    return report_round(d.select("row_id", *s.columns()))


def q_ranked_flags(spark: SparkSession, sf: str) -> DataFrame:
    """W9 over the flagged features of the orders."""
    r = detect.full_detection(views.order_detect(spark, sf), "y_true", 1, ORDER_SENS)
    return report.rank_flagged(r["flagged_features"]).select("feature", "methods_flagged", "confidence")


_X = [("balance", "c_acctbal / 1000"), ("finished", "CAST(o_orderstatus = 'F' AS DOUBLE)"),
      ("urgent", "CAST(o_orderpriority = '1-URGENT' AS DOUBLE)")]
_ATTR = with_views(ORDER_AUDIT) + """,
phi AS (""" + "\n  UNION ALL ".join(
    f"SELECT row_id, c_mktsegment, '{n}' AS feature, {WEIGHTS[n]}::DOUBLE * (({x})::DOUBLE - avg(({x})::DOUBLE) OVER ()) AS phi "
    "FROM order_audit" for n, x in _X) + """),
grp AS (
  SELECT feature, avg(CASE WHEN coalesce(c_mktsegment = 'BUILDING', false) THEN phi END) AS p,
         avg(CASE WHEN NOT coalesce(c_mktsegment = 'BUILDING', false) THEN phi END) AS u FROM phi GROUP BY feature)"""
_GROUP = """SELECT feature, round(p, 6) AS shap_privileged, round(u, 6) AS shap_unprivileged,
  round(p - u, 6) AS shap_difference, round(abs(p - u), 6) AS abs_difference,
  CASE WHEN p - u > 0 THEN 'Favors Privileged' ELSE 'Favors Unprivileged' END AS direction"""

_RULE_SQL = with_views(ORDER_AUDIT, ORDER_LONG) + """,
named AS (SELECT *, CASE model """ + " ".join(f"WHEN '{m}' THEN '{s}'" for s, m in RULES.items()) + """ END AS strategy,
  coalesce(c_mktsegment = 'BUILDING', false) AS priv FROM order_long),
d AS (SELECT strategy, score, sum(y_true)::DOUBLE AS p_s, sum(1 - y_true)::DOUBLE AS n_s FROM named GROUP BY ALL),
u AS (SELECT strategy, sum(p_s * (coalesce(below, 0) + n_s / 2)) / (sum(p_s) * sum(n_s)) AS roc_auc
      FROM (SELECT *, sum(n_s) OVER (PARTITION BY strategy ORDER BY score
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM d) t GROUP BY strategy),
c AS (
  SELECT strategy, avg(CAST(y_pred = y_true AS INTEGER)) AS accuracy,
    count_if(y_pred = 1 AND y_true = 1) AS tp, count_if(y_pred <> y_true) AS wrong,
    avg(y_pred) FILTER (priv) AS rp, avg(y_pred) FILTER (NOT priv) AS ru,
    avg(y_pred) FILTER (priv AND y_true = 1) AS tprp, avg(y_pred) FILTER (NOT priv AND y_true = 1) AS tpru
  FROM named GROUP BY strategy),
rows AS (
  SELECT strategy, accuracy, 2 * tp / (2 * tp + wrong) AS f1, roc_auc, rp - ru AS dpd, tprp - tpru AS eod,
    CASE WHEN rp > 0 THEN ru / rp ELSE 0.0 END AS dir FROM c JOIN u USING (strategy))"""

_CAT = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name", "r_name"]
_FLAG_SQL = with_views(ORDER_AUDIT, ORDER_DETECT) + """,
m AS (""" + "\n  UNION ALL ".join(
    f"SELECT CAST(y_true AS VARCHAR) AS cls, y_true AS y, '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'MISSING') AS value, "
    f"{c} IS NULL AS missing FROM order_detect" for c in _CAT) + "),{chi},\n" + """
-- 5 % critical value: cube form of the chi-squared quantile, exact for one degree of freedom
assoc AS (
  SELECT feature, v AS statistic, v >= 0.15 AND chi2 > CASE WHEN dof = 1 THEN 3.841459 ELSE
    dof * pow(1 - 2 / (9 * dof) + 1.644854 * sqrt(2 / (9 * dof)), 3) END AS flagged FROM vv
  UNION ALL
  SELECT 'c_acctbal', abs(r), abs(r) >= 0.15 AND abs(r) * sqrt((n - 2) / (1 - r * r)) > 1.959964 * (1 + 1.2104 / (n - 2))
  FROM (SELECT corr(CAST(c_acctbal AS DOUBLE), CAST(y_true AS DOUBLE)) AS r, count(c_acctbal) AS n FROM order_detect) t),
px0 AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{f}' AS f, '{s}' AS s, coalesce(CAST({f} AS VARCHAR), 'MISSING') AS a, coalesce(CAST({s} AS VARCHAR), 'MISSING') AS b "
    "FROM order_detect" for f in _CAT if f not in ORDER_SENS for s in ORDER_SENS) + """),
px1 AS (SELECT f, s, a, b, count(*) AS n FROM px0 GROUP BY ALL),
px2 AS (SELECT *, sum(n) OVER (PARTITION BY f, s, a) AS r, sum(n) OVER (PARTITION BY f, s, b) AS c,
               sum(n) OVER (PARTITION BY f, s) AS t FROM px1),
px AS (SELECT f AS feature, s, sqrt(greatest(sum(n * n / (r * c)) - 1, 0)
              / (least(count(DISTINCT a), count(DISTINCT b)) - 1)) AS v FROM px2 GROUP BY f, s),
g AS (SELECT feature, value, avg(y) AS rate FROM m WHERE NOT missing GROUP BY ALL HAVING count(*) >= 5),
di AS (SELECT feature, min(rate) / max(rate) AS di FROM g GROUP BY feature HAVING count(*) >= 2 AND max(rate) > 0),
why AS (
  SELECT feature, 1 AS o, format('target_corr={{:.3f}}', statistic) AS reason FROM assoc WHERE flagged
  UNION ALL SELECT feature, 2, 'proxy_for=[' || string_agg(chr(39) || s || chr(39), ', ' ORDER BY v DESC, s) || ']'
  FROM px WHERE v >= 0.20 GROUP BY feature
  UNION ALL SELECT feature, 3, format('DI={{:.3f}}', di) FROM di WHERE di < 0.80),
flags AS (
  SELECT feature, CAST(count(*) AS BIGINT) AS methods_flagged,
    CASE count(*) WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' ELSE 'High' END AS confidence,
    string_agg(reason, ' | ' ORDER BY o) AS reasons FROM why GROUP BY feature)"""
_FLAG_SQL = _FLAG_SQL.replace("{chi}", _chi2_sql("SELECT feature, value, cls, count(*) AS n FROM m GROUP BY ALL",
                                                 ["feature"])).replace("{{", "{").replace("}}", "}")

QUERIES = {
    "weighted_attribution": q_weighted_attribution,
    "weighted_mean_abs": q_weighted_mean_abs,
    "weighted_group_attribution": q_weighted_group_attribution,
    "weighted_top_magnitude": q_weighted_top_magnitude,
    "rule_strategies": q_rule_strategies,
    "rule_before_after": q_rule_before_after,
    "rule_recommended": q_rule_recommended,
    "attached_attributes": q_attached_attributes,
    "imputed_rows": q_imputed_rows,
    "scaled_rows": q_scaled_rows,
    "ranked_flags": q_ranked_flags,
}

ORACLE = {
    "weighted_attribution": _ATTR + """
SELECT row_id, c_mktsegment, feature, round(phi, 6) AS phi FROM phi""",
    "weighted_mean_abs": _ATTR + """
SELECT feature, round(m, 6) AS mean_shap, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS "rank"
FROM (SELECT feature, avg(abs(phi)) AS m FROM phi GROUP BY feature) t""",
    "weighted_group_attribution": _ATTR + _GROUP + " FROM grp",
    "weighted_top_magnitude": _ATTR + _GROUP + """, round(abs(p) + abs(u), 6) AS total_magnitude
FROM grp ORDER BY abs(p) + abs(u) DESC, feature LIMIT 2""",
    "rule_strategies": _RULE_SQL + """
SELECT strategy, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc, round(dpd, 6) AS dpd,
  round(eod, 6) AS eod, round(dir, 6) AS dir, abs(dpd) > 0.10 OR abs(eod) > 0.10 OR dir < 0.80 AS biased, 'ok' AS status
FROM rows""",
    "rule_before_after": _RULE_SQL + """
SELECT strategy, CASE strategy WHEN 'baseline' THEN 'Baseline' WHEN 'reweighing' THEN 'Reweighing' ELSE 'Thresholds' END AS label,
  round(accuracy, 6) AS accuracy, round(dir, 6) AS dir FROM rows""",
    "rule_recommended": _RULE_SQL + """
SELECT strategy, round(accuracy, 6) AS accuracy, round(dir, 6) AS dir, round(dpd, 6) AS dpd FROM rows
WHERE strategy <> 'baseline' ORDER BY 0.6 * dir + 0.4 * accuracy DESC, strategy LIMIT 1""",
    "attached_attributes": with_views(ORDER_AUDIT) + """
SELECT c_mktsegment, r_name, y_true, pred_acctbal AS y_pred, CAST(count(*) AS BIGINT) AS n FROM order_audit GROUP BY ALL""",
    "imputed_rows": with_views(LINE_AUDIT, LINE_NULLS) + """,
top AS (SELECT l_returnflag AS v FROM line_nulls WHERE l_returnflag IS NOT NULL
        GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1),
med AS (SELECT median(CAST(l_tax AS DOUBLE)) AS v FROM line_nulls)
SELECT coalesce(l_returnflag, (SELECT v FROM top)) AS l_returnflag,
  round(coalesce(CAST(l_tax AS DOUBLE), (SELECT v FROM med)), 6) AS l_tax, CAST(count(*) AS BIGINT) AS n
FROM line_nulls GROUP BY ALL""",
    "scaled_rows": with_views(ORDER_AUDIT) + """
SELECT row_id, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM order_audit""",
    "ranked_flags": _FLAG_SQL + """
SELECT feature, methods_flagged, confidence FROM flags""",
    "flagged_features": _FLAG_SQL + """
SELECT * FROM flags""",
    "detection_summary": _FLAG_SQL + """
SELECT CAST(6 AS BIGINT) AS total_features_scanned, CAST(count(*) AS BIGINT) AS features_flagged,
  CAST(count_if(methods_flagged = 3) AS BIGINT) AS high_confidence, CAST(count_if(methods_flagged = 2) AS BIGINT) AS medium_confidence,
  CAST(count_if(methods_flagged = 1) AS BIGINT) AS low_confidence FROM flags""",
}
