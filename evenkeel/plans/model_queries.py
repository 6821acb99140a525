"""Registered queries that fit models (rows-only checks) and report tables
over the rule-based models (SQL oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import audit, detect, explain, metrics, models, prepare, report, strategies
from evenkeel.plans.audit_queries import ORDER_GS
from evenkeel.plans.common import report_round
from evenkeel.plans.oracle_views import ORDER_AUDIT, with_views
from evenkeel.session import written
from evenkeel.sources import views
from evenkeel.spec import AuditSpec

ORDER_SPEC = AuditSpec(
    target="y_true", positive=1, sensitive=["c_mktsegment"], privileged={"c_mktsegment": "BUILDING"},
    categorical=["c_mktsegment", "o_orderstatus", "o_orderpriority", "r_name"],
    continuous=["c_acctbal"], row_id="row_id")

DOC_SPEC = AuditSpec(
    target="y_true", positive=1, sensitive=["lang"], privileged={"lang": "en"},
    categorical=["lang", "source"], continuous=["n_chars", "toxic"], row_id="row_id")


def _order_prepared(spark: SparkSession, sf: str) -> prepare.Prepared:
    d = views.order_audit(spark, sf).df.select(
        "row_id", "y_true", "c_mktsegment", "o_orderstatus", "o_orderpriority", "r_name", "c_acctbal")
    return prepare.prepare(d, ORDER_SPEC)


def _order_context(spark: SparkSession, sf: str) -> strategies.Context:
    p = _order_prepared(spark, sf)
    return strategies.Context(p.train, p.test, "c_mktsegment", "BUILDING", ["row_id", "y_true", "c_mktsegment"],
                              layout=p.layout)


def _doc_prepared(spark: SparkSession, sf: str) -> prepare.Prepared:
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars", "lang", "source")
    d = labels.join(docs, "doc_id").select(F.col("doc_id").alias("row_id"),
                                           F.col("quality").alias("y_true"), "toxic", "n_chars",
                                           "lang", "source")
    return prepare.prepare(d, DOC_SPEC)


def q_train_audit(spark: SparkSession, sf: str) -> DataFrame:
    """M7-M10 then A1-A4: fairness summary of three fitted models on test rows."""
    p = _doc_prepared(spark, sf)
    res = models.train_all(p.train, p.test, ["row_id", "y_true", "lang"])
    s = audit.summary(audit.group_stats(res.predictions, ["lang"], {"lang": "en"}))
    return report_round(s.join(res.metrics.select("model", "accuracy", "f1", "roc_auc"), "model"))


def q_mitigation_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline, resampling, reweighing, fair classifier, thresholds."""
    ctx = _order_context(spark, sf)
    return report_round(strategies.run_all(ctx))


def q_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    p = _order_prepared(spark, sf)
    m, _ = models.fit("logistic_regression", p.train)
    return report_round(explain.feature_importance(m, p.feature_names, spark=spark))


def _linear_attr(spark: SparkSession, sf: str):
    p = _order_prepared(spark, sf)
    m, _ = models.fit("logistic_regression", p.train)
    return explain.linear_attribution(m, p.test, p.train, p.feature_names, ["row_id", "c_mktsegment"])


def q_linear_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return report_round(_linear_attr(spark, sf))


def q_mean_abs_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return report_round(explain.mean_abs_attribution(_linear_attr(spark, sf)))


def q_group_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return report_round(explain.group_attribution(_linear_attr(spark, sf), "c_mktsegment", "BUILDING"))


def q_recommended(spark: SparkSession, sf: str) -> DataFrame:
    ctx = _order_context(spark, sf)
    return report_round(report.recommended(strategies.run_all(ctx)))


# ---- report tables over the rule-based order models (SQL oracles) ----

def _order_tables(spark: SparkSession, sf: str):
    v = views.order_audit(spark, sf)
    long = v.long()
    gs = audit.group_stats(long, v.attributes, v.privileged)
    return gs, audit.summary(gs), metrics.model_metrics(long)


def q_accuracy_vs_fairness(spark: SparkSession, sf: str) -> DataFrame:
    gs, sm, mm = _order_tables(spark, sf)
    return report_round(report.accuracy_vs_fairness(mm, sm, "c_mktsegment"))


def q_bias_matrix(spark: SparkSession, sf: str) -> DataFrame:
    gs, sm, mm = _order_tables(spark, sf)
    return report_round(report.bias_matrix(sm))


def q_group_rate_means(spark: SparkSession, sf: str) -> DataFrame:
    from evenkeel.operators.profile import mean_of_group_rates
    gs, sm, mm = _order_tables(spark, sf)
    return report_round(mean_of_group_rates(gs))


def q_multi_model_table(spark: SparkSession, sf: str) -> DataFrame:
    gs, sm, mm = _order_tables(spark, sf)
    return report_round(report.multi_model_table(mm, sm, "c_mktsegment"))


def q_audit_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    gs, sm, mm = _order_tables(spark, sf)
    return report_round(report.audit_report_rows(mm, sm, "orders"))


def q_best_model(spark: SparkSession, sf: str) -> DataFrame:
    gs, sm, mm = _order_tables(spark, sf)
    return report_round(report.best_model(mm))


def q_top_proxies(spark: SparkSession, sf: str) -> DataFrame:
    d = views.order_detect(spark, sf)
    roles = detect.infer_roles(d, [c for c in d.columns if c != "y_true"])
    px = detect.proxy_scan(d, roles.categorical, ["c_mktsegment", "r_name"])
    return report_round(report.top_flagged(px, "flagged_as_proxy", "cramers_v", n=10))


_MM = """,
mc AS (
  SELECT model, count_if(y_pred = 1 AND y_true = 1) AS tp, count_if(y_pred = 1 AND y_true = 0) AS fp,
         count_if(y_pred = 0 AND y_true = 0) AS tn, count_if(y_pred = 0 AND y_true = 1) AS fn
  FROM order_long GROUP BY model),
d AS (SELECT model, score, sum(y_true)::DOUBLE AS p_s, sum(1 - y_true)::DOUBLE AS n_s
      FROM order_long GROUP BY model, score),
u AS (SELECT model, sum(p_s * (coalesce(below, 0) + n_s / 2)) AS u, sum(p_s) AS P, sum(n_s) AS N
      FROM (SELECT *, sum(n_s) OVER (PARTITION BY model ORDER BY score
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM d) t GROUP BY model),
mm AS (
  SELECT mc.model,
         (tp + tn) / (tp + fp + tn + fn) AS accuracy,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
         CASE WHEN P > 0 AND N > 0 THEN u / (P * N) END AS roc_auc
  FROM mc LEFT JOIN u ON mc.model = u.model)"""

AVF_SQL = ORDER_GS + _MM + """
SELECT mm.model, round(mm.accuracy, 6) AS accuracy, round(sm.worst_dir, 6) AS worst_dir,
       CASE WHEN sm.worst_dir >= 0.80 THEN 'fair' ELSE 'biased' END AS zone
FROM mm LEFT JOIN sm ON mm.model = sm.model AND sm.attribute = 'c_mktsegment'"""

BM_SQL = ORDER_GS + """
SELECT model, attribute, round(abs(worst_dpd), 6) AS abs_dpd, round(abs(worst_eod), 6) AS abs_eod,
       round(1.0 - least(worst_dir, 1.0), 6) AS dir_gap FROM sm"""

GRM_SQL = ORDER_GS + """
SELECT g.model, g.attribute,
       round(max(CASE WHEN g.grp = p.privileged_group THEN g.pos_pred_rate END), 6) AS privileged_rate,
       round(avg(CASE WHEN g.grp <> p.privileged_group THEN g.pos_pred_rate END), 6) AS mean_of_group_rates
FROM gs g JOIN priv p ON g.model = p.model AND g.attribute = p.attribute GROUP BY g.model, g.attribute"""

MMT_SQL = ORDER_GS + _MM + """
SELECT mm.model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc,
       round(worst_dpd, 6) AS worst_dpd, round(worst_eod, 6) AS worst_eod, round(worst_dir, 6) AS worst_dir,
       abs(worst_dpd) > 0.10 OR abs(worst_eod) > 0.10 OR worst_dir < 0.80 AS is_biased
FROM mm LEFT JOIN sm ON mm.model = sm.model AND sm.attribute = 'c_mktsegment'"""

ARR_SQL = ORDER_GS + _MM + """
SELECT sm.model, 'orders' AS dataset, attribute, round(worst_dpd, 6) AS dpd, round(worst_eod, 6) AS eod,
       round(worst_dir, 6) AS dir,
       abs(worst_dpd) > 0.10 OR abs(worst_eod) > 0.10 OR worst_dir < 0.80 AS biased,
       round(mm.accuracy, 6) AS accuracy
FROM sm LEFT JOIN mm ON sm.model = mm.model"""

BEST_SQL = ORDER_GS + _MM + """,
l AS (SELECT model, 'accuracy' AS metric, accuracy AS value FROM mm
      UNION ALL SELECT model, 'precision', precision FROM mm
      UNION ALL SELECT model, 'recall', recall FROM mm
      UNION ALL SELECT model, 'f1', f1 FROM mm
      UNION ALL SELECT model, 'roc_auc', roc_auc FROM mm)
SELECT metric, best_model, round(value, 6) AS value FROM (
  SELECT metric, model AS best_model, value,
         row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS rk
  FROM l WHERE value IS NOT NULL) WHERE rk = 1"""

QUERIES = {
    "train_audit": q_train_audit,
    "mitigation_compare": q_mitigation_compare,
    "feature_importance": q_feature_importance,
    "linear_attribution": q_linear_attribution,
    "mean_abs_attribution": q_mean_abs_attribution,
    "group_attribution": q_group_attribution,
    "recommended": q_recommended,
    "accuracy_vs_fairness": q_accuracy_vs_fairness,
    "bias_matrix": q_bias_matrix,
    "group_rate_means": q_group_rate_means,
    "multi_model_table": q_multi_model_table,
    "audit_report_rows": q_audit_report_rows,
    "best_model": q_best_model,
    "top_proxies": q_top_proxies,
}

ORACLE = {
    "accuracy_vs_fairness": AVF_SQL,
    "bias_matrix": BM_SQL,
    "group_rate_means": GRM_SQL,
    "multi_model_table": MMT_SQL,
    "audit_report_rows": ARR_SQL,
    "best_model": BEST_SQL,
}


def q_tree_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Exact TreeSHAP of a decision tree on every test row (doc view)."""
    from evenkeel.operators.treeshap import tree_attribution
    p = _doc_prepared(spark, sf)
    m, _ = models.fit("decision_tree", p.train)
    return report_round(tree_attribution(m, p.test, p.feature_names, ["row_id", "lang"]))


def q_forest_group_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """E4 + A30 on a random forest: group attribution differences by language."""
    from evenkeel.operators.treeshap import tree_attribution
    p = _doc_prepared(spark, sf)
    m, _ = models.fit("random_forest", p.train)
    attr = tree_attribution(m, p.test, p.feature_names, ["row_id", "lang"])
    return report_round(explain.group_attribution(attr, "lang", "en"))


def q_sampled_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """E5: permutation-sampling attribution of a decision tree (doc view)."""
    p = _doc_prepared(spark, sf)
    m, _ = models.fit("decision_tree", p.train)
    return report_round(explain.sampled_attribution(m, p.test, p.train, p.feature_names,
                                                    ["row_id", "lang"], "row_id"))


def q_fair_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """The reduction's metrics row (order view, c_mktsegment)."""
    from evenkeel.operators.reductions import fair_classifier
    ctx = _order_context(spark, sf)
    fit, pred, detail = fair_classifier(ctx)
    row = strategies.evaluate(pred, ctx.attribute, ctx.privileged, "fair_classifier", detail=detail)
    return report_round(row.withColumn("status", F.lit(fit.status)))


QUERIES.update({
    "tree_attribution": q_tree_attribution,
    "forest_group_attribution": q_forest_group_attribution,
    "sampled_attribution": q_sampled_attribution,
    "fair_classifier": q_fair_classifier,
})


def q_before_after(spark: SparkSession, sf: str) -> DataFrame:
    """R3 + P17: accuracy and DIR per strategy with short labels."""
    ctx = _order_context(spark, sf)
    return report_round(report.before_after(strategies.run_all(ctx)))


def q_top_attribution_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    """W5 over the linear attribution's group table."""
    g = explain.group_attribution(_linear_attr(spark, sf), "c_mktsegment", "BUILDING")
    return report_round(explain.top_by_total_magnitude(g, 10))


QUERIES.update({
    "before_after": q_before_after,
    "top_attribution_magnitude": q_top_attribution_magnitude,
})

from evenkeel.plans.detect_queries import PROXY_SQL as _PROXY_SQL  # noqa: E402

ORACLE["top_proxies"] = _PROXY_SQL.replace(
    "v >= 0.20 AS flagged_as_proxy FROM vv",
    "v >= 0.20 AS flagged_as_proxy FROM vv WHERE v >= 0.20 ORDER BY v DESC, feature LIMIT 10")


def q_tree_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """E2 for trees: impurity importance of a random forest, ranked (doc view)."""
    p = _doc_prepared(spark, sf)
    m, _ = models.fit("random_forest", p.train)
    return report_round(explain.feature_importance(m, p.feature_names, top_n=20, spark=spark))


QUERIES["tree_feature_importance"] = q_tree_feature_importance


# ---- what holds for fitted models, as rows that SQL can check ----

def q_fit_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """One row per fit; does it hold what its method promises?

    baseline, reweighing, resampling: the mean gradient at the coefficients is nil. resampling also:
    every (label, group) cell is as large as the largest. fair_classifier: the training rows keep
    the parity bound and the duality gap is closed.
    """
    from evenkeel.operators import mitigate, newton, oversample, reductions
    ctx = _order_context(spark, sf)
    n = ctx.train.count()
    base = newton.fit(ctx.train)
    weights = mitigate.reweighing_weights(ctx.train, ctx.attribute, ctx.privileged)
    weighted = newton.fit(mitigate.apply_weights(ctx.train, weights, ctx.attribute, ctx.privileged), "weight",
                          start=base.start)
    rows = written(oversample.oversample(ctx.train, ctx.attribute, ctx.privileged, ctx.key, layout=ctx.layout)
                   .select("features", "y_true", "is_priv"), "oversampled")
    sizes = [r["count"] for r in rows.groupBy("y_true", "is_priv").count().collect()]
    balanced = newton.fit(rows, start=base.start)
    fair = reductions.fit_fair(ctx.train, ctx.attribute)
    share = ctx.train.groupBy(ctx.attribute).agg(F.avg(reductions.mixture_score(fair.members)).alias("q"),
                                                 F.count(F.lit(1)).alias("n")).collect()
    mean = sum(r["q"] * r["n"] for r in share) / n
    kept = all(abs(r["q"] - mean) <= reductions.BOUND + 1e-9 for r in share)
    small = newton.TOLERANCE
    return spark.createDataFrame(
        [("baseline", n, base.gradient <= small), ("reweighing", n, weighted.gradient <= small),
         ("resampling", n, balanced.gradient <= small and len(set(sizes)) == 1),
         ("fair_classifier", n, kept and fair.gap <= reductions.GAP)], "fit string, n_rows long, holds boolean")


def q_oversampled_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(label, group) cells of all orders after oversampling, real and synthetic rows."""
    from pyspark.ml.functions import array_to_vector
    from evenkeel.operators import oversample
    d = views.order_audit(spark, sf).df
    x = F.array((F.col("c_acctbal") / 1000).cast("double"), F.col("score").cast("double"),
                *[(F.col("o_orderstatus") == s).cast("double") for s in "OP"])
    out = oversample.oversample(d.withColumn("features", array_to_vector(x)), "c_mktsegment", "BUILDING", ["row_id"],
                                layout=(2, (2,)))
    return out.groupBy("y_true", "is_priv").agg(F.count_if(~F.col("synthetic")).alias("n_real"),
                                                F.count_if("synthetic").alias("n_synthetic"))


def q_nearest_in_cell(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest orders of the same cell, by balance and status, of every order that is not
    in the largest cell; their squared distances summed per row."""
    from evenkeel.functions.scalar import compound_cell
    from evenkeel.operators.mitigate import is_privileged
    from evenkeel.operators.neighbours import nearest
    from evenkeel.operators.oversample import cell_plan
    d = views.order_audit(spark, sf).df
    short = cell_plan(d, "c_mktsegment", "BUILDING").where("deficit > 0").select(F.col("cell").cast("long"))
    status = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(0)
    rows = d.select(compound_cell(F.col("y_true"), is_privileged("c_mktsegment", "BUILDING")).cast("long").alias("cell"),
                    F.col("row_id").alias("row"), F.array(status).alias("codes"),
                    F.array((F.col("c_acctbal") / 1000).cast("double")).alias("x"), F.lit(True).alias("wanted"))
    near = nearest(written(rows.join(short, "cell", "left_semi"), "cells"), 5)
    return report_round(near.groupBy(F.col("row").alias("row_id")).agg(
        F.count(F.lit(1)).alias("n_neighbours"), F.sum("d2").alias("sum_d2"), F.max("d2").alias("fifth_d2")))


def q_full_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Groups, pairs and summary of every model and attribute of the orders in one call; per model and
    attribute, how many groups and pairs there are and the worst differences."""
    v = views.order_audit(spark, sf)
    gs, pairs, summary = audit.full_audit(v.long(), v.attributes, v.privileged)
    n_pairs = pairs.groupBy("model", "attribute").agg(F.count(F.lit(1)).alias("n_pairs"))
    n_groups = gs.groupBy("model", "attribute").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"))
    return report_round(summary.select("model", "attribute", "worst_dpd", "worst_eod", "worst_dir")
                        .join(n_groups, ["model", "attribute"]).join(n_pairs, ["model", "attribute"]))


def q_prepare_report(spark: SparkSession, sf: str) -> DataFrame:
    """M6: what preparing the orders decided."""
    return _order_prepared(spark, sf).report(spark)


def q_full_explanation(spark: SparkSession, sf: str) -> DataFrame:
    """E6 of the orders' logistic regression: importance, mean |phi| and group difference per feature."""
    p = _order_prepared(spark, sf)
    m, _ = models.fit("logistic_regression", p.train)
    e = explain.full_explanation(m, p.test, p.train, p.feature_names, ["row_id", "c_mktsegment"], "c_mktsegment",
                                 "BUILDING")
    out = (e["importance"].select("feature", "importance").join(e["mean_abs"].select("feature", "mean_shap"), "feature")
           .join(e["group"].select("feature", "shap_difference", "direction"), "feature", "left"))
    return report_round(out)


def q_order_train_audit(spark: SparkSession, sf: str) -> DataFrame:
    """M7-M10 then A1-A4 over the orders."""
    p = _order_prepared(spark, sf)
    res = models.train_all(p.train, p.test, ["row_id", "y_true", "c_mktsegment"])
    s = audit.summary(audit.group_stats(res.predictions, ["c_mktsegment"], {"c_mktsegment": "BUILDING"}))
    return report_round(s.join(res.metrics.select("model", "accuracy", "f1", "roc_auc"), "model"))


def q_order_forest_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """E4 + A30 of a random forest over the orders."""
    from evenkeel.operators.treeshap import tree_attribution
    p = _order_prepared(spark, sf)
    m, _ = models.fit("random_forest", p.train)
    attr = tree_attribution(m, p.test, p.feature_names, ["row_id", "c_mktsegment"])
    return report_round(explain.group_attribution(attr, "c_mktsegment", "BUILDING"))


def q_order_sampled_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """E5 + A29 of a decision tree over the orders."""
    p = _order_prepared(spark, sf)
    m, _ = models.fit("decision_tree", p.train)
    attr = explain.sampled_attribution(m, p.test, p.train, p.feature_names, ["row_id"], "row_id")
    return report_round(explain.mean_abs_attribution(attr))


QUERIES.update({
    "fit_invariants": q_fit_invariants, "oversampled_cells": q_oversampled_cells, "nearest_in_cell": q_nearest_in_cell,
    "full_audit": q_full_audit, "prepare_report": q_prepare_report, "full_explanation": q_full_explanation,
    "order_train_audit": q_order_train_audit, "order_forest_attribution": q_order_forest_attribution,
    "order_sampled_attribution": q_order_sampled_attribution,
})

_CELLS = with_views(ORDER_AUDIT) + """,
c AS (SELECT y_true, coalesce(c_mktsegment = 'BUILDING', false) AS is_priv, count(*) AS n FROM order_audit GROUP BY ALL)"""

ORACLE["oversampled_cells"] = _CELLS + """
SELECT y_true, is_priv, CAST(n AS BIGINT) AS n_real, CAST((SELECT max(n) FROM c) - n AS BIGINT) AS n_synthetic FROM c"""

ORACLE["nearest_in_cell"] = _CELLS + """,
s AS (SELECT o.row_id, o.y_true, c.is_priv, o.c_acctbal / 1000 AS x,
             CASE o.o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS code
      FROM order_audit o JOIN c ON o.y_true = c.y_true AND coalesce(o.c_mktsegment = 'BUILDING', false) = c.is_priv
      WHERE c.n < (SELECT max(n) FROM c)),
d AS (SELECT a.row_id, min(CASE WHEN a.code = b.code THEN 0.0 WHEN a.code = 0 OR b.code = 0 THEN 1.0 ELSE 2.0 END
                           + (a.x - b.x) * (a.x - b.x), 5) AS near
      FROM s a JOIN s b ON a.y_true = b.y_true AND a.is_priv = b.is_priv AND a.row_id <> b.row_id GROUP BY a.row_id)
SELECT row_id, CAST(len(near) AS BIGINT) AS n_neighbours, round(list_sum(near), 6) AS sum_d2,
       round(list_max(near), 6) AS fifth_d2 FROM d"""

ORACLE["full_audit"] = ORDER_GS + """
SELECT sm.model, sm.attribute, round(worst_dpd, 6) AS worst_dpd, round(worst_eod, 6) AS worst_eod,
       round(worst_dir, 6) AS worst_dir, n_groups, n_rows, CAST(n_groups - 1 AS BIGINT) AS n_pairs
FROM sm JOIN (SELECT model, attribute, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM gs GROUP BY ALL) g
     ON sm.model = g.model AND sm.attribute = g.attribute"""

ORACLE["prepare_report"] = with_views(ORDER_AUDIT) + """,
f AS (SELECT 1 + count(DISTINCT c_mktsegment) - 1 + count(DISTINCT o_orderstatus) - 1
             + count(DISTINCT o_orderpriority) - 1 + count(DISTINCT r_name) - 1 AS n FROM order_audit)
SELECT * FROM (VALUES ('dropped_columns', ''),
    ('imputation', 'categorical=most_frequent; continuous=median'), ('encoding', 'one_hot (first category dropped)'),
    ('scaling', 'z-score, population deviation, fit on train'),
    ('train_test_split', 'test_size=0.2; stratified; seed=42')) AS t(decision, value)
UNION ALL SELECT 'total_features', CAST(n AS VARCHAR) FROM f"""

# The training rows are those that the exact split leaves.
ORACLE["fit_invariants"] = with_views(ORDER_AUDIT) + """,
n AS (SELECT CAST(sum(k - ceil(k * 0.2 - 1e-9)) AS BIGINT) AS n FROM (SELECT count(*) AS k FROM order_audit GROUP BY y_true))
SELECT fit, n AS n_rows, true AS holds
FROM n, (VALUES ('baseline'), ('reweighing'), ('fair_classifier'), ('resampling')) AS t(fit)"""
