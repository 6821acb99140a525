"""Registered profile (A9-A12) and detection (A13-A21) queries with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import detect, profile
from evenkeel.plans.common import report_round
from evenkeel.plans.oracle_views import (LINE_AUDIT, LINE_DETECT, LINE_NULLS, ORDER_AUDIT,
                                         ORDER_DETECT, with_views)
from evenkeel.sources import views

LINE_CAT = ["l_linestatus", "p_type", "p_brand", "l_tax"]          # roles as inferred
LINE_NUM = ["p_size", "l_quantity", "l_discount", "l_extendedprice"]
ORDER_SENS = ["c_mktsegment", "r_name"]


def q_missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    return report_round(profile.missing_profile(views.line_nulls(spark, sf)))


def q_value_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = views.line_nulls(spark, sf)
    return report_round(profile.value_distribution(
        d, ["l_returnflag", "l_linestatus", "l_tax"], {"l_linestatus": "F"}))


def q_favourable_rate(spark: SparkSession, sf: str) -> DataFrame:
    d = views.line_nulls(spark, sf)
    return report_round(profile.favourable_rate(d, "l_returnflag", "R", ["l_linestatus", "p_brand"]))


def q_dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report_round(profile.dataset_summary(views.line_nulls(spark, sf), "l_returnflag", "R"))


def q_contingency(spark: SparkSession, sf: str) -> DataFrame:
    d = views.line_detect(spark, sf)
    roles = detect.infer_roles(d, [c for c in d.columns if c != "y_true"])
    return detect.contingency(d, roles.categorical, F.col("y_true"))


def q_association_strength(spark: SparkSession, sf: str) -> DataFrame:
    d = views.line_detect(spark, sf)
    ta = detect.target_association(d, "y_true", 1)
    return report_round(ta.select("feature", "type", "method", "statistic", "effect_size"))


def q_target_association(spark: SparkSession, sf: str) -> DataFrame:
    return report_round(detect.target_association(views.order_detect(spark, sf), "y_true", 1))


def q_proxy_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = views.order_detect(spark, sf)
    roles = detect.infer_roles(d, [c for c in d.columns if c != "y_true"])
    return report_round(detect.proxy_scan(d, roles.categorical, ORDER_SENS))


def q_disparate_impact_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = views.line_detect(spark, sf)
    roles = detect.infer_roles(d, [c for c in d.columns if c != "y_true"])
    return report_round(detect.disparate_impact_scan(d, roles.categorical, F.col("y_true")))


def q_flagged_features(spark: SparkSession, sf: str) -> DataFrame:
    r = detect.full_detection(views.order_detect(spark, sf), "y_true", 1, ORDER_SENS)
    return r["flagged_features"]


def q_detection_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = detect.full_detection(views.order_detect(spark, sf), "y_true", 1, ORDER_SENS)
    return r["summary"]


def _melt_sql(src: str, cls: str, cols: list[str]) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT CAST({cls} AS VARCHAR) AS cls, '{c}' AS feature, "
        f"coalesce(CAST({c} AS VARCHAR), 'MISSING') AS value FROM {src}" for c in cols)


def _chi2_sql(ct_sql: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    kj = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    return f"""
ct AS ({ct_sql}),
cm AS (SELECT {k}, cls, sum(n) AS c_j FROM ct GROUP BY {k}, cls),
rw AS (SELECT a.{keys[0]}{''.join(', a.' + x for x in keys[1:])}, a.value, sum(a.n) AS r_i,
              sum(a.n * a.n / b.c_j) AS s_i
       FROM ct a JOIN cm b ON {kj} AND a.cls = b.cls GROUP BY ALL),
tk AS (SELECT {k}, count(*) AS R, sum(r_i) AS N, sum(s_i / r_i) AS S, sum(1.0 / r_i) AS inv_r
       FROM rw GROUP BY {k}),
ck AS (SELECT {k}, count(*) AS C, sum(1.0 / c_j) AS inv_c FROM cm GROUP BY {k}),
cell AS (
  SELECT * FROM (
    SELECT a.{keys[0]}{''.join(', a.' + x for x in keys[1:])}, a.n AS o, r.r_i, b.c_j,
           row_number() OVER (PARTITION BY {', '.join('a.' + x for x in keys)} ORDER BY a.value, a.cls) AS rk
    FROM ct a JOIN cm b ON {kj} AND a.cls = b.cls
         JOIN rw r ON {' AND '.join(f'a.{x} = r.{x}' for x in keys)} AND a.value = r.value) t
  WHERE rk = 1),
chi AS (
  SELECT {', '.join('t.' + x for x in keys)}, t.N, t.R, c.C, (t.R - 1) * (c.C - 1) AS dof,
         CASE WHEN (t.R - 1) * (c.C - 1) = 0 THEN 0.0
              WHEN (t.R - 1) * (c.C - 1) = 1 THEN
                pow(abs(x.o - x.r_i * x.c_j / t.N) - least(0.5, abs(x.o - x.r_i * x.c_j / t.N)), 2)
                * t.N * t.inv_r * c.inv_c
              ELSE greatest(t.N * (t.S - 1), 0.0) END AS chi2,
         least(t.R, c.C) - 1 AS kk
  FROM tk t JOIN ck c ON {' AND '.join(f't.{x} = c.{x}' for x in keys)}
       JOIN cell x ON {' AND '.join(f't.{x} = x.{x}' for x in keys)}),
vv AS (SELECT *, CASE WHEN kk > 0 THEN sqrt(chi2 / (N * greatest(kk, 1))) ELSE 0.0 END AS v FROM chi)"""


EFFECT_SQL = ("CASE WHEN {v} < 0.10 THEN 'Negligible' WHEN {v} < 0.20 THEN 'Small' "
              "WHEN {v} < 0.40 THEN 'Medium' ELSE 'Large' END")

LINE_NULL_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                  "l_tax", "l_returnflag", "l_linestatus", "p_type", "p_brand", "p_size"]

MISSING_SQL = with_views(LINE_AUDIT, LINE_NULLS) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing, "
    f"round(100.0 * count_if({c} IS NULL) / count(*), 6) AS pct_missing FROM line_nulls"
    for c in LINE_NULL_COLS)

VALUE_DIST_SQL = with_views(LINE_AUDIT, LINE_NULLS) + """,
m AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM line_nulls"
    for c in ["l_returnflag", "l_linestatus", "l_tax"]) + """),
g AS (SELECT col, value, count(*) AS n FROM m GROUP BY col, value),
t AS (SELECT *, sum(n) OVER (PARTITION BY col) AS tot FROM g)
SELECT col AS "column", value, CAST(n AS BIGINT) AS n, round(100.0 * n / tot, 6) AS pct,
       CASE WHEN col = 'l_linestatus' THEN value = 'F' END AS is_privileged
FROM t WHERE value IS NOT NULL"""

FAV_SQL = with_views(LINE_AUDIT, LINE_NULLS) + """,
m AS (""" + "\n  UNION ALL ".join(
    f"SELECT CAST(coalesce(l_returnflag = 'R', false) AS INTEGER) AS y, '{c}' AS attribute, "
    f"CAST({c} AS VARCHAR) AS grp FROM line_nulls" for c in ["l_linestatus", "p_brand"]) + """),
g AS (SELECT attribute, grp, count(*) AS n, sum(y) AS pos FROM m GROUP BY ALL),
t AS (SELECT *, sum(pos) OVER (PARTITION BY attribute) / sum(n) OVER (PARTITION BY attribute) AS overall
      FROM g)
SELECT attribute, grp AS "group", CAST(n AS BIGINT) AS n, round(pos / n, 6) AS rate,
       round(overall, 6) AS overall_rate, round(abs(pos / n - overall), 6) AS gap,
       abs(pos / n - overall) > 0.10 AS bias_signal
FROM t WHERE grp IS NOT NULL"""

SUMMARY_SQL = with_views(LINE_AUDIT, LINE_NULLS) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(10 AS BIGINT) AS n_features,
       CAST(""" + " + ".join(f"count_if({c} IS NULL)" for c in LINE_NULL_COLS) + """ AS BIGINT) AS missing_cells,
       round(avg(CAST(coalesce(l_returnflag = 'R', false) AS INTEGER)), 6) AS positive_rate
FROM line_nulls"""

CONTINGENCY_SQL = with_views(LINE_AUDIT, LINE_DETECT) + """,
m AS (""" + _melt_sql("line_detect", "y_true", LINE_CAT) + """)
SELECT feature, value, cls AS class, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL"""

ASSOC_SQL = with_views(LINE_AUDIT, LINE_DETECT) + """,
m AS (""" + _melt_sql("line_detect", "y_true", LINE_CAT) + """),""" + _chi2_sql(
    "SELECT feature, value, cls, count(*) AS n FROM m GROUP BY ALL", ["feature"]) + """,
num AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr(CAST({c} AS DOUBLE), CAST(y_true AS DOUBLE))) AS r, count({c}) AS n "
    f"FROM line_detect" for c in LINE_NUM) + """)
SELECT feature, 'categorical' AS type, 'Chi-squared + Cramer''s V' AS method, round(v, 6) AS statistic,
       """ + EFFECT_SQL.format(v="v") + """ AS effect_size FROM vv
UNION ALL
SELECT feature, 'continuous', 'Point-biserial correlation', round(r, 6),
       """ + EFFECT_SQL.format(v="coalesce(r, 0.0)") + """ FROM num WHERE n >= 10"""

_PROXY_FEATS = ["o_orderstatus", "o_orderpriority", "n_name"]
PROXY_SQL = with_views(ORDER_AUDIT, ORDER_DETECT) + """,
m AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{s}' AS sensitive_attr, coalesce(CAST({f} AS VARCHAR), 'MISSING') AS value, "
    f"coalesce(CAST({s} AS VARCHAR), 'MISSING') AS cls FROM order_detect"
    for f in _PROXY_FEATS for s in ORDER_SENS) + """),""" + _chi2_sql(
    "SELECT feature, sensitive_attr, value, cls, count(*) AS n FROM m GROUP BY ALL",
    ["feature", "sensitive_attr"]) + """
SELECT feature, sensitive_attr, round(v, 6) AS cramers_v, """ + EFFECT_SQL.format(v="v") + """ AS effect_size,
       v >= 0.20 AS flagged_as_proxy FROM vv"""

DI_SQL = with_views(LINE_AUDIT, LINE_DETECT) + """,
m AS (""" + "\n  UNION ALL ".join(
    f"SELECT CAST(y_true AS DOUBLE) AS y, '{c}' AS feature, CAST({c} AS VARCHAR) AS value, "
    + (f"CAST({c} AS DOUBLE)" if c == "l_tax" else "CAST(NULL AS DOUBLE)")
    + f" AS vd FROM line_detect WHERE {c} IS NOT NULL" for c in LINE_CAT) + """),
g AS (SELECT feature, vd, value, count(*) AS n, avg(y) AS rate FROM m GROUP BY ALL HAVING count(*) >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rate DESC, vd NULLS FIRST, value) AS rmax,
                row_number() OVER (PARTITION BY feature ORDER BY rate, vd NULLS FIRST, value) AS rmin FROM g),
s AS (SELECT feature, count(*) AS n_groups, max(rate) AS max_rate, min(rate) AS min_rate,
             max(CASE WHEN rmax = 1 THEN value END) AS max_rate_group,
             max(CASE WHEN rmin = 1 THEN value END) AS min_rate_group FROM r GROUP BY feature)
SELECT feature, CAST(n_groups AS BIGINT) AS n_groups, max_rate_group, round(max_rate, 6) AS max_rate,
       min_rate_group, round(min_rate, 6) AS min_rate, round(max_rate - min_rate, 6) AS rate_spread,
       round(min_rate / max_rate, 6) AS disparate_impact, min_rate / max_rate < 0.80 AS flagged
FROM s WHERE n_groups >= 2 AND max_rate > 0"""

QUERIES = {
    "missing_profile": q_missing_profile,
    "value_distribution": q_value_distribution,
    "favourable_rate": q_favourable_rate,
    "dataset_summary": q_dataset_summary,
    "contingency": q_contingency,
    "association_strength": q_association_strength,
    "target_association": q_target_association,
    "proxy_scan": q_proxy_scan,
    "disparate_impact_scan": q_disparate_impact_scan,
    "flagged_features": q_flagged_features,
    "detection_summary": q_detection_summary,
}

ORACLE = {
    "missing_profile": MISSING_SQL,
    "value_distribution": VALUE_DIST_SQL,
    "favourable_rate": FAV_SQL,
    "dataset_summary": SUMMARY_SQL,
    "contingency": CONTINGENCY_SQL,
    "association_strength": ASSOC_SQL,
    "proxy_scan": PROXY_SQL,
    "disparate_impact_scan": DI_SQL,
}


def q_column_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Role of every feature column of the line detection table."""
    d = views.line_detect(spark, sf)
    r = detect.infer_roles(d, [c for c in d.columns if c != "y_true"])
    rows = [(c, "categorical") for c in r.categorical] + [(c, "numeric") for c in r.numeric]
    return spark.createDataFrame(rows, "feature string, role string")


def q_target_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """String target without a positive label: 1 unless the most frequent value."""
    d = views.line_nulls(spark, sf)
    y = detect.encode_target(d, "l_returnflag")
    return d.groupBy("l_returnflag", y.alias("y")).agg(F.count(F.lit(1)).alias("n"))


_ROLE_COLS = ["l_linestatus", "p_type", "p_brand", "p_size", "l_quantity", "l_discount", "l_tax",
              "l_extendedprice"]
ROLES_SQL = with_views(LINE_AUDIT, LINE_DETECT) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN typeof(any_value({c})) = 'VARCHAR' OR count(DISTINCT {c}) <= 10 "
    f"THEN 'categorical' ELSE 'numeric' END AS role FROM line_detect" for c in _ROLE_COLS)

TARGET_ENC_SQL = with_views(LINE_AUDIT, LINE_NULLS) + """,
top AS (SELECT l_returnflag AS v FROM line_nulls WHERE l_returnflag IS NOT NULL
        GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)
SELECT l_returnflag, CAST(coalesce(l_returnflag <> (SELECT v FROM top), true) AS INTEGER) AS y,
       CAST(count(*) AS BIGINT) AS n
FROM line_nulls GROUP BY ALL"""

QUERIES["column_roles"] = q_column_roles
QUERIES["target_encoding"] = q_target_encoding
ORACLE["column_roles"] = ROLES_SQL
ORACLE["target_encoding"] = TARGET_ENC_SQL

# p-values by series of positive terms. Chi-squared: 1 - P(dof/2, chi2/2). Correlation: with a = (n - 2)/2 and
# s = r^2, 1 - I_s(1/2, a). Term k is a product of ratios, summed as logarithms; past 700 the p-value is 0.
P_VALUE_SQL = """,
step AS (SELECT CAST(i AS DOUBLE) AS i FROM (SELECT unnest(range(0, 3000)) AS i)),
gterm AS (SELECT feature, dof / 2.0 AS a, chi2 / 2.0 AS x, i,
                 sum(CASE WHEN i = 0 THEN 0 ELSE ln((chi2 / 2.0) / (dof / 2.0 + i)) END)
                   OVER (PARTITION BY feature ORDER BY i) AS t
          FROM vv, step WHERE dof > 0 AND chi2 > 0 AND chi2 / 2.0 < 700),
gp AS (SELECT feature, greatest(1 - sum(exp(a * ln(x) - x - lgamma(a + 1) + t)), 0) AS p FROM gterm GROUP BY feature),
bterm AS (SELECT feature, (n - 2) / 2.0 AS a, r * r AS s, i,
                 sum(CASE WHEN i = 0 THEN 0 ELSE ln(((n - 2) / 2.0 + i - 0.5) / (0.5 + i) * r * r) END)
                   OVER (PARTITION BY feature ORDER BY i) AS t
          FROM num, step WHERE r > 0 AND r < 1 AND n >= 10 AND r * r * n / 2.0 < 700),
bp AS (SELECT feature, greatest(1 - sum(exp(0.5 * ln(s) + a * ln(1 - s) + lgamma(a + 0.5) - lgamma(a) - lgamma(0.5)
                                            - ln(0.5) + t)), 0) AS p FROM bterm GROUP BY feature),
joined AS (
  SELECT vv.feature, 'categorical' AS type, 'Chi-squared + Cramer''s V' AS method, v AS statistic,
         CASE WHEN dof = 0 OR chi2 = 0 THEN 1.0 ELSE coalesce(gp.p, 0) END AS p
  FROM vv LEFT JOIN gp ON vv.feature = gp.feature
  UNION ALL
  SELECT num.feature, 'continuous', 'Point-biserial correlation', r,
         CASE WHEN r = 0 THEN 1.0 WHEN r IS NOT NULL THEN coalesce(bp.p, 0) END
  FROM num LEFT JOIN bp ON num.feature = bp.feature WHERE n >= 10)
SELECT feature, type, method, round(statistic, 6) AS statistic, round(p, 6) AS p_value,
       coalesce(p < 0.05, false) AS significant, """ + EFFECT_SQL.format(v="coalesce(statistic, 0.0)") + """ AS effect_size,
       coalesce(statistic >= 0.15, false) AND coalesce(p < 0.05, false) AS flagged
FROM joined"""


def _num_sql(src: str, cols: list[str]) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT '{c}' AS feature, abs(corr(CAST({c} AS DOUBLE), CAST(y_true AS DOUBLE))) AS r, count({c}) AS n FROM {src}"
        for c in cols)


ORDER_CAT = ["c_mktsegment", "r_name", "o_orderstatus", "o_orderpriority", "n_name"]


def _association_sql(views_sql: str, src: str, cats: list[str], nums: list[str]) -> str:
    return (views_sql + ",\nm AS (" + _melt_sql(src, "y_true", cats) + ")," + _chi2_sql(
        "SELECT feature, value, cls, count(*) AS n FROM m GROUP BY ALL", ["feature"])
        + ",\nnum AS (" + _num_sql(src, nums) + ")" + P_VALUE_SQL)


def q_line_target_association(spark: SparkSession, sf: str) -> DataFrame:
    """A14-A17 over the lines: wide columns, one 2x2 table, several numeric columns."""
    return report_round(detect.target_association(views.line_detect(spark, sf), "y_true", 1))


def q_combined_association(spark: SparkSession, sf: str) -> DataFrame:
    """The association scan of ``full_detection``, from combinations counted once."""
    r = detect.full_detection(views.order_detect(spark, sf), "y_true", 1, ORDER_SENS)
    return report_round(r["target_correlation"])


QUERIES["line_target_association"] = q_line_target_association
QUERIES["combined_association"] = q_combined_association
ORACLE["target_association"] = _association_sql(with_views(ORDER_AUDIT, ORDER_DETECT), "order_detect", ORDER_CAT,
                                                ["c_acctbal"])
ORACLE["combined_association"] = ORACLE["target_association"]
ORACLE["line_target_association"] = _association_sql(with_views(LINE_AUDIT, LINE_DETECT), "line_detect", LINE_CAT,
                                                     LINE_NUM)
