"""Automatic detection of bias-prone columns.

``full_detection`` reads its source three times: distinct counts, one count of
the distinct combinations of the categorical columns and the outcome, and one
aggregate for the correlations of all numeric columns. Margins, contingency
tables, proxies, disparate impact and exact category counts follow from the
combinations, so unpivoting multiplies combinations, not rows. The chi-squared
statistic is assembled from margins with aggregates and joins, so a
high-cardinality column never puts its whole table into one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.scalar import binarize, effect_label, is_missing, null_category
from evenkeel.functions.stats import chi2_p_udf, corr_p_udf
from evenkeel.session import written
from evenkeel.spec import DetectionThresholds

# Method names, confidence words and reason formats as reported.
CHI2_METHOD = "Chi-squared + Cramer's V"
CORR_METHOD = "Point-biserial correlation"
CONFIDENCE_WORDS = ["Low", "Medium", "High"]

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


@dataclass(frozen=True)
class Roles:
    categorical: list
    numeric: list


def infer_roles(df: DataFrame, features: Sequence[str], max_categories: int = 10) -> Roles:
    """Strings (and booleans) are categorical; numbers with at most
    ``max_categories`` distinct non-null values too; other numbers are numeric.

    A cheap HyperLogLog pass screens out wide columns; exact distinct counts
    run only on the few candidates left (bounded state).
    """
    cat, num_cands, cands = _role_candidates(df, features, max_categories)
    return _roles(df, features, cat, num_cands, cands, max_categories)


def _role_candidates(df: DataFrame, features: Sequence[str], max_categories: int):
    """Sure categorical columns, numeric ones, and the numeric ones that may have few enough values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cat, num_cands = [], []
    for c in features:
        t = types[c]
        if isinstance(t, (T.StringType, T.BooleanType)):
            cat.append(c)
        elif isinstance(t, _NUMERIC):
            num_cands.append(c)
    if not num_cands:
        return cat, [], []
    approx = df.agg(*[F.approx_count_distinct(c).alias(c) for c in num_cands]).first()
    return cat, num_cands, [c for c in num_cands if approx[c] <= 4 * max_categories]


def _roles(df: DataFrame, features: Sequence[str], cat: list, num_cands: list, cands: list,
           max_categories: int) -> Roles:
    """Roles after exact distinct counts of the candidates (in ``df`` or its combinations)."""
    small = set()
    if cands:
        exact = df.agg(*[F.count_distinct(c).alias(c) for c in cands]).first()
        small = {c for c in cands if exact[c] <= max_categories}
    cat_set = set(cat) | small
    return Roles([c for c in features if c in cat_set],
                 [c for c in num_cands if c not in small])


def encode_target(df: DataFrame, target: str, positive: Any = None) -> Column:
    """0/1 outcome column expression.

    ``positive`` wins when given. Otherwise (T3, T4): 0/1 columns pass
    through; strings -> 1 unless the most frequent value (ties: smallest);
    other numbers -> 1 when above the exact median. A target that is null
    throughout or has a single value is an error (T3); null and NaN are 0 in
    numbers and, as in the string rule, "not the most frequent" in strings.
    """
    if positive is not None:
        return binarize(target, positive)
    t = df.schema[target].dataType
    if isinstance(t, T.StringType):
        top = (df.where(F.col(target).isNotNull()).groupBy(target).count()
               .orderBy(F.desc("count"), F.asc(target)).limit(2).collect())
        nulls = df.where(F.col(target).isNull()).limit(1).count()
        if len(top) + nulls < 2:
            raise ValueError(f"target {target} has a single value: nothing to audit")
        return F.coalesce((F.col(target) != F.lit(top[0][0])).cast("int"), F.lit(1))
    missing = is_missing(df, target)
    x = F.when(~missing, F.col(target))
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count_if(~missing & ~x.isin(0, 1)).alias("others")).first()
    if r["lo"] is None or r["lo"] == r["hi"]:
        raise ValueError(f"target {target} has a single value: nothing to audit")
    if not r["others"]:
        return F.coalesce(x.cast("int"), F.lit(0))
    from evenkeel.operators.quantile import exact_medians
    med = exact_medians(df, [target])[target]
    return F.coalesce((x > F.lit(med)).cast("int"), F.lit(0))


def combinations(df: DataFrame, columns: Sequence[str], y: Optional[Column] = None) -> DataFrame:
    """Distinct combinations of the columns (and ``_y``), ``_n`` rows each: what the scans below
    take with ``weight="_n"`` in place of the rows."""
    outcome = [] if y is None else [y.alias("_y")]
    return df.groupBy(*[F.col(c) for c in dict.fromkeys(columns)], *outcome).agg(F.count(F.lit(1)).alias("_n"))


def _rows(weight: Optional[str]) -> Column:
    """Rows counted: each once, or as often as ``weight`` says."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def contingency(df: DataFrame, features: Sequence[str], class_col: Column,
                missing: str = "MISSING", weight: Optional[str] = None) -> DataFrame:
    """Long-form counts (feature, value, class, n) for all columns at once."""
    cols = list(features)
    kept = [] if weight is None else [weight]
    long = df.select(class_col.cast("string").alias("class"), *kept,
                     *[null_category(c, missing).alias(c) for c in cols]).unpivot(
        ["class", *kept], cols, "feature", "value")
    return long.groupBy("feature", "value", "class").agg(_rows(weight).alias("n"))


def chi2_stats(ct: DataFrame, keys: Sequence[str], yates: bool = True,
               margins: Optional[DataFrame] = None, margin_keys: Sequence[str] = ()) -> DataFrame:
    """A14 + A15: chi-squared (Yates-corrected when dof = 1), dof, Cramer's V.

    ``ct`` has (keys..., value, class, n). Uses
    chi2 = N * (sum_i (1/r_i) sum_j o_ij^2 / c_j - 1); for a 2x2 table every
    |o - e| is the same d and chi2 = (d - min(0.5, d))^2 * N * sum(1/r) * sum(1/c).

    ``margins`` (margin_keys..., class, c_j) may be given when the class
    totals are the same for every key (every row counted, as in the scans):
    they then come from a scan of the class columns only, and ``ct`` is
    referenced once. Without it they are aggregated from ``ct``.
    """
    keys = list(keys)
    mk = list(margin_keys)
    if margins is None:
        cm = ct.groupBy(*keys, "class").agg(F.sum("n").alias("c_j"))
        mk = keys
    else:
        cm = margins
    cmk = cm.groupBy(*mk).agg(F.count(F.lit(1)).alias("C"), F.sum(1.0 / F.col("c_j")).alias("inv_c")) \
        if mk else None
    # Written, so that the planner knows their size: class totals small enough are broadcast and the
    # contingency rows stay where they are; otherwise it is a shuffle join that AQE splits.
    cm = written(cm, "margins")
    cells = ct.join(cm, mk + ["class"])
    rows = cells.groupBy(*keys, "value").agg(
        F.sum("n").alias("r_i"),
        F.sum(F.col("n") * F.col("n") / F.col("c_j")).alias("s_i"),
        F.min_by(F.struct(F.col("n").alias("o"), F.col("c_j").alias("c")), F.col("class")).alias("cell"))
    tk = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("R"), F.sum("r_i").alias("N"),
        F.sum(F.col("s_i") / F.col("r_i")).alias("S"), F.sum(1.0 / F.col("r_i")).alias("inv_r"),
        F.min_by(F.struct(F.col("cell.o").alias("o"), F.col("r_i").alias("r"),
                          F.col("cell.c").alias("c")), F.col("value")).alias("cell"))
    if cmk is not None:
        t = tk.join(cmk, mk)
    else:
        # class totals shared by every key: a handful of fitted scalars
        ms = cm.collect()
        t = tk.withColumn("C", F.lit(len(ms))).withColumn(
            "inv_c", F.lit(float(sum(1.0 / r["c_j"] for r in ms))))
    n = F.col("N").cast("double")
    dof = (F.col("R") - 1) * (F.col("C") - 1)
    plain = F.greatest(n * (F.col("S") - 1.0), F.lit(0.0))
    d = F.abs(F.col("cell.o") - F.col("cell.r") * F.col("cell.c") / n)
    corrected = F.pow(d - F.least(F.lit(0.5), d), 2) * n * F.col("inv_r") * F.col("inv_c")
    chi2 = F.when(dof == 0, 0.0).when((dof == 1) & F.lit(yates), corrected).otherwise(plain)
    k = F.least(F.col("R"), F.col("C")) - 1
    v = F.when(k > 0, F.sqrt(chi2 / (n * F.greatest(k, F.lit(1))))).otherwise(0.0)
    return t.select(*keys, F.col("N").alias("n"), F.col("R").alias("n_rows"),
                    F.col("C").cast("long").alias("n_cols"), dof.alias("dof"), chi2.alias("chi2"),
                    v.alias("cramers_v"))


def categorical_association(df: DataFrame, features: Sequence[str], y: Column,
                            th: DetectionThresholds = DetectionThresholds(),
                            weight: Optional[str] = None) -> DataFrame:
    """Chi-squared + Cramer's V of each categorical feature against y."""
    if not features:
        return None
    # columns that are entirely null are skipped
    nonnull = df.agg(*[F.count(c).alias(c) for c in features]).first()
    feats = [c for c in features if nonnull[c] > 0]
    if not feats:
        return None
    margins = df.groupBy(y.cast("string").alias("class")).agg(_rows(weight).alias("c_j"))
    st = chi2_stats(contingency(df, feats, y, weight=weight), ["feature"], margins=margins)
    p = chi2_p_udf(F.col("chi2"), F.col("dof").cast("double"))
    return st.select("feature", F.lit("categorical").alias("type"), F.lit(CHI2_METHOD).alias("method"),
                     F.col("cramers_v").alias("statistic"), p.alias("p_value"))


def numeric_association(df: DataFrame, features: Sequence[str], y: Column,
                        th: DetectionThresholds = DetectionThresholds()) -> DataFrame:
    """|point-biserial r| of each numeric feature with y (non-null pairs)."""
    if not features:
        return None
    d = df.select(y.cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features])
    aggs = []
    for c in features:
        aggs += [F.corr(c, "_y").alias(f"r__{c}"), F.count(c).alias(f"n__{c}")]
    a = d.agg(*aggs)
    long = a.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"r__{c}").alias("r"), F.col(f"n__{c}").alias("n"))
        for c in features])).alias("s")).select("s.*")
    long = long.where(F.col("n") >= th.min_numeric_rows)
    r = F.nanvl(F.col("r"), F.lit(None).cast("double"))
    return long.select("feature", F.lit("continuous").alias("type"), F.lit(CORR_METHOD).alias("method"),
                       F.abs(r).alias("statistic"), corr_p_udf(r, F.col("n").cast("double")).alias("p_value"))


def target_association(df: DataFrame, target: str, positive: Any = None,
                       roles: Optional[Roles] = None,
                       th: DetectionThresholds = DetectionThresholds(),
                       combined: Optional[DataFrame] = None) -> DataFrame:
    """Association of every feature with the outcome.

    ``combined``: the ``combinations`` of the categorical features and the outcome, if at hand.
    """
    feats = [c for c in df.columns if c != target]
    roles = roles or infer_roles(df, feats, th.max_categories)
    y = encode_target(df, target, positive)
    by_category = (categorical_association(df, roles.categorical, y, th) if combined is None else
                   categorical_association(combined, roles.categorical, F.col("_y"), th, "_n"))
    parts = [p for p in (by_category,
                         numeric_association(df, roles.numeric, y, th)) if p is not None]
    out = df.sparkSession.createDataFrame([], "feature string, type string, method string, statistic double, "
                                              "p_value double")
    for p in parts:
        out = out.unionByName(p)
    sig = F.coalesce(F.col("p_value") < th.p_value, F.lit(False))
    return out.select("*", sig.alias("significant"),
                      effect_label(F.coalesce("statistic", F.lit(0.0))).alias("effect_size"),
                      (F.coalesce(F.col("statistic") >= th.correlation, F.lit(False)) & sig).alias("flagged"))


def proxy_scan(df: DataFrame, features: Sequence[str], sensitive: Sequence[str],
               th: DetectionThresholds = DetectionThresholds(), weight: Optional[str] = None) -> DataFrame:
    """A18 + J9: Cramer's V of each categorical feature with each known
    sensitive attribute (self pairs skipped). Empty when none is known.

    Rows are first counted by combination of all these columns; only the
    combinations are multiplied by features x attributes.
    """
    sens = [s for s in sensitive if s in df.columns]
    feats = [c for c in features if c not in sens]
    schema = "feature string, sensitive_attr string, cramers_v double, effect_size string, flagged_as_proxy boolean"
    if not sens or not feats:
        return df.sparkSession.createDataFrame([], schema)
    base = df.groupBy(*[null_category(c).alias(f"f__{c}") for c in feats],
                      *[null_category(s).alias(f"s__{s}") for s in sens]).agg(_rows(weight).alias("_n"))
    fs, ss = [f"f__{c}" for c in feats], [f"s__{s}" for s in sens]
    by_feat = base.unpivot(["_n", *ss], fs, "feature", "value")
    by_both = by_feat.unpivot(["_n", "feature", "value"], ss, "sensitive_attr", "class")
    ct = by_both.groupBy("feature", "sensitive_attr", "value", "class").agg(F.sum("_n").alias("n"))
    ct = written(ct.select(F.expr("substring(feature, 4)").alias("feature"),
                           F.expr("substring(sensitive_attr, 4)").alias("sensitive_attr"), "value", "class", "n"),
                 "proxies")
    # Every feature counts every row, so one feature's table holds the attributes' margins.
    margins = ct.where(F.col("feature") == feats[0]).groupBy("sensitive_attr", "class").agg(F.sum("n").alias("c_j"))
    st = chi2_stats(ct, ["feature", "sensitive_attr"], margins=margins, margin_keys=["sensitive_attr"])
    return st.select("feature", "sensitive_attr", "cramers_v", effect_label("cramers_v").alias("effect_size"),
                     (F.col("cramers_v") >= th.proxy).alias("flagged_as_proxy"))


def disparate_impact_scan(df: DataFrame, features: Sequence[str], y: Column,
                          th: DetectionThresholds = DetectionThresholds(),
                          weight: Optional[str] = None) -> DataFrame:
    """Outcome rate per value (>= min rows, nulls dropped) and the
    min / max rate groups per column; ties go to the first value in the
    column's own sort order (numeric order for numbers).
    """
    cols = list(features)
    types = {f.name: f.dataType for f in df.schema.fields}
    is_num = {c: isinstance(types[c], _NUMERIC) for c in cols}
    packed = df.select(y.cast("double").alias("_y"), (F.lit(1) if weight is None else F.col(weight)).alias("_w"), *[
        F.struct(F.col(c).cast("string").alias("s"),
                 (F.col(c).cast("double") if is_num[c] else F.lit(None).cast("double")).alias("d")
                 ).alias(c) for c in cols])
    long = packed.unpivot(["_y", "_w"], cols, "feature", "v").where(F.col("v.s").isNotNull())
    g = long.groupBy("feature", F.col("v.d").alias("vd"), F.col("v.s").alias("value")).agg(
        F.sum("_w").alias("n"), (F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).alias("rate"))
    g = g.where(F.col("n") >= th.min_group_rows)
    s = g.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.max("rate").alias("max_rate"), F.min("rate").alias("min_rate"),
        F.min_by("value", F.struct(-F.col("rate"), F.col("vd"), F.col("value"))).alias("max_rate_group"),
        F.min_by("value", F.struct(F.col("rate"), F.col("vd"), F.col("value"))).alias("min_rate_group"))
    s = s.where((F.col("n_groups") >= 2) & (F.col("max_rate") > 0))
    di = F.col("min_rate") / F.col("max_rate")
    return s.select("feature", "n_groups", "max_rate_group", "max_rate", "min_rate_group", "min_rate",
                    (F.col("max_rate") - F.col("min_rate")).alias("rate_spread"),
                    di.alias("disparate_impact"), (di < th.disparate_impact).alias("flagged"))


def flagged_features(assoc: DataFrame, proxies: DataFrame, di: DataFrame) -> DataFrame:
    """A20 + J4 + J8: features flagged by any scan, scored by how many.

    One union of (feature, order, reason) rows and one groupBy(feature) in
    place of three lookups per feature.
    """
    r1 = assoc.where("flagged").select(
        "feature", F.lit(1).alias("ord"), F.format_string("target_corr=%.3f", "statistic").alias("reason"))
    px = proxies.where("flagged_as_proxy").groupBy("feature").agg(
        F.sort_array(F.collect_list(F.struct(-F.col("cramers_v"), F.col("sensitive_attr")))).alias("a"))
    r2 = px.select("feature", F.lit(2).alias("ord"), F.concat(
        F.lit("proxy_for=["),
        F.array_join(F.transform("a", lambda x: F.concat(F.lit("'"), x["sensitive_attr"], F.lit("'"))), ", "),
        F.lit("]")).alias("reason"))
    r3 = di.where("flagged").select(
        "feature", F.lit(3).alias("ord"), F.format_string("DI=%.3f", "disparate_impact").alias("reason"))
    u = r1.unionByName(r2).unionByName(r3)
    g = u.groupBy("feature").agg(F.count(F.lit(1)).alias("methods_flagged"),
                                 F.sort_array(F.collect_list(F.struct("ord", "reason"))).alias("_r"))
    words = F.array(*[F.lit(w) for w in CONFIDENCE_WORDS])
    return g.select("feature", "methods_flagged",
                    F.element_at(words, F.least(F.col("methods_flagged"), F.lit(3)).cast("int")).alias("confidence"),
                    F.array_join(F.transform("_r", lambda x: x["reason"]), " | ").alias("reasons"))


def detection_summary(flagged: DataFrame, total_features_scanned: int) -> DataFrame:
    """Counts per confidence level."""
    m = F.col("methods_flagged")
    return flagged.agg(
        F.lit(total_features_scanned).cast("long").alias("total_features_scanned"),
        F.count(F.lit(1)).alias("features_flagged"),
        F.count_if(m == 3).alias("high_confidence"),
        F.count_if(m == 2).alias("medium_confidence"),
        F.count_if(m == 1).alias("low_confidence"))


def full_detection(df: DataFrame, target: str, positive: Any = None,
                   known_sensitive: Sequence[str] = (),
                   th: DetectionThresholds = DetectionThresholds()):
    """All three scans + consolidation; returns a dict of DataFrames."""
    feats = [c for c in df.columns if c != target]
    cat, num_cands, cands = _role_candidates(df, feats, th.max_categories)
    y = encode_target(df, target, positive)
    known = [s for s in known_sensitive if s in df.columns]
    combined = written(combinations(df, [*cat, *cands, *known], y), "combinations")
    roles = _roles(combined, feats, cat, num_cands, cands, th.max_categories)
    assoc = target_association(df, target, positive, roles, th, combined)
    px = proxy_scan(combined, roles.categorical, known, th, "_n")
    di = disparate_impact_scan(combined, roles.categorical, F.col("_y"), th, "_n")
    fl = flagged_features(assoc, px, di)
    return {"target_correlation": assoc, "proxies": px, "disparate_impact": di,
            "flagged_features": fl, "summary": detection_summary(fl, len(feats)), "roles": roles}
