"""The driver tables recast as audit inputs.

Each view is one row per audited entity with ``row_id``, ``y_true`` (0/1),
``score`` in [0, 1], one 0/1 column per rule-based "model"
(``pred_<name>``) and the sensitive attributes as strings. Only the
columns named here are read from parquet (the scan's ReadSchema shows it).

Joins are declared plainly: dimension tables of fixed size (nation,
region) are broadcast by the planner from their file-size statistics, the
large fact-to-dimension joins are left to sort-merge with AQE skew
splitting, so a hot key does not land in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.scalar import clip01


@dataclass(frozen=True)
class AuditView:
    df: DataFrame
    models: Sequence[str]
    attributes: Sequence[str]
    privileged: Mapping[str, str] = field(default_factory=dict)

    def long(self) -> DataFrame:
        return to_long_predictions(self.df, self.models, self.attributes)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def to_long_predictions(df: DataFrame, models: Sequence[str], attributes: Sequence[str],
                        keep: Sequence[str] = ("row_id", "y_true", "score")) -> DataFrame:
    """Wide rule columns -> (row_id, model, y_true, y_pred, score, attrs...).

    ``unpivot`` becomes one Expand node that feeds the next aggregation's
    partial (map-side) stage in the same task; nothing is materialised.
    """
    ids = [c for c in keep if c in df.columns] + list(attributes)
    pred_cols = [f"pred_{m}" for m in models]
    renamed = df.select(*ids, *[F.col(p).cast("int").alias(m) for p, m in zip(pred_cols, models)])
    return renamed.unpivot(ids, list(models), "model", "y_pred")


def doc_audit(spark: SparkSession, sf_dir: str) -> AuditView:
    """labels JOIN documents USING (doc_id); quality is the outcome."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    j = labels.join(docs, "doc_id")
    df = j.select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("int").alias("y_true"),
        F.least(F.col("n_chars") / F.lit(20000.0), F.lit(1.0)).alias("score"),
        _flag(F.col("n_chars") >= 400).alias("pred_len400"),
        _flag(F.col("n_chars") >= 1500).alias("pred_len1500"),
        _flag(F.col("toxic") == 0).alias("pred_nontoxic"),
        F.col("lang"), F.col("source"),
    )
    return AuditView(df, ["len400", "len1500", "nontoxic"], ["lang", "source"], {"lang": "en"})


def order_audit(spark: SparkSession, sf_dir: str) -> AuditView:
    """orders JOIN customer JOIN nation JOIN region; big orders are the outcome."""
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal",
                                                "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(n, c.c_nationkey == n.n_nationkey)
          .join(r, n.n_regionkey == r.r_regionkey))
    df = j.select(
        F.col("o_orderkey").alias("row_id"),
        _flag(F.col("o_totalprice") > 250000).alias("y_true"),
        clip01((F.col("c_acctbal") + 1000) / 11000).alias("score"),
        _flag(F.col("c_acctbal") > 5000).alias("pred_acctbal"),
        _flag(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("pred_priority"),
        _flag(F.col("o_orderstatus") == "F").alias("pred_status_f"),
        "c_mktsegment", "r_name", "o_orderstatus",
        # carried for the detection / preparation queries
        "n_name", "o_orderpriority", "c_acctbal", "o_totalprice",
    )
    return AuditView(df, ["acctbal", "priority", "status_f"],
                     ["c_mktsegment", "r_name", "o_orderstatus"],
                     {"c_mktsegment": "BUILDING"})


def line_audit(spark: SparkSession, sf_dir: str) -> AuditView:
    """lineitem JOIN part; returned lines are the outcome. No unique row id."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    j = li.join(p, li.l_partkey == p.p_partkey)
    df = j.select(
        _flag(F.col("l_returnflag") == "R").alias("y_true"),
        (F.col("l_discount") * 10).alias("score"),
        _flag(F.col("l_discount") > 0.05).alias("pred_disc"),
        _flag(F.col("l_quantity") > 25).alias("pred_qty"),
        "l_linestatus", "p_type", "p_brand",
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "p_size",
    )
    return AuditView(df, ["disc", "qty"], ["l_linestatus", "p_type", "p_brand"],
                     {"l_linestatus": "F"})


def event_audit(spark: SparkSession, sf_dir: str) -> AuditView:
    """events; purchases are the outcome, users bucketed into 4 groups."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    df = e.select(
        F.col("event_id").alias("row_id"),
        _flag(F.col("event_type") == "purchase").alias("y_true"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("score"),
        _flag(F.col("value") > 50).alias("pred_value50"),
        (F.col("user_id") % 4).cast("string").alias("user_bucket"),
    )
    return AuditView(df, ["value50"], ["user_bucket"], {})


def line_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_audit with injected nulls (l_tax 0 -> null; flag A on open lines -> null)."""
    d = line_audit(spark, sf_dir).df
    return d.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        F.expr("nullif(l_tax, 0.0)").alias("l_tax"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), None)
         .otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "p_type", "p_brand", "p_size")


def order_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-ish order table for the detection scans (target y_true)."""
    return order_audit(spark, sf_dir).df.select(
        "y_true", "o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name", "r_name", "c_acctbal")


def line_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-ish line table for the detection scans (target y_true)."""
    return line_audit(spark, sf_dir).df.select(
        "y_true", "l_linestatus", "p_type", "p_brand", "p_size", "l_quantity", "l_discount",
        "l_tax", "l_extendedprice")
