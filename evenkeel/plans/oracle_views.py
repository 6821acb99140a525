"""The audit views written as SQL, for the DuckDB oracle strings.

Kept textually equal to the DataFrame definitions in
``evenkeel.sources.views``; each oracle query starts with these CTEs.
"""

DOC_AUDIT = """
doc_audit AS (
  SELECT d.doc_id AS row_id, CAST(l.quality AS INTEGER) AS y_true,
         least(d.n_chars / 20000.0, 1.0) AS score,
         CAST(d.n_chars >= 400 AS INTEGER) AS pred_len400,
         CAST(d.n_chars >= 1500 AS INTEGER) AS pred_len1500,
         CAST(coalesce(l.toxic = 0, false) AS INTEGER) AS pred_nontoxic,
         d.lang, d.source
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""

ORDER_AUDIT = """
order_audit AS (
  SELECT o.o_orderkey AS row_id,
         CAST(coalesce(o.o_totalprice > 250000, false) AS INTEGER) AS y_true,
         least(greatest((c.c_acctbal + 1000) / 11000, 0.0), 1.0) AS score,
         CAST(coalesce(c.c_acctbal > 5000, false) AS INTEGER) AS pred_acctbal,
         CAST(coalesce(o.o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AS INTEGER) AS pred_priority,
         CAST(coalesce(o.o_orderstatus = 'F', false) AS INTEGER) AS pred_status_f,
         c.c_mktsegment, r.r_name, o.o_orderstatus, n.n_name, o.o_orderpriority,
         c.c_acctbal, o.o_totalprice
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

LINE_AUDIT = """
line_audit AS (
  SELECT CAST(coalesce(l.l_returnflag = 'R', false) AS INTEGER) AS y_true,
         l.l_discount * 10 AS score,
         CAST(coalesce(l.l_discount > 0.05, false) AS INTEGER) AS pred_disc,
         CAST(coalesce(l.l_quantity > 25, false) AS INTEGER) AS pred_qty,
         l.l_linestatus, p.p_type, p.p_brand,
         l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount,
         l.l_tax, l.l_returnflag, p.p_size
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
)"""

EVENT_AUDIT = """
event_audit AS (
  SELECT event_id AS row_id,
         CAST(coalesce(event_type = 'purchase', false) AS INTEGER) AS y_true,
         least(value / 500, 1.0) AS score,
         CAST(coalesce(value > 50, false) AS INTEGER) AS pred_value50,
         CAST(user_id % 4 AS VARCHAR) AS user_bucket
  FROM events
)"""

# long predictions: one row per (row, model)
ORDER_LONG = """
order_long AS (
  SELECT row_id, y_true, score, c_mktsegment, r_name, o_orderstatus,
         'acctbal' AS model, pred_acctbal AS y_pred FROM order_audit
  UNION ALL
  SELECT row_id, y_true, score, c_mktsegment, r_name, o_orderstatus,
         'priority', pred_priority FROM order_audit
  UNION ALL
  SELECT row_id, y_true, score, c_mktsegment, r_name, o_orderstatus,
         'status_f', pred_status_f FROM order_audit
)"""

DOC_LONG = """
doc_long AS (
  SELECT row_id, y_true, score, lang, source, 'len400' AS model, pred_len400 AS y_pred FROM doc_audit
  UNION ALL SELECT row_id, y_true, score, lang, source, 'len1500', pred_len1500 FROM doc_audit
  UNION ALL SELECT row_id, y_true, score, lang, source, 'nontoxic', pred_nontoxic FROM doc_audit
)"""

LINE_LONG = """
line_long AS (
  SELECT y_true, score, l_linestatus, p_type, p_brand, 'disc' AS model, pred_disc AS y_pred FROM line_audit
  UNION ALL SELECT y_true, score, l_linestatus, p_type, p_brand, 'qty', pred_qty FROM line_audit
)"""

EVENT_LONG = """
event_long AS (
  SELECT row_id, y_true, score, user_bucket, 'value50' AS model, pred_value50 AS y_pred FROM event_audit
)"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)

LINE_NULLS = """
line_nulls AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         nullif(l_tax, 0.0) AS l_tax,
         CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN NULL ELSE l_returnflag END AS l_returnflag,
         l_linestatus, p_type, p_brand, p_size
  FROM line_audit
)"""

ORDER_DETECT = """
order_detect AS (
  SELECT y_true, o_orderstatus, o_orderpriority, c_mktsegment, n_name, r_name, c_acctbal
  FROM order_audit
)"""

LINE_DETECT = """
line_detect AS (
  SELECT y_true, l_linestatus, p_type, p_brand, p_size, l_quantity, l_discount, l_tax, l_extendedprice
  FROM line_audit
)"""
