"""Run a registered query and its SQL oracle side by side (local check tool)."""

from __future__ import annotations

import math

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duckdb_frame(sql: str, sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name, query, sql, sf_dir):
    sp = query(spark, sf_dir).toPandas()
    dk = duckdb_frame(sql, sf_dir)
    c1, r1 = rows_of(sp)
    c2, r2 = rows_of(dk)
    ok = c1 == c2 and r1 == r2
    detail = ""
    if not ok:
        if c1 != c2:
            detail = f"columns differ: {c1} vs {c2}"
        elif len(r1) != len(r2):
            detail = f"rows {len(r1)} vs {len(r2)}"
        else:
            diffs = [(a, b) for a, b in zip(r1, r2) if a != b]
            detail = f"{len(diffs)} rows differ, first: {diffs[:2]}"
    return ok, len(r1), detail
