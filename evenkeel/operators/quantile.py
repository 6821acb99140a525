"""Exact order statistics without a single-task collect.

``exact_medians`` finds the exact median (mean of the two middle values,
like NumPy) of several columns at once by histogram refinement: each pass
is one scan with a partially aggregated ``groupBy(column, bin)`` whose
output is bounded by ``bins`` rows per column; the pass keeps only the bin
that holds the wanted rank and narrows the value range to it. Passes stop
when a bin holds one distinct value or few enough rows to read directly.
"""

from __future__ import annotations

from typing import Dict, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
DIRECT = 4096


def _melt(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
              .unpivot([], list(cols), "column", "x").where(F.abs("x") < float("inf")))


def exact_kth(df: DataFrame, targets: Dict[str, list],
              ranges: Dict[str, tuple] = None) -> Dict[str, list]:
    """targets: column -> list of 0-based ranks; returns column -> values.
    ``ranges`` (column -> (min, max)) skips the range pass when known."""
    cols = list(targets)
    if not cols:
        return {}
    long = _melt(df, cols)
    rng = ranges or {r["column"]: (r["lo"], r["hi"]) for r in
                     long.groupBy("column").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    # state per (column, rank): lo, hi, rank within [lo, hi]
    state = {(c, k): [rng[c][0], rng[c][1], k] for c in cols for k in targets[c] if c in rng}
    result: Dict[tuple, float] = {}
    while state:
        open_ = {key: st for key, st in state.items() if st[0] == st[1]}
        for key, st in open_.items():
            result[key] = st[0]
            del state[key]
        if not state:
            break
        # one pass: histogram per open interval (ranks of one column share a pass)
        intervals = {}
        for (c, k), (lo, hi, _) in state.items():
            intervals.setdefault((c, lo, hi), []).append(k)
        sel = None
        for (c, lo, hi) in intervals:
            term = (F.col("column") == c) & (F.col("x") >= lo) & (F.col("x") <= hi)
            sel = term if sel is None else sel | term
        lo_c = F.lit(None).cast("double")
        hi_c = F.lit(None).cast("double")
        for (c, lo, hi) in intervals:
            lo_c = F.when((F.col("column") == c) & (F.col("x") >= lo) & (F.col("x") <= hi),
                          F.lit(lo)).otherwise(lo_c)
            hi_c = F.when((F.col("column") == c) & (F.col("x") >= lo) & (F.col("x") <= hi),
                          F.lit(hi)).otherwise(hi_c)
        part = long.where(sel).withColumn("_lo", lo_c).withColumn("_hi", hi_c)
        # halves: the width of a finite range stays finite; its ends fall into different bins
        b = F.least(F.floor((F.col("x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * BINS),
                    F.lit(BINS - 1)).cast("int")
        hist = (part.groupBy("column", "_lo", "_hi", b.alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"))
                .collect())
        by_iv: Dict[tuple, list] = {}
        for r in hist:
            by_iv.setdefault((r["column"], r["_lo"], r["_hi"]), []).append(r)
        direct = []
        for (c, k), st in list(state.items()):
            rows = sorted(by_iv[(c, st[0], st[1])], key=lambda r: r["bin"])
            acc = 0
            for r in rows:
                if st[2] < acc + r["n"]:
                    st[0], st[1], st[2] = r["mn"], r["mx"], st[2] - acc
                    if r["mn"] != r["mx"] and r["n"] <= DIRECT:
                        direct.append((c, k, r["mn"], r["mx"], st[2]))
                    break
                acc += r["n"]
        for c, k, lo, hi, kk in direct:
            vals = [r["x"] for r in long.where((F.col("column") == c) & (F.col("x") >= lo)
                                               & (F.col("x") <= hi)).orderBy("x")
                    .select("x").collect()]
            result[(c, k)] = vals[kk]
            del state[(c, k)]
    return {c: [result[(c, k)] for k in targets[c]] for c in cols if c in rng}


def exact_medians(df: DataFrame, cols: Sequence[str]) -> Dict[str, float]:
    """Exact median of each column (None if empty).

    NaN is missing; infinities count as the least and greatest values, and
    only the finite ones between them are searched.
    """
    cols = list(cols)
    if not cols:
        return {}
    inf = float("inf")
    aggs = []
    for c in cols:  # one pass: counts and finite range of every column
        x = F.col(c).cast("double")
        finite = F.when(F.abs(x) < inf, x)
        aggs += [F.count(finite).alias(f"n_{c}"), F.count_if(x == -inf).alias(f"neg_{c}"),
                 F.count_if(x == inf).alias(f"pos_{c}"), F.min(finite).alias(f"lo_{c}"), F.max(finite).alias(f"hi_{c}")]
    r = df.agg(*aggs).first()
    wanted, targets, ranges = {}, {}, {}
    for c in cols:
        neg, n = r[f"neg_{c}"], r[f"n_{c}"]
        total = neg + n + r[f"pos_{c}"]
        wanted[c] = [k - neg for k in ((total - 1) // 2, total // 2)] if total else None
        inside = sorted({k for k in wanted[c] or [] if 0 <= k < n})
        if inside:
            targets[c], ranges[c] = inside, (r[f"lo_{c}"], r[f"hi_{c}"])
    vals = exact_kth(df, targets, ranges)
    out = {}
    for c in cols:
        if wanted[c] is None:
            out[c] = None
            continue
        known = dict(zip(targets.get(c, []), vals.get(c, [])))
        a, b = (known.get(k, -inf if k < 0 else inf) for k in wanted[c])
        out[c] = a if a == b else a / 2.0 + b / 2.0
    return out
