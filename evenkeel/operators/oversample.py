"""Group-balanced oversampling with synthetic rows.

Every compound cell (label * 2 + is_privileged) is lifted to the size of the
largest one. A synthetic row lies between a row of its cell and one of that
row's nearest neighbours (``neighbours.nearest``), at a random share of the
way. Rows serve as base equally often, give or take one, the first in hash
order once more; neighbour and share are hashes of the row's key, its rank in the
cell and the copy, so reruns agree however the rows are partitioned.
"""

from __future__ import annotations

from typing import Optional, Sequence, Tuple

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.scalar import compound_cell
from evenkeel.operators.mitigate import is_privileged
from evenkeel.operators.neighbours import nearest
from evenkeel.operators.numbering import rank_within, sorted_table
from evenkeel.session import written

K_NEIGHBOURS = 5          # fixed values of the reference: k, and k of the class-level fallback
K_FALLBACK = 3
SEED = 42
#: Synthetic rows made from one base row in one task.
PORTION = 1000


def cell_plan(df: DataFrame, attribute: str, privileged: str, y: str = "y_true") -> DataFrame:
    """(cell, y, is_priv, n, deficit, enough_neighbours) for the present cells.

    ``deficit`` = rows to synthesise so the cell reaches the largest cell;
    ``enough_neighbours`` is false when a cell with a deficit has at most
    k rows (the oversampling then falls back to whole classes).
    """
    ip = is_privileged(attribute, privileged)
    cells = df.groupBy(compound_cell(F.col(y), ip).alias("cell"), F.col(y).cast("int").alias("y"),
                       ip.alias("is_priv")).agg(F.count(F.lit(1)).alias("n"))
    biggest = F.max("n").over(Window.partitionBy())   # at most four rows
    out = cells.withColumn("deficit", biggest - F.col("n"))
    return out.withColumn("enough_neighbours", (F.col("deficit") == 0) | (F.col("n") > K_NEIGHBOURS))


def signature(x: Column, n_numbers: int, blocks: Sequence[int]) -> Column:
    """Category codes of a prepared feature array: per one-hot block the place of its 1, 0 if there is none."""
    codes, at = [], n_numbers
    for size in blocks:
        codes.append(F.array_position(F.slice(x, at + 1, size), 1.0).cast("int") if size else F.lit(0))
        at += size
    return F.array(*codes) if codes else F.array().cast("array<int>")


def _plan(rows: DataFrame, k: int) -> Optional[dict]:
    """Deficit per cell, or None if a cell with a deficit has too few rows for k neighbours."""
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    need = {c: max(sizes.values()) - n for c, n in sizes.items()}
    return None if any(need[c] and sizes[c] <= k for c in sizes) else {c: (need[c], sizes[c]) for c in sizes}


def synthesise(train: DataFrame, attribute: str, privileged: str, key: Sequence[str], y: str = "y_true",
               features: str = "features", layout: Optional[Tuple[int, Sequence[int]]] = None) -> DataFrame:
    """The synthetic rows: ``features``, ``y_true``, ``is_priv`` (null from whole classes), base, neighbour, share.

    ``layout``: how many leading features are numbers, and the sizes of the one-hot blocks after them
    (None: all are numbers). If a cell that needs rows has at most 5, whole classes are balanced
    with 3 neighbours; if a class then has at most 3 rows, that is an error.
    """
    ip, label = is_privileged(attribute, privileged), F.col(y).cast("int")
    x = vector_to_array(features)
    k = K_NEIGHBOURS
    plan = _plan(train.select(compound_cell(label, ip).alias("cell")), k)
    cell = compound_cell(label, ip)
    if plan is None:
        k, cell, ip = K_FALLBACK, label, F.lit(None).cast("boolean")
        plan = _plan(train.select(cell.alias("cell")), k)
        if plan is None:
            raise ValueError(f"a class to be oversampled has at most {k} rows")
    held = sorted_table(train.select(cell.cast("long").alias("cell"), label.alias("y"), ip.alias("is_priv"),
                                     x.alias("all"), F.xxhash64(*key, F.lit(SEED)).alias("h")),
                        ["cell"], ["h", "all"], "cells")
    times = F.lit(0)
    for c, (need, n) in plan.items():  # at most four cells
        more = F.when(F.col("rank") <= need % n, 1).otherwise(0)
        times = F.when(F.col("cell") == c, F.lit(need // n) + more).otherwise(times)
    ranked = written(rank_within(held.select("cell", "row"), ["cell"]).withColumn("times", times.cast("long")), "ranks")

    width = held.select(F.size("all").alias("d")).first()
    n_numbers, blocks = layout if layout is not None else (width["d"] if width else 0, ())
    searched = (held.where(F.col("cell").isin([c for c, (need, _) in plan.items() if need]))
                .join(ranked.select("row", "times"), "row")
                .select("cell", "row", signature(F.col("all"), n_numbers, blocks).alias("codes"),
                        F.slice("all", 1, n_numbers).alias("x"), (F.col("times") > 0).alias("wanted")))
    near = written(nearest(searched, k), "neighbours")

    # Neighbours' features come to the base row before it is multiplied: a base row of any number of
    # synthetic rows is joined once.
    lists = (near.join(held.select(F.col("row").alias("neighbour"), F.col("all").alias("other")), "neighbour")
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "neighbour", "other"))).alias("near")))
    base = (held.select("row", "y", "is_priv", "h", "all").join(lists, "row")
            .join(ranked.where("times > 0").select("row", "rank", "times"), "row"))
    portions = (base.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"),
                                                                F.expr(f"(times - 1) div {PORTION}"))))
                .repartition("row", "portion"))
    last = F.least(F.col("times") - 1, (F.col("portion") + 1) * PORTION - 1)
    each = portions.withColumn("copy", F.explode(F.sequence(F.col("portion") * PORTION, last)))
    chosen = F.element_at("near", F.pmod(F.xxhash64("h", "rank", "copy", F.lit(SEED)), F.lit(k)).cast("int") + 1)
    share = F.pmod(F.xxhash64("copy", "rank", "h", F.lit(SEED + 1)), F.lit(1 << 30)) / float(1 << 30)
    made = each.select("y", "is_priv", "row", "all", chosen.alias("to"), share.alias("share"))
    between = F.zip_with("all", "to.other", lambda a, b: a + F.col("share") * (b - a))
    return made.select(array_to_vector(between).alias("features"), F.col("y").alias("y_true"), "is_priv",
                       F.col("row").alias("base"), F.col("to.neighbour").alias("neighbour"), "share")


def oversample(train: DataFrame, attribute: str, privileged: str, key: Sequence[str], y: str = "y_true",
               features: str = "features", layout: Optional[Tuple[int, Sequence[int]]] = None) -> DataFrame:
    """The training rows and the synthetic ones: ``features``, ``y_true``, ``is_priv``, ``synthetic``."""
    own = train.select(F.col(features).alias("features"), F.col(y).cast("int").alias("y_true"),
                       is_privileged(attribute, privileged).alias("is_priv"), F.lit(False).alias("synthetic"))
    made = synthesise(train, attribute, privileged, key, y, features, layout)
    return own.unionByName(made.select("features", "y_true", "is_priv", F.lit(True).alias("synthetic")))
