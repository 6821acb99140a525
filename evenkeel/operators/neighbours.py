"""Exact k nearest neighbours of prepared rows, best first over category signatures (for M13).

A prepared row is a few numbers and one-hot blocks that leave out their first
category, so a squared distance is the numeric one plus, per column whose
categories differ, 2 (1 where one of them is the first category). Rows are
sorted by cell, signature (their category codes) and numbers, and cut into
leaves of neighbouring rows, inside a signature by medians of the widest
number. A leaf knows which categories it holds, the box of its numbers, and
how far its rows must look: their k-th distance within the leaf. Consecutive
leaves form nodes, those form larger nodes, and a pair of nodes is opened
only while the least distance between them is within the reach of the first.
Surviving pairs of leaves are compared nearest first.

No step pairs all rows, or all leaves, of a cell: roots are at most ``FAN``
per cell, and what follows from them is pruned level by level.

Defined results: distances are compared as (squared distance, row), so ties go
to the smaller row number; equal rows are neighbours at distance 0; a cell of
k rows or fewer returns the neighbours that there are; NaN is not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import List, Tuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import tasks, written

#: Rows of a leaf, rows that a task sorts into leaves at once, children of a node.
LEAF, RUN, FAN = 64, 8192, 32


def squared_distances(codes_a: np.ndarray, x_a: np.ndarray, codes_b: np.ndarray, x_b: np.ndarray) -> np.ndarray:
    """Matrix of squared distances; code 0 is the category that one-hot encoding leaves out."""
    out = np.zeros((len(codes_a), len(codes_b)))
    for c in range(codes_a.shape[1]):
        a, b = codes_a[:, c, None], codes_b[None, :, c]
        out += np.where(a == b, 0, (a > 0).astype(float) + (b > 0))
    for p in range(x_a.shape[1]):
        out += (x_a[:, p, None] - x_b[None, :, p]) ** 2
    return out


def first_k(distance: np.ndarray, rows: np.ndarray, k: int) -> Tuple[np.ndarray, np.ndarray]:
    """Per line the k least (distance, row) in order; both matrices alike."""
    if distance.shape[1] > 4 * k:  # drop what is beyond the k-th distance before sorting
        limit = np.partition(distance, k - 1, axis=1)[:, k - 1:k]
        most = int((distance <= limit).sum(axis=1).max())
        near = np.argsort(np.where(distance <= limit, 0, 1), axis=1, kind="stable")[:, :most]
        distance = np.where(np.take_along_axis(distance <= limit, near, 1), np.take_along_axis(distance, near, 1), np.inf)
        rows = np.take_along_axis(rows, near, 1)
    order = np.lexsort((rows, distance), axis=1)[:, :k]
    return np.take_along_axis(distance, order, 1), np.take_along_axis(rows, order, 1)


def _leaves_of(codes: np.ndarray, x: np.ndarray, leaf: int) -> List[np.ndarray]:
    """Positions of sorted rows as leaves: halved in order, inside one signature by the widest number."""
    out, work = [], [np.arange(len(codes))]
    while work:
        part = work.pop()
        if len(part) <= leaf:
            out.append(part)
            continue
        half = len(part) // 2
        if x.shape[1] and (codes[part] == codes[part[0]]).all():
            widest = int(np.ptp(x[part], axis=0).argmax())
            part = part[np.argsort(x[part, widest], kind="stable")]
        work += [part[half:], part[:half]]
    return out


_LEAF_DDL = ("cell long, part int, seq long, row array<long>, codes array<int>, x array<double>, wanted array<boolean>, "
             "masks array<long>, lo array<double>, hi array<double>, reach double")


def _build(k: int, leaf: int, run_rows: int, n_codes: int, n_x: int):
    names = [c.split()[0] for c in _LEAF_DDL.split(", ")]

    def leaves(cell, row, codes, x, wanted, seq) -> Iterator[dict]:
        for n, part in enumerate(_leaves_of(codes, x, leaf)):
            reach = -1.0
            some = part[wanted[part]]
            if len(some):
                pool = part if len(part) > k else np.arange(len(row))
                if len(pool) > k:
                    d = squared_distances(codes[some], x[some], codes[pool], x[pool])
                    d[row[some][:, None] == row[pool][None, :]] = np.inf
                    reach = float(np.partition(d, k - 1, axis=1)[:, k - 1].max())
                else:
                    reach = float("inf")
            held = codes[part]
            masks = [int(np.bitwise_or.reduce(np.where(held[:, c] == 0, 1, 2 << (held[:, c].astype(np.int64) % 61))))
                     for c in range(n_codes)]
            yield dict(zip(names, (cell, TaskContext.get().partitionId(), seq + n, row[part].tolist(),
                                   held.ravel().tolist(), x[part].ravel().tolist(), wanted[part].tolist(), masks,
                                   x[part].min(axis=0).tolist(), x[part].max(axis=0).tolist(), reach)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        seqs: dict = {}

        def flush(cell) -> Iterator[pa.RecordBatch]:
            parts = held.pop(cell)
            row, codes, x, wanted = (np.concatenate(v) for v in zip(*parts))
            out = list(leaves(cell, row, codes, x, wanted, seqs.get(cell, 0)))
            seqs[cell] = seqs.get(cell, 0) + len(out)
            yield pa.RecordBatch.from_pylist(out, schema=_LEAF_SCHEMA)

        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(len(cells), n_codes)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(cells), n_x)
            row = batch.column("row").to_numpy(zero_copy_only=False)
            wanted = batch.column("wanted").to_numpy(zero_copy_only=False)
            for cell in np.unique(cells).tolist():
                for other in [c for c in held if c != cell]:  # sorted by cell: the others are complete here
                    yield from flush(other)
                mine = np.flatnonzero(cells == cell)
                for at in range(0, len(mine), run_rows):
                    some = mine[at:at + run_rows]
                    held.setdefault(cell, []).append((row[some], codes[some], x[some], wanted[some]))
                    if sum(len(p[0]) for p in held[cell]) >= run_rows:
                        yield from flush(cell)
        for cell in list(held):
            yield from flush(cell)
    return run


_LEAF_SCHEMA = pa.schema([
    ("cell", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("row", pa.list_(pa.int64())),
    ("codes", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())), ("wanted", pa.list_(pa.bool_())),
    ("masks", pa.list_(pa.int64())), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
    ("reach", pa.float64())])


def _least_distance(n_codes: int, n_x: int) -> Column:
    """Lower bound of the squared distances between a node of ``q`` and one of ``d``."""
    total = F.lit(0.0)
    for c in range(n_codes):
        a, b = F.col(f"q.m{c}"), F.col(f"d.m{c}")
        either = a.bitwiseOR(b).bitwiseAND(F.lit(1)) != 0
        total = total + F.when(a.bitwiseAND(b) != 0, 0.0).when(either, 1.0).otherwise(2.0)
    for p in range(n_x):
        gap = F.greatest(F.col(f"q.lo{p}") - F.col(f"d.hi{p}"), F.col(f"d.lo{p}") - F.col(f"q.hi{p}"), F.lit(0.0))
        total = total + gap * gap
    return total


_FOUND_DDL = "row long, place int, neighbour long, d2 double"


def _compare(k: int, n_codes: int, n_x: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stream leaves sorted by (cell, q): q's own rows first, then the other leaves, nearest first."""
        key, mine, best = None, None, None

        def arrays(batch: pa.RecordBatch, i: int):
            row, codes, x, wanted = (batch.column(c)[i].values.to_numpy(zero_copy_only=False)
                                     for c in ("row", "codes", "x", "wanted"))
            return row, codes.reshape(len(row), n_codes), x.reshape(len(row), n_x), wanted.astype(bool)

        def found() -> pa.RecordBatch:
            d2, rows = best
            i, j = np.nonzero(np.isfinite(d2))
            return pa.RecordBatch.from_arrays([pa.array(mine[0][i]), pa.array(j.astype(np.int32)), pa.array(rows[i, j]),
                                               pa.array(d2[i, j])], ["row", "place", "neighbour", "d2"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "q", "least"))))
            for i, (cell, q, least) in enumerate(keys):
                if (cell, q) != key:
                    if best is not None:
                        yield found()
                    key, (row, codes, x, wanted) = (cell, q), arrays(batch, i)
                    mine = row[wanted], codes[wanted], x[wanted]
                    best = (np.full((len(mine[0]), k), np.inf), np.full((len(mine[0]), k), np.iinfo(np.int64).max))
                    continue
                if least > best[0][:, -1].max() * (1 + 1e-9) + 1e-12:
                    continue  # sorted by the least distance: nothing closer follows
                row, codes, x, _ = arrays(batch, i)
                d = squared_distances(mine[1], mine[2], codes, x)
                d[mine[0][:, None] == row[None, :]] = np.inf
                best = first_k(np.concatenate([best[0], d], axis=1),
                               np.concatenate([best[1], np.broadcast_to(row, d.shape)], axis=1), k)
        if best is not None:
            yield found()
    return run


def leaf_pairs(leaves: DataFrame, n_codes: int, n_x: int, fan: int = FAN) -> DataFrame:
    """cell, q, d, least: the pairs of leaves that may hold neighbours, by their numbers within the cell."""
    flat = leaves.select("cell", "node", "reach", *[F.col("masks")[c].alias(f"m{c}") for c in range(n_codes)],
                         *[F.col(s)[p].alias(f"{s}{p}") for s in ("lo", "hi") for p in range(n_x)])
    levels = [flat]
    most = flat.agg(F.max("node")).first()[0]
    while most is not None and most >= fan:
        up = levels[-1].groupBy("cell", F.expr(f"node div {fan}").alias("node")).agg(
            F.max("reach").alias("reach"), *[F.bit_or(f"m{c}").alias(f"m{c}") for c in range(n_codes)],
            *[F.min(f"lo{p}").alias(f"lo{p}") for p in range(n_x)], *[F.max(f"hi{p}").alias(f"hi{p}") for p in range(n_x)])
        levels.append(written(up, "nodes"))
        most //= fan
    pairs, least = None, _least_distance(n_codes, n_x)
    for level in reversed(levels):
        q = level.where("reach >= 0").withColumn("up", F.expr(f"node div {fan}")).alias("q")
        d = level.withColumn("up", F.expr(f"node div {fan}")).alias("d")
        if pairs is None:  # at most ``fan`` roots in a cell
            both = q.join(d, F.col("q.cell") == F.col("d.cell"))
        else:
            p = pairs.alias("p")
            both = (p.join(q, (F.col("p.cell") == F.col("q.cell")) & (F.col("p.q") == F.col("q.up")))
                    .join(d, (F.col("p.cell") == F.col("d.cell")) & (F.col("p.d") == F.col("d.up"))))
        pairs = written(both.withColumn("least", least)
                        .where(F.col("least") <= F.col("q.reach") * (1 + 1e-9) + 1e-12)
                        .select(F.col("q.cell").alias("cell"), F.col("q.node").alias("q"), F.col("d.node").alias("d"),
                                "least"), "node_pairs")
    return pairs


def build_leaves(rows: DataFrame, k: int, n_codes: int, n_x: int, leaf: int = LEAF, run_rows: int = RUN) -> DataFrame:
    """One row per leaf, numbered from 0 within its cell (``node``); a written table."""
    order = ["cell", "codes", "x", "row"]
    table = written(rows.select("cell", "row", "codes", "x", "wanted").repartitionByRange(tasks(rows.sparkSession), *order)
                    .sortWithinPartitions(*order).mapInArrow(_build(k, leaf, run_rows, n_codes, n_x), _LEAF_DDL), "leaves")
    counts = table.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("part")) - F.col("n")  # one row per task
    offsets = written(counts.select("cell", "part", before.alias("before")), "leaf_counts")
    return table.join(offsets, ["cell", "part"]).withColumn("node", F.col("seq") + F.col("before"))


def nearest(rows: DataFrame, k: int, leaf: int = LEAF, run_rows: int = RUN, fan: int = FAN) -> DataFrame:
    """row, place (from 0), neighbour, d2: the k nearest other rows of the same cell for each wanted row.

    ``rows``: cell long, row long (distinct), codes array<int>, x array<double>, wanted boolean; codes
    and x have the same lengths in every row.
    """
    head = rows.select(F.size("codes").alias("c"), F.size("x").alias("x")).first()
    n_codes, n_x = (head["c"], head["x"]) if head else (0, 0)
    leaves = written(build_leaves(rows, k, n_codes, n_x, leaf, run_rows), "numbered_leaves")
    pairs = leaf_pairs(leaves, n_codes, n_x, fan)
    payload = leaves.select("cell", "node", "row", "codes", "x", "wanted")
    own = (payload.join(leaves.where("reach >= 0").select("cell", "node"), ["cell", "node"])
           .withColumnRenamed("node", "q").withColumn("least", F.lit(-1.0)))
    others = pairs.join(payload.withColumnRenamed("node", "d"), ["cell", "d"])
    cols = ["cell", "q", "least", "row", "codes", "x", "wanted"]
    return (own.select(*cols).unionByName(others.select(*cols)).repartition(tasks(rows.sparkSession), "cell", "q")
            .sortWithinPartitions("cell", "q", "least").mapInArrow(_compare(k, n_codes, n_x), _FOUND_DDL))
