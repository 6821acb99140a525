"""Hard negatives by angular triangle filtering over integer vectors.

Vectors are scaled and floored to integers; a score is an integer inner
product. Each row stores its norm and its angles to a few reference
directions. The angle between an anchor and a row lies between the greatest
difference and the least sum of their angles to one reference (and the sum's
complement to a full turn); its cosine times both norms, widened by more than
the rounding of doubles, bounds the score. A score is computed only where
these bounds overlap the window that still matters: for positives the scores
from the anchor's fifth best on, for negatives from the third best of each
positive's window on, up to the window's end.

References are centres of spherical k-means, fitted on a bounded hash sample;
they only steer how much is filtered, never the result.

Rows are range-partitioned by label, nearest reference and angle into slices,
so a frequent label is many slices and a tile of neighbouring rows has narrow
angles; anchors are numbered in the same order and cut into chunks. A task streams one slice
past one chunk: it holds the chunk, its best candidates, and one tile. Only
those candidates, a few per anchor, leave a task.

Defined results: rows with a null label, a null vector or a null or
non-finite component take no part, nor do rows of another length than the
anchor's; a null vec_id is no anchor and comes last in ties; equal vec_ids
are rows of their own (ties between them go by an arbitrary fixed order), so a
repeated anchor returns its rows repeatedly; all-zero vectors score 0;
scores beyond the range of a long are an error; an empty table gives an empty
result; columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.spherical_cells import spherical_kmeans
from evenkeel.session import written

SCALE, RELABEL, LABELS, ANCHORS = 256, 7, 10, 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least this and at most that share (percent) of the positive's.
LOW, HIGH = 50, 95
REFERENCES = 8
#: Vectors that references are fitted on, at most about so many (chosen by a hash).
SAMPLE = 4000
#: Anchors held by a task, and slices that the rows are streamed in.
CHUNK, SLICES = 8192, 32
#: Rows and anchors whose scores are computed at once.
TILE, GROUP = 512, 512
#: Doubles keep angles and bounds to far less than this.
SLACK = 1e-6


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, as doubles (exact)."""
    return np.floor(SCALE * vectors.astype(np.float64))


def reference_directions(dim: int, fitted: dict[int, np.ndarray]) -> np.ndarray:
    """Unit reference directions for vectors of a length: fitted ones, else the first axes."""
    got = fitted.get(dim)
    return got if got is not None else np.eye(min(dim, REFERENCES), dim)


def norms_and_angles(q: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norm of each row and its angle to each reference (0 for a zero row)."""
    top = np.abs(q).max(axis=1, keepdims=True)
    norm = (top * np.sqrt(((q / np.where(top > 0, top, 1)) ** 2).sum(axis=1, keepdims=True)))[:, 0]
    cosine = (q / np.where(norm > 0, norm, 1)[:, None]) @ references.T
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def score_bounds(norm_a: np.ndarray, angle_a: np.ndarray, norm_x: np.ndarray,
                 angle_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of safe lower and upper bounds of the scores of rows a with rows x."""
    least = np.zeros((len(norm_a), len(norm_x)))
    most = np.full_like(least, np.pi)
    for r in range(angle_a.shape[1]):
        a, x = angle_a[:, r, None], angle_x[None, :, r]
        np.maximum(least, np.abs(a - x), out=least)
        total = a + x
        np.minimum(most, np.minimum(total, 2 * np.pi - total), out=most)
    length = norm_a[:, None] * norm_x[None, :]
    slack = SLACK * length + 1
    # Angles of zero rows mean nothing, but their length makes both bounds 0.
    low = np.cos(np.minimum(most + SLACK, np.pi)) * length - slack
    high = np.cos(np.maximum(least - SLACK, 0)) * length + slack
    return low, high


def integer_scores(a: np.ndarray, x: np.ndarray, longest: float) -> np.ndarray:
    """Exact inner products of integer rows, as int64; ``longest`` bounds |a| |x|."""
    if longest < 2 ** 53:  # no partial sum exceeds |a| |x|, so doubles are exact
        return (a @ x.T).astype(np.int64)
    if longest < 2 ** 62:
        return a.astype(np.int64) @ x.astype(np.int64).T
    raise ValueError("scores exceed 64 bits; scale the vectors down")


class Rows:
    """Columns of a stretch of rows of one length."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.row = batch.column("row").to_numpy(zero_copy_only=False)
        # Null ids come last in ties.
        self.vec_id = batch.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.label = batch.column("label").to_numpy(zero_copy_only=False)
        self.norm = batch.column("norm").to_numpy(zero_copy_only=False)
        n = batch.num_rows
        self.q = quantised(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
        self.angles = batch.column("angles").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)

    def __len__(self) -> int:
        return len(self.row)


class Best:
    """The best ``k`` candidates of each of ``n`` lists, by score, then smaller vec_id, then row."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.floor = np.full(n, np.iinfo(np.int64).min)  # score of the k-th best so far
        self.full = np.zeros(n, bool)
        self.kept = tuple(np.empty(0, np.int64) for _ in range(4))  # list, score, vec_id, row

    def add(self, where: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(where):
            return
        every = [np.concatenate(p) for p in zip(self.kept, (where, score, vec_id, row))]
        order = np.lexsort((every[3], every[2], -every[1], every[0]))
        every = [e[order] for e in every]
        starts = np.flatnonzero(np.r_[True, every[0][1:] != every[0][:-1]])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        last = rank == self.k - 1
        self.floor[every[0][last]] = every[1][last]
        self.full[every[0][last]] = True
        self.kept = tuple(e[rank < self.k] for e in every)


def _positives(anchors: Rows, best: Best, some: np.ndarray, tile: Rows) -> None:
    """Add the tile's candidates among rows of an anchor's label."""
    same = anchors.label[some][:, None] == tile.label[None, :]
    same &= anchors.row[some][:, None] != tile.row[None, :]
    if not same.any():
        return
    _, high = score_bounds(anchors.norm[some], anchors.angles[some], tile.norm, tile.angles)
    open_ = same & (~best.full[some][:, None] | (high >= best.floor[some][:, None]))
    a, x = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(a):
        return
    longest = anchors.norm[some[a]].max() * tile.norm[x].max()
    score = integer_scores(anchors.q[some[a]], tile.q[x], longest)
    i, j = np.nonzero(open_[np.ix_(a, x)] & (score >= best.floor[some[a]][:, None]))
    best.add(some[a[i]], score[i, j], tile.vec_id[x[j]], tile.row[x[j]])


def _negatives(anchors: Rows, windows: np.ndarray, best: Best, some: np.ndarray, tile: Rows) -> None:
    """Add the tile's candidates in the windows of an anchor's positives; list = anchor * POSITIVES + positive."""
    other = anchors.label[some][:, None] != tile.label[None, :]
    if not other.any():
        return
    slot = some[:, None] * POSITIVES + np.arange(POSITIVES)
    low, high = windows[some, :, 0], windows[some, :, 1]  # an absent positive has an empty window
    floor = np.maximum(low, np.where(best.full[slot], best.floor[slot], low))
    used = low <= high
    wanted = np.where(used, floor, np.iinfo(np.int64).max).min(axis=1)
    limit = np.where(used, high, np.iinfo(np.int64).min).max(axis=1)
    least, most = score_bounds(anchors.norm[some], anchors.angles[some], tile.norm, tile.angles)
    open_ = other & (most >= wanted[:, None]) & (least <= limit[:, None]) & used.any(axis=1)[:, None]
    a, x = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(a):
        return
    longest = anchors.norm[some[a]].max() * tile.norm[x].max()
    score = integer_scores(anchors.q[some[a]], tile.q[x], longest)
    near = open_[np.ix_(a, x)] & (score >= wanted[a][:, None]) & (score <= limit[a][:, None])
    i, j = np.nonzero(near)
    value = score[i, j]
    for p in range(POSITIVES):
        good = used[a[i], p] & (value >= floor[a[i], p]) & (value <= high[a[i], p])
        best.add(slot[a[i[good]], p], value[good], tile.vec_id[x[j[good]]], tile.row[x[j[good]]])


_FOUND = pa.schema([("anchor", pa.int64()), ("positive", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()),
                    ("row", pa.int64())])
_FOUND_DDL = "anchor long, positive int, score long, vec_id long, row long"


def _search(negatives: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream (length, chunk, slice) tasks: the chunk's anchors first, then the slice's rows tile by tile."""
    task, parts, anchors, windows, best = None, [], None, None, None
    width = POSITIVES if negatives else 1

    def found() -> pa.RecordBatch:
        where, score, vec_id, row = best.kept if best is not None else (np.empty(0, np.int64),) * 4
        names = anchors.row[where // width] if len(where) else where
        ids = pa.array(vec_id, mask=vec_id == np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array((where % width).astype(np.int32)), pa.array(score),
                                           ids, pa.array(row)], schema=_FOUND)

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "chunk", "slice", "is_anchor"))))
        at = 0
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            part, (*now, is_anchor) = batch.slice(at, stop - at), keys[at]
            at = stop
            if now != task:
                if anchors is not None:
                    yield found()
                task, parts, anchors, best = now, [], None, None
            if is_anchor:
                parts.append(part)
                continue
            if not parts and anchors is None:
                continue  # no anchor of this chunk
            if anchors is None:
                whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                anchors, parts = Rows(whole), []
                if negatives:
                    windows = (whole.column("windows").flatten().flatten().to_numpy(zero_copy_only=False)
                               .reshape(len(anchors), POSITIVES, 2))
                best = Best(len(anchors) * width, NEGATIVES if negatives else POSITIVES)
            for first in range(0, part.num_rows, TILE):
                tile = Rows(part.slice(first, TILE))
                for begin in range(0, len(anchors), GROUP):
                    some = np.arange(begin, min(begin + GROUP, len(anchors)))
                    if negatives:
                        _negatives(anchors, windows, best, some, tile)
                    else:
                        _positives(anchors, best, some, tile)
    if anchors is not None:
        yield found()


def _search_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _search(False, batches)


def _search_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _search(True, batches)


def _angles(fitted: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                q = quantised(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                norm, angles = norms_and_angles(q, reference_directions(d, fitted))
                home = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("row", "vec_id", "label", "dim", "vector")]
                    + [pa.array(norm), pa.array(list(angles), pa.list_(pa.float64())), pa.array(home.astype(np.int32)),
                       pa.array(angles[np.arange(len(home)), home])],
                    ["row", "vec_id", "label", "dim", "vector", "norm", "angles", "home", "nearest"])
    return run


def prepared(vectors: DataFrame) -> DataFrame:
    """The rows that take part, with planted labels, norm, angles and slice; a written table."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = vectors.select(
        vec_id.alias("vec_id"),
        F.when(vec_id % RELABEL == 0, F.pmod(label + 1, F.lit(LABELS))).otherwise(label).alias("label"),
        F.col("embedding").cast("array<float>").alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = (rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & sound)
            .withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")))
    rows = written(rows, "vectors")
    total = rows.count()
    wanted = int(min(1.0, SAMPLE / max(total, 1)) * 1_000_000)
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < wanted).select("dim", "vector").collect()
    fitted = {}
    for d in {s["dim"] for s in sample}:
        q = quantised(np.array([s["vector"] for s in sample if s["dim"] == d], np.float32))
        length = np.sqrt((q * q).sum(axis=1, keepdims=True))
        q = (q / np.where(length > 0, length, 1))[length[:, 0] > 0]
        if len(q) >= REFERENCES:
            fitted[d] = spherical_kmeans(q, REFERENCES)
    angled = rows.select("row", "vec_id", "label", "dim", "vector").mapInArrow(
        _angles(fitted), "row long, vec_id long, label long, dim int, vector array<float>, norm double, "
                         "angles array<double>, home int, nearest double")
    order = ["dim", "label", "home", "nearest", "row"]
    return written(angled.repartitionByRange(SLICES, *order).withColumn("slice", F.spark_partition_id()), "angled")


def _paired(rows: DataFrame, anchors: DataFrame, run, same_label: bool) -> DataFrame:
    """Every slice streamed past every chunk of its length (and, for positives, of its labels)."""
    key = ["dim", "chunk", "slice"]
    on = ["dim", "label"] if same_label else ["dim"]
    cols = ["row", "vec_id", "label", "vector", "norm", "angles", "home", "nearest", "is_anchor", "windows"]
    chunks = anchors.select(*on, "chunk").distinct()
    none = F.lit(None).cast("array<array<long>>")
    stream = rows.join(chunks, on).withColumn("is_anchor", F.lit(False)).withColumn("windows", none)
    slices = rows.select(*on, "slice").distinct()
    wanted = slices.join(chunks, on).select("dim", "chunk", "slice").distinct()
    held = anchors.drop("slice").join(wanted, ["dim", "chunk"]).withColumn("is_anchor", F.lit(True))
    if "windows" not in anchors.columns:
        held = held.withColumn("windows", none)
    both = held.select(*key, *cols).unionByName(stream.select(*key, *cols))
    return (both.repartition(*key).sortWithinPartitions(*key, F.desc("is_anchor"), "label", "home", "nearest")
            .mapInArrow(run, _FOUND_DDL))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = prepared(vectors)
    anchors = rows.where(F.col("vec_id") % ANCHORS == 0)
    order = ["dim", "label", "home", "nearest", "row"]
    held = written(anchors.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("at", F.monotonically_increasing_id())
                   .withColumn("part", F.shiftright("at", 33)), "anchors")
    counts = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per task
    offsets = written(counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")),
                      "anchor_counts")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    anchors = written(held.join(offsets, "part").withColumn("chunk", F.floor(place / CHUNK))
                      .drop("at", "part", "before"), "chunks")

    last_null = F.coalesce("vec_id", F.lit(2 ** 63 - 1))
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), last_null, "row")
    positives = written(_paired(rows, anchors, _search_positives, True)
                        .withColumn("at", F.row_number().over(best) - 1).where(F.col("at") < POSITIVES)
                        .select("anchor", "at", F.col("vec_id").alias("positive_id"),
                                F.col("score").alias("positive_score")), "positives")
    # 50 p <= 100 n <= 95 p, over whole numbers: n from ceil(p / 2) to floor(95 p / 100).
    p = F.col("positive_score")
    start = F.expr(f"-((-{LOW} * positive_score - pmod(-{LOW} * positive_score, 100)) div 100)")
    stop = F.expr(f"({HIGH} * positive_score - pmod({HIGH} * positive_score, 100)) div 100")
    lists = positives.groupBy("anchor").agg(
        F.map_from_entries(F.collect_list(F.struct("at", F.array(start, stop)))).alias("by_place"))  # at most five
    empty = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    windows = F.array(*(F.coalesce(F.try_element_at("by_place", F.lit(i)), empty) for i in range(POSITIVES)))
    searching = written(anchors.join(lists, F.col("row") == F.col("anchor")).withColumn("windows", windows)
                        .drop("anchor", "by_place"), "anchors")

    best = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), last_null, "row")
    negatives = (_paired(rows, searching, _search_negatives, False)
                 .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES)
                 .select("anchor", F.col("positive").alias("at"), "rank", F.col("vec_id").alias("negative_id"),
                         F.col("score").alias("negative_score")))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (negatives.join(positives, ["anchor", "at"]).join(names, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


ORACLE = f"""
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
           [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
scored AS (
    SELECT a.vec_id AS anchor_id, x.vec_id AS other_id, a.label = x.label AS same,
           CAST(list_inner_product(a.q, x.q) AS BIGINT) AS score
    FROM rows a JOIN rows x ON a.vec_id % {ANCHORS} = 0 AND a.vec_id <> x.vec_id),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place
        FROM scored WHERE same) WHERE place <= {POSITIVES}),
ranked AS (
    SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS place
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    WHERE {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE place <= {NEGATIVES}
"""
