"""Logistic regression by Newton steps, warm-started (the fits of M12-M16).

Rows are packed once into blocks of arrays, which stay with the executors. A
step reads the blocks once: every partition sums loss, gradient and Gram
matrix (weighted by p(1-p)) of its rows, the sums of many partitions are added
up on executors, and the driver solves one (features + 1)-square system. A start value near the answer, as from the last
strategy or the last round of the reduction, leaves two to four steps.

The objective is the one of ``models.build``: summed weighted loss plus
``|coefficients|^2 / (2 C)``, the intercept free.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import List, Optional, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.operators import models

#: Mean gradient at which a fit has converged, and the most steps.
TOLERANCE = 1e-9
MAX_STEPS = 100
#: How often a step is halved at most.
HALVINGS = 19
#: Widest Gram matrix kept (32 MB); more features are fitted by Spark ML.
MAX_FEATURES = 2000
#: Partial sums that the driver adds up by itself.
DRIVER_SUMS = 64
#: Bytes of features in a block of rows.
BLOCK_BYTES = 1 << 20


@dataclass
class LogisticFit:
    """``gradient``: largest component of the mean gradient at the result; ``passes``: reads of the rows."""
    coefficients: np.ndarray
    intercept: float
    gradient: Optional[float]
    passes: int
    extra: Optional[np.ndarray] = None

    @property
    def start(self) -> np.ndarray:
        return np.append(self.coefficients, self.intercept)


def margin(x: Column, weights: Sequence[float], intercept: float) -> Column:
    """Linear margin of a feature array."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(x, w, lambda a, c: a * c), F.lit(float(intercept)), lambda acc, v: acc + v)


def score(fit: LogisticFit, df: DataFrame, name: str, keep: Sequence[str], features: str = "features") -> DataFrame:
    """Predictions as (keep..., model, y_pred, score) with score = P(y = 1)."""
    m = margin(vector_to_array(features), fit.coefficients, fit.intercept)
    out = df.select(*keep, F.lit(name).alias("model"), m.alias("_m"))
    return out.select(*keep, "model", (F.col("_m") > 0).cast("int").alias("y_pred"),
                      (1 / (1 + F.exp(-F.col("_m")))).alias("score"))


@dataclass
class Block:
    """Some rows as arrays: features, labels, weights (None: all 1), codes of their groups (None: not asked)."""
    x: np.ndarray
    y: np.ndarray
    w: Optional[np.ndarray]
    a: Optional[np.ndarray]


def _packer(groups: Optional[List[str]], weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.unique(batch.column("_x").value_lengths().to_numpy(zero_copy_only=True))
            if len(lengths) > 1:
                raise ValueError(f"feature vectors of {lengths.min()} and {lengths.max()} numbers")
            width = int(lengths[0])
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=True).reshape(batch.num_rows, width)
            y = batch.column("_y").to_numpy(zero_copy_only=True).astype(np.int8)
            w = batch.column("_w").to_numpy(zero_copy_only=True) if weighted else None
            a = group_codes(batch, groups).astype(np.int32) if groups is not None else None
            step = max(1, BLOCK_BYTES // (8 * max(width, 1)))
            for at in range(0, len(y), step):
                cut = [v if v is None else np.ascontiguousarray(v[at:at + step]).tobytes() for v in (x, y, w, a)]
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *[pa.array([v], pa.binary()) for v in cut]],
                                                 names=["width", "x", "y", "w", "a"])
    return run


def _unpacked(row) -> Block:
    width, x, y, w, a = row
    y = np.frombuffer(y, np.int8)
    return Block(np.frombuffer(x, np.float64).reshape(len(y), width), y, None if w is None else np.frombuffer(w, np.float64),
                 None if a is None else np.frombuffer(a, np.int32))


def packed(rows: DataFrame, groups: Optional[List[str]] = None) -> RDD:
    """Rows (``_x`` array of doubles, ``_y`` 0/1, ``_w`` weight if there is one, ``_a`` if ``groups`` are given)
    as ``Block`` bytes, kept until ``unpersist``: a pass over them moves whole arrays, not values."""
    blocks = spread(rows).mapInArrow(_packer(groups, "_w" in rows.columns),
                                     "width int, x binary, y binary, w binary, a binary")
    return blocks.rdd.map(lambda r: tuple(None if v is None else int(v) if i == 0 else bytes(v) for i, v in enumerate(r))
                          ).persist(StorageLevel.MEMORY_AND_DISK)


def _sums(beta: np.ndarray, targets: Callable, extra: Optional[Callable], n_extra: int):
    def run(rows: Iterator) -> Iterator[np.ndarray]:
        size = len(beta)
        total = np.zeros(1 + size + size * size + n_extra)
        loss, gradient, gram, more = total[:1], total[1:1 + size], total[1 + size:1 + size + size * size], total[1 + size + size * size:]
        gram = gram.reshape(size, size)
        for block in map(_unpacked, rows):
            x = block.x
            y, w = targets(block)
            z = x @ beta[:-1] + beta[-1]
            e = np.exp(-np.abs(z))
            p = np.where(z >= 0, 1.0, e) / (1 + e)
            off, curve = w * (p - y), w * (e / (1 + e) ** 2)
            loss += (w * (np.log1p(e) + np.maximum(z, 0) - y * z)).sum()
            gradient[:-1] += x.T @ off
            gradient[-1] += off.sum()
            side = x.T @ curve
            gram[:-1, :-1] += x.T @ (x * curve[:, None])
            gram[:-1, -1] += side
            gram[-1, :-1] += side
            gram[-1, -1] += curve.sum()
            if extra is not None:
                more += extra(block, z)
        yield total
    return run


def _losses(beta: np.ndarray, step: np.ndarray, shares: np.ndarray, targets: Callable):
    def run(rows: Iterator) -> Iterator[np.ndarray]:
        total = np.zeros(len(shares))
        for block in map(_unpacked, rows):
            y, w = targets(block)
            z, down = block.x @ beta[:-1] + beta[-1], block.x @ step[:-1] + step[-1]
            for i, share in enumerate(shares):
                at = z - share * down
                total[i] += (w * (np.log1p(np.exp(-np.abs(at))) + np.maximum(at, 0) - y * at)).sum()
        yield total
    return run


def minimise(blocks: RDD, width: int, targets: Callable, total: float, start: Optional[np.ndarray] = None,
             tolerance: float = TOLERANCE, extra: Optional[Callable] = None, n_extra: int = 0,
             decrease: float = 0.0) -> LogisticFit:
    """Fit ``packed`` rows of ``width`` features.

    ``targets(block)`` gives labels and weights, ``total`` is the sum of the weights;
    ``extra(block, margins)`` gives ``n_extra`` sums at the same place, whose values at the result
    are returned. Steps that raise the objective are halved; one pass finds how often. Ends at the
    ``tolerance`` of the mean gradient, or once a step promises to lower the mean loss by ``decrease`` or less.
    """
    ridge = np.append(np.full(width, 1.0 / models.C), 0.0)
    scale = max(total, 1e-300)
    wide = blocks.getNumPartitions() > DRIVER_SUMS
    cut = 1 + width + 1, 1 + width + 1 + (width + 1) ** 2

    def added(run: Callable) -> np.ndarray:
        parts = blocks.mapPartitions(run)
        return parts.treeReduce(np.add) if wide else np.sum(parts.collect(), axis=0)

    def at(beta: np.ndarray):
        s = added(_sums(beta, targets, extra, n_extra))
        return (s[0] + 0.5 * float(ridge @ (beta * beta)), s[1:cut[0]] + ridge * beta,
                s[cut[0]:cut[1]].reshape(width + 1, width + 1) + np.diag(ridge), s[cut[1]:])

    beta = np.zeros(width + 1) if start is None else np.asarray(start, float).copy()
    value, gradient, gram, more = at(beta)
    passes = 1
    for _ in range(MAX_STEPS):
        if np.abs(gradient).max() <= tolerance * scale:
            break
        step = np.linalg.lstsq(gram, gradient, rcond=None)[0]
        if 0.5 * float(gradient @ step) <= decrease * scale:
            break
        new = beta - step
        got = at(new)
        passes += 1
        most = value + 1e-12 * abs(value)
        if got[0] > most:
            shares = 0.5 ** np.arange(1, HALVINGS + 1)
            values = added(_losses(beta, step, shares, targets)) + [
                0.5 * float(ridge @ (beta - share * step) ** 2) for share in shares]
            passes += 1
            low = np.flatnonzero(values <= most)
            if not len(low):
                break
            new = beta - shares[low[0]] * step
            got = at(new)
            passes += 1
        beta, (value, gradient, gram, more) = new, got
    return LogisticFit(beta[:-1], float(beta[-1]), float(np.abs(gradient).max() / scale), passes, more)


def _own_targets(block: Block):
    return block.y.astype(float), np.ones(len(block.y)) if block.w is None else block.w


def _head(rows: Iterator) -> Iterator[tuple]:
    for block in map(_unpacked, rows):
        yield block.x.shape[1], float(_own_targets(block)[1].sum()), int(block.y.min()), int(block.y.max())


def _both(a: tuple, b: tuple) -> tuple:
    return max(a[0], b[0]), a[1] + b[1], min(a[2], b[2]), max(a[3], b[3])


def fit(train: DataFrame, weight_col: Optional[str] = None, label: str = "y_true", features: str = "features",
        start: Optional[np.ndarray] = None, tolerance: float = TOLERANCE) -> LogisticFit:
    """L2 logistic regression of ``train``, from ``start`` (coefficients, then the intercept) if given."""
    weight = [F.col(weight_col).cast("double").alias("_w")] if weight_col else []
    blocks = packed(train.select(vector_to_array(features).alias("_x"), F.col(label).cast("int").alias("_y"), *weight))
    try:
        width, total, low, high = blocks.mapPartitions(_head).fold((0, 0.0, 2, -1), _both)
        if high < 0:
            raise ValueError("no rows to fit")
        if low == high:  # one class: its constant is the limit of the fits
            return LogisticFit(np.zeros(width), math.inf if high == 1 else -math.inf, None, 1)
        if width > MAX_FEATURES:
            m = models.build("logistic_regression", total, weight_col, label=label, features=features).fit(train)
            return LogisticFit(m.coefficients.toArray(), float(m.intercept), None, int(m.summary.totalIterations))
        return minimise(blocks, width, _own_targets, total, start, tolerance)
    finally:
        blocks.unpersist()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores: a fit reads them many times, however few files they came in. By hash of
    ``keys``, if given, so that every run deals them alike."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if rows.rdd.getNumPartitions() < cores else rows


def group_codes(batch: pa.RecordBatch, groups: List[str]) -> np.ndarray:
    """Position of each row's ``_a`` in ``groups``."""
    coded = batch.column("_a").dictionary_encode()
    where = {g: i for i, g in enumerate(groups)}
    return np.array([where[g] for g in coded.dictionary.to_pylist()], np.int64)[
        coded.indices.to_numpy(zero_copy_only=False)]
