"""Exact path-dependent tree attribution for Spark tree models.

The fitted trees are read through Spark ML's public persistence format
(saved to the session's shared checkpoint folder), giving a node table
whose size is bounded by the model, not the data. All that the trees can tell
of a row is its cell: per feature, where its value lies among their thresholds.
Rows are coded as cells, and each distinct cell is explained once, whichever
rows have it, in sorted Arrow batches, leaf by leaf: a leaf's share of a cell
depends only on which of the (at most depth) features on its path the cell
agrees with, so it is computed once per such pattern and looked up per cell.
Values are in probability units of class 1; a forest's attribution is the
mean over its trees. Per row, sum(phi) = f(x) - E[f] (local accuracy).
"""

from __future__ import annotations

import uuid
from functools import lru_cache
from typing import Dict, List, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.session import checkpoint_dir, tasks, written


class Tree:
    """Node arrays of one binary tree (index = node id).

    A node of fewer than ``min_split`` training rows is a leaf, whatever it was split into: as splits
    are chosen from the root down, that is the tree that a learner with this minimum grows.
    """

    def __init__(self, nodes: List[dict], min_split: int = 0):
        n = max(r["id"] for r in nodes) + 1
        self.left = np.full(n, -1)
        self.right = np.full(n, -1)
        self.feat = np.full(n, -1)
        self.thr = np.zeros(n)
        self.cats: Dict[int, set] = {}
        self.value = np.zeros(n)
        self.cover = np.zeros(n)
        self.rows = np.zeros(n)
        self.gain = np.zeros(n)
        for r in nodes:
            i = r["id"]
            stats = r["impurityStats"] or []
            tot = float(sum(stats))
            self.value[i] = (stats[1] / tot) if tot > 0 and len(stats) > 1 else 0.0
            self.cover[i] = tot if tot > 0 else float(r["rawCount"] or 0)
            self.rows[i] = float(r["rawCount"] or tot)
            if r["leftChild"] >= 0 and self.rows[i] >= min_split:
                sp = r["split"]
                self.left[i], self.right[i] = r["leftChild"], r["rightChild"]
                self.gain[i] = r.get("gain") or 0.0
                self.feat[i] = sp["featureIndex"]
                if sp["numCategories"] is not None and sp["numCategories"] > 0:
                    self.cats[i] = set(sp["leftCategoriesOrThreshold"])
                else:
                    self.thr[i] = sp["leftCategoriesOrThreshold"][0]

    def expected_value(self) -> float:
        return float(sum(value * self.cover[leaf] for leaf, value in self.leaves()) / self.cover[0])

    def leaves(self) -> list:
        """(node, value) of the leaves that can be reached."""
        out, work = [], [0]
        while work:
            node = work.pop()
            if self.left[node] < 0:
                out.append((node, self.value[node]))
            else:
                work += [self.left[node], self.right[node]]
        return out

    def importances(self, n_features: int) -> np.ndarray:
        """Impurity decrease per feature, of the splits that can be reached; sums to 1 if there are any."""
        total, work = np.zeros(n_features), [0]
        while work:
            node = work.pop()
            if self.left[node] >= 0:
                total[self.feat[node]] += self.gain[node] * self.cover[node]
                work += [self.left[node], self.right[node]]
        return total / total.sum() if total.sum() > 0 else total

    def splits(self) -> List[int]:
        """Inner nodes that can be reached."""
        out, work = [], [0]
        while work:
            node = int(work.pop())
            if self.left[node] >= 0:
                out.append(node)
                work += [self.left[node], self.right[node]]
        return out

    def predict(self, X: np.ndarray) -> np.ndarray:
        node = np.zeros(len(X), dtype=int)
        rows = np.arange(len(X)) if self.left[0] >= 0 else np.arange(0)
        while len(rows):  # the rows that are not at a leaf, a level at a time
            at = node[rows]
            at = np.where(self._goes_left(X, at, rows), self.left[at], self.right[at])
            node[rows] = at
            rows = rows[self.left[at] >= 0]
        return self.value[node]

    def _goes_left(self, X: np.ndarray, nodes, rows=slice(None)) -> np.ndarray:
        """Do ``rows`` of ``X`` (default: all) go left at ``nodes``, one for all or one each?"""
        if np.isscalar(nodes):
            x = X[rows, self.feat[nodes]]
            return np.isin(x, list(self.cats[nodes])) if nodes in self.cats else x <= self.thr[nodes]
        x = X[np.arange(len(X))[rows], self.feat[nodes]]
        out = x <= self.thr[nodes]
        if self.cats:
            for node in np.unique(nodes).tolist():
                if node in self.cats:
                    here = nodes == node
                    out[here] = np.isin(x[here], list(self.cats[node]))
        return out

    def paths(self) -> list:
        """Per leaf: value, its features, their cover ratios, and per feature the (node, left?) steps."""
        if not hasattr(self, "_paths"):
            self._paths, work = [], [(0, [])]
            while work:
                node, steps = work.pop()
                if self.left[node] < 0:
                    by: Dict[int, list] = {}
                    for at, left, ratio in steps:
                        by.setdefault(int(self.feat[at]), []).append((at, left, ratio))
                    self._paths.append((float(self.value[node]), list(by),
                                        np.array([np.prod([r for _, _, r in v]) for v in by.values()]),
                                        [[(at, left) for at, left, _ in v] for v in by.values()]))
                    continue
                for child, left in ((self.left[node], True), (self.right[node], False)):
                    if self.cover[child] > 0:  # no row ever came here: no share
                        work.append((child, [*steps, (node, left, self.cover[child] / self.cover[node])]))
        return self._paths


class Cells:
    """What trees can tell of rows: per feature, the place of its value among their thresholds, or which of
    the categories they name it is. Rows of equal codes take the same way through every tree."""

    def __init__(self, trees: List[Tree], n_features: int) -> None:
        marks: List[set] = [set() for _ in range(n_features)]
        self.named = set()
        for t in trees:
            for node in t.splits():
                f = int(t.feat[node])
                if node in t.cats:
                    self.named.add(f)
                    marks[f] |= t.cats[node]
                else:
                    marks[f].add(float(t.thr[node]))
        self.marks = [np.array(sorted(m), float) for m in marks]
        #: Features by how finely they are cut: rows sorted in this order share most of what a tree asks.
        self.order = sorted(range(n_features), key=lambda f: (len(self.marks[f]), f))

    def codes(self, X: np.ndarray) -> np.ndarray:
        out = np.zeros(X.shape, np.int32)
        for f, m in enumerate(self.marks):
            if len(m):
                at = np.searchsorted(m, X[:, f])  # NaN is above all, as it never goes left
                out[:, f] = np.where(m[np.minimum(at, len(m) - 1)] == X[:, f], at, len(m)) if f in self.named else at
        return out

    def values(self, codes: np.ndarray) -> np.ndarray:
        """Rows that have these codes."""
        out = np.zeros(codes.shape)
        for f, m in enumerate(self.marks):
            if len(m):
                out[:, f] = np.append(m, np.nan if f in self.named else np.inf)[codes[:, f]]
        return out

    def distinct(self, X: np.ndarray) -> tuple:
        """(first row of each cell, cell of each row)."""
        codes, key, size = self.codes(X), np.zeros(len(X), np.int64), 1
        for f in self.order:
            if len(self.marks[f]):
                if size * (len(self.marks[f]) + 1) >= 1 << 62:  # number the cells so far
                    key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                    size = len(X)
                key = key * (len(self.marks[f]) + 1) + codes[:, f]
                size *= len(self.marks[f]) + 1
        _, first, cell = np.unique(key, return_index=True, return_inverse=True)
        return first, cell


#: Rows explained at once; patterns of more features than this are found by sorting.
STRETCH, TABLE_BITS = 4096, 14


_legendre = lru_cache(np.polynomial.legendre.leggauss)


def pattern_shares(agrees: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Shapley values (patterns x features) of a leaf of value 1.

    A feature in the coalition leads to the leaf if the row ``agrees`` with its conditions, one
    outside it with probability ``ratios``. Averaged over all orders, feature i adds
    (agrees_i - ratio_i) * integral over t in [0, 1] of the product over the others j of
    (ratio_j (1 - t) + agrees_j t): a polynomial, which Gauss-Legendre points integrate exactly.
    """
    n = agrees.shape[1]
    points, weights = _legendre(n // 2 + 1)
    t, weights = (points + 1) / 2, weights / 2
    factor = ratios[None, :, None] * (1 - t) + agrees[:, :, None] * t  # above 0, as ratios are and t < 1
    others = factor.prod(axis=1, keepdims=True) / factor
    return (agrees - ratios) * (others @ weights)


def tree_shap(tree: Tree, X: np.ndarray) -> np.ndarray:
    """Attributions (rows x features) of one tree for a batch of rows; rows of one cell are explained once."""
    if not hasattr(tree, "_cells"):
        tree._cells = Cells([tree], X.shape[1])
    first, cell = tree._cells.distinct(X)
    return _tree_shap(tree, X[first])[cell]


def _tree_shap(tree: Tree, X: np.ndarray) -> np.ndarray:
    phi = np.zeros(X.shape)
    inner = tree.splits()
    for begin in range(0, len(X), STRETCH):
        rows = X[begin:begin + STRETCH]
        left = {node: tree._goes_left(rows, node) for node in inner}
        for value, features, ratios, steps in tree.paths():
            if not features or value == 0:
                continue
            code = np.zeros(len(rows), np.int64)
            for bit, conditions in enumerate(steps):
                agrees = np.ones(len(rows), bool)
                for node, to_left in conditions:
                    agrees &= left[node] if to_left else ~left[node]
                code |= agrees.astype(np.int64) << bit
            if len(features) <= TABLE_BITS:
                there = np.flatnonzero(np.bincount(code, minlength=1 << len(features)))
                place = np.zeros(1 << len(features), np.int64)
                place[there] = np.arange(len(there))
                where = place[code]
            else:
                there, where = np.unique(code, return_inverse=True)
            shares = value * pattern_shares((there[:, None] >> np.arange(len(features)) & 1).astype(float), ratios)
            phi[begin:begin + STRETCH, features] += shares[where]
    return phi


def load_trees(model, min_split: int = 0) -> List[Tree]:
    """Node tables of a tree or forest, from Spark ML or already loaded (``model.trees`` as a list)."""
    if isinstance(getattr(model, "trees", None), list) and model.trees and isinstance(model.trees[0], Tree):
        return model.trees
    spark = _active()
    path = f"{checkpoint_dir(spark).rstrip('/')}/evenkeel-trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "treeID" in data.columns:
        rows = data.select("treeID", "nodeData.*").collect()
        by: Dict[int, list] = {}
        for r in rows:
            by.setdefault(r["treeID"], []).append(r.asDict())
        return [Tree(by[k], min_split) for k in sorted(by)]
    return [Tree([r.asDict() for r in data.collect()], min_split)]


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def tree_attribution(model, rows: DataFrame, feature_names: Sequence[str], keep: Sequence[str],
                     features: str = "features") -> DataFrame:
    """Long-form (keep..., feature, phi) for every row of ``rows``."""
    trees, names, d = load_trees(model), list(feature_names), len(feature_names)
    cells = Cells(trees, d)
    # model-sized node arrays, shipped once per executor instead of per task
    shared = rows.sparkSession.sparkContext.broadcast((trees, cells))
    held = rows.select(*keep, vector_to_array(features).alias("_x"))

    def code(batches):
        order = shared.value[1].order
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            yield batch.drop_columns(["_x"]).append_column("_cell", _lists(shared.value[1].codes(x)[:, order], pa.int32()))

    def explain(batches):
        forest, cells = shared.value
        for batch in batches:
            codes = np.empty((batch.num_rows, d), np.int32)
            codes[:, cells.order] = batch.column("_cell").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x, phi = cells.values(codes), np.zeros((batch.num_rows, d))
            for t in forest:
                phi += tree_shap(t, x)
            yield batch.append_column("_phi", _lists(phi / len(forest), pa.float64()))

    cell = T.StructField("_cell", T.ArrayType(T.IntegerType()))
    coded = written(held.mapInArrow(code, T.StructType([f for f in held.schema.fields if f.name != "_x"] + [cell])), "cells")
    apart = (coded.select("_cell").distinct().repartitionByRange(tasks(rows.sparkSession), "_cell")
             .sortWithinPartitions("_cell"))
    explained = written(apart.mapInArrow(explain, T.StructType([cell, T.StructField("_phi", T.ArrayType(T.DoubleType()))])),
                        "explained")
    long = coded.join(explained, "_cell").select(*keep, F.posexplode("_phi").alias("pos", "phi"))
    return long.select(*keep, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1).alias("feature"), "phi")


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def expected_value(model) -> float:
    trees = load_trees(model)
    return float(np.mean([t.expected_value() for t in trees]))
