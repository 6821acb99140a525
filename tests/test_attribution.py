"""Tree and sampled attributions: local accuracy invariants."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from evenkeel.operators import explain, models, newton, treeshap


def _data(spark, n=300):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        x = rng.normal(size=4)
        y = float(x[0] + 0.5 * x[1] * x[2] > 0)
        rows.append((i, Vectors.dense(x.tolist()), y))
    return spark.createDataFrame(rows, ["row_id", "features", "y_true"])


@pytest.mark.parametrize("kind", ["dt", "rf"])
def test_tree_shap_local_accuracy(spark, kind):
    df = _data(spark)
    est = (DecisionTreeClassifier(maxDepth=5, labelCol="y_true", seed=1) if kind == "dt"
           else RandomForestClassifier(numTrees=5, maxDepth=4, labelCol="y_true", seed=1))
    m = est.fit(df)
    names = ["a", "b", "c", "d"]
    phi = treeshap.tree_attribution(m, df, names, ["row_id"])
    s = phi.groupBy("row_id").agg(F.sum("phi").alias("s"))
    p = m.transform(df).select("row_id", vector_to_array("probability")[1].alias("p"))
    ev = treeshap.expected_value(m)
    got = s.join(p, "row_id").collect()
    assert len(got) == 300
    for r in got:
        assert r.s == pytest.approx(r.p - ev, abs=1e-6)


def test_tree_shap_single_split_by_hand():
    # one split on feature 0 at 0.5: left leaf P=0 (cover 3), right leaf P=1 (cover 1)
    t = treeshap.Tree([
        {"id": 0, "impurityStats": [3.0, 1.0], "rawCount": 4, "leftChild": 1, "rightChild": 2,
         "split": {"featureIndex": 0, "leftCategoriesOrThreshold": [0.5], "numCategories": -1}},
        {"id": 1, "impurityStats": [3.0, 0.0], "rawCount": 3, "leftChild": -1, "rightChild": -1,
         "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}},
        {"id": 2, "impurityStats": [0.0, 1.0], "rawCount": 1, "leftChild": -1, "rightChild": -1,
         "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}])
    phi = treeshap.tree_shap(t, np.array([[1.0, 7.0], [0.0, 7.0]]))
    assert phi[0, 0] == pytest.approx(0.75) and phi[1, 0] == pytest.approx(-0.25)
    assert phi[0, 1] == 0.0


def test_sampled_attribution_sums_close(spark):
    df = _data(spark, 120)
    m = DecisionTreeClassifier(maxDepth=3, labelCol="y_true", seed=1).fit(df)
    phi = explain.sampled_attribution(m, df.limit(20), df, ["a", "b", "c", "d"], ["row_id"], "row_id",
                                      permutations=6, background_size=30)
    assert phi.count() == 80
    assert phi.where(F.col("phi").isNull()).count() == 0


def _subsets(features):
    return itertools.chain.from_iterable(itertools.combinations(features, k) for k in range(len(features) + 1))


def _brute_shapley(tree, x):
    """Shapley values over all coalitions; a feature outside one is averaged by cover."""
    d = len(x)

    def value(node, known):
        if tree.left[node] < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if tree.feat[node] in known:
            return value(left if tree._goes_left(x[None], int(node))[0] else right, known)
        return sum(tree.cover[c] * value(c, known) for c in (left, right)) / tree.cover[node]

    phi = np.zeros(d)
    for i in range(d):
        for s in _subsets([j for j in range(d) if j != i]):
            share = math.factorial(len(s)) * math.factorial(d - 1 - len(s)) / math.factorial(d)
            phi[i] += share * (value(0, {*s, i}) - value(0, set(s)))
    return phi


def test_leaf_patterns_equal_all_coalitions(spark):
    df = _data(spark)
    m = RandomForestClassifier(numTrees=3, maxDepth=6, labelCol="y_true", seed=2).fit(df)
    x = np.array([r["features"].toArray() for r in df.limit(12).collect()])
    for tree in treeshap.load_trees(m):
        assert np.allclose(treeshap.tree_shap(tree, x), [_brute_shapley(tree, r) for r in x], atol=1e-12)


def test_wide_paths_and_stretches_agree(spark, monkeypatch):
    df = _data(spark)
    tree = treeshap.load_trees(DecisionTreeClassifier(maxDepth=8, labelCol="y_true").fit(df))[0]
    x = np.array([r["features"].toArray() for r in df.collect()])
    want = treeshap.tree_shap(tree, x)
    monkeypatch.setattr(treeshap, "STRETCH", 7)
    monkeypatch.setattr(treeshap, "TABLE_BITS", 1)
    assert np.allclose(treeshap.tree_shap(tree, x), want, atol=1e-12)


@pytest.mark.parametrize("kind", ["linear", "tree"])
def test_sampled_attribution_sums_to_the_score(spark, kind):
    df = _data(spark, 150)
    m = (newton.fit(df.withColumn("y_true", F.col("y_true").cast("int"))) if kind == "linear"
         else DecisionTreeClassifier(maxDepth=4, labelCol="y_true").fit(df))
    names = ["a", "b", "c", "d"]
    out = explain.sampled_attribution(m, df.repartition(5), df, names, ["row_id"], "row_id", permutations=4,
                                      background_size=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(row_id" not in plan
    score = explain.scorer(m)
    x = {r["row_id"]: r["features"].toArray() for r in df.collect()}
    first = explain.sample_rows(df.select("row_id"), 1, ["row_id"]).first()["row_id"]
    got = {r["row_id"]: r["s"] for r in out.groupBy("row_id").agg(F.sum("phi").alias("s")).collect()}
    assert len(got) == 150
    for i, s in got.items():
        assert s == pytest.approx(float(score(x[i][None])[0] - score(x[first][None])[0]), abs=1e-9)
    again = explain.sampled_attribution(m, df, df, names, ["row_id"], "row_id", permutations=4, background_size=1)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_linear_walks_are_exact():
    """With a linear score every order gives w_j (x_j - b_j)."""
    rng = np.random.default_rng(0)
    x, base, w = rng.normal(size=(20, 5)), rng.normal(size=(1, 5)), rng.normal(size=5)
    phi = explain.walks(x, np.arange(20, dtype=np.uint64), base, lambda z: z @ w, 3)
    assert np.allclose(phi, (x - base) * w)


def test_forest_splits_no_small_node(spark):
    df = _data(spark).withColumn("y_true", F.col("y_true").cast("int"))
    grown = RandomForestClassifier(numTrees=8, maxDepth=7, labelCol="y_true", seed=3).fit(df)
    as_grown, pruned = models.Forest(grown, 0), models.Forest(grown, 40)
    p = {r["row_id"]: r["p"] for r in grown.transform(df).select("row_id", vector_to_array("probability")[1].alias("p")).collect()}
    same = {r["row_id"]: r["score"] for r in models.score(as_grown, df, "m", ["row_id"]).collect()}
    assert all(same[i] == pytest.approx(v, abs=1e-9) for i, v in p.items())
    assert np.allclose(as_grown.featureImportances.toArray(), grown.featureImportances.toArray(), atol=1e-9)
    for t, full in zip(pruned.trees, as_grown.trees):
        inner = np.flatnonzero(t.left >= 0)
        assert (t.rows[inner] >= 40).all() and len(t.leaves()) < len(full.leaves())
        # Every collapsed node had been split below the minimum, and what is above it is as grown.
        gone = np.setdiff1d(np.flatnonzero(full.left >= 0), inner)
        assert (full.rows[gone] < 40).all() and (t.feat[inner] == full.feat[inner]).all()
    attr = treeshap.tree_attribution(pruned, df, ["a", "b", "c", "d"], ["row_id"])
    scores = {r["row_id"]: r["score"] for r in models.score(pruned, df, "m", ["row_id"]).collect()}
    base = treeshap.expected_value(pruned)
    for r in attr.groupBy("row_id").agg(F.sum("phi").alias("s")).collect():
        assert r["s"] == pytest.approx(scores[r["row_id"]] - base, abs=1e-9)


def _random_tree(rng, n_features, depth, named=()):
    nodes = []

    def grow(node, left):
        f = int(rng.integers(n_features))
        leaf = left == 0
        size = 1 if leaf else 2
        if not leaf:
            cats = [float(v) for v in rng.choice(4, 2, replace=False)] if f in named else None
            split = {"featureIndex": f, "leftCategoriesOrThreshold": cats or [round(float(rng.normal()), 1)],
                     "numCategories": 4 if cats else -1}
            a = grow(2 * node + 1, left - 1)
            b = grow(2 * node + 2, left - 1)
            stats = [u + v for u, v in zip(a, b)]
        else:
            split, stats = {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}, [
                float(rng.integers(1, 9)), float(rng.integers(0, 9))]
        nodes.append({"id": node, "impurityStats": stats, "rawCount": int(sum(stats)), "split": split,
                      "leftChild": 2 * node + 1 if size == 2 else -1, "rightChild": 2 * node + 2 if size == 2 else -1})
        return stats

    grow(0, depth)
    return treeshap.Tree(nodes)


def _walk(tree, x):
    node = 0
    while tree.left[node] >= 0:
        f = tree.feat[node]
        left = x[f] in tree.cats[node] if node in tree.cats else x[f] <= tree.thr[node]
        node = tree.left[node] if left else tree.right[node]
    return tree.value[node]


def _odd_rows(rng, n):
    x = rng.normal(size=(n, 4)).round(1)
    x[:, 3] = rng.integers(0, 6, n)
    x[::17, 0], x[::19, 3], x[::23, 1] = np.nan, np.nan, np.inf
    return x


def test_predictions_step_all_rows_together():
    """Scoring takes a few array operations a level, no Python step per row (200,000 rows took 2 s and more)."""
    import time
    rng = np.random.default_rng(3)
    tree = _random_tree(rng, 4, 7, named={3})
    x = _odd_rows(rng, 500)
    assert tree.predict(x).tolist() == [_walk(tree, r) for r in x]
    assert tree.predict(x[:0]).tolist() == []
    plain = _random_tree(rng, 4, 7)
    many = rng.normal(size=(200_000, 4))
    start = time.process_time()
    plain.predict(many)
    assert time.process_time() - start < 1.0


def test_cells_hold_rows_that_trees_cannot_tell_apart():
    rng = np.random.default_rng(4)
    trees = [_random_tree(rng, 4, 6, named={3}) for _ in range(3)]
    cells = treeshap.Cells(trees, 4)
    x = _odd_rows(rng, 800)
    codes = cells.codes(x)
    back = cells.values(codes)
    assert (cells.codes(back) == codes).all()
    first, cell = cells.distinct(x)
    assert (codes[first][cell] == codes).all() and len(first) == len(np.unique(codes, axis=0))
    for t in trees:
        assert t.predict(back).tolist() == t.predict(x).tolist()
        assert np.allclose(treeshap.tree_shap(t, x), treeshap._tree_shap(t, x), rtol=0, atol=1e-12)


def test_a_cell_is_explained_once(spark, monkeypatch):
    """Rows that the trees cannot tell apart are explained once, whatever their number, and all returned."""
    train = _data(spark)
    m = RandomForestClassifier(numTrees=3, maxDepth=3, labelCol="y_true", seed=1).fit(train)
    made = spark.range(4000).select("id", F.array(*[F.pmod(F.col("id"), F.lit(k)) / 2.0 - 1 for k in (2, 3, 2, 3)]).alias("x"))
    from pyspark.ml.functions import array_to_vector
    rows = made.select("id", array_to_vector("x").alias("features"))
    kept = []
    monkeypatch.setattr(treeshap, "written", lambda df, name: kept.append((name, df.persist())) or df)
    phi = treeshap.tree_attribution(m, rows, ["a", "b", "c", "d"], ["id"])
    trees = treeshap.load_trees(m)
    got = {}
    for r in phi.collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["phi"]
    assert len(got) == 4000 and all(len(v) == 4 for v in got.values())
    for r in made.where("id < 12").collect():
        want = np.mean([treeshap._tree_shap(t, np.array([r["x"]]))[0] for t in trees], axis=0)
        assert [got[r["id"]][f] for f in "abcd"] == pytest.approx(want.tolist(), abs=1e-12)
    assert dict(kept)["explained"].count() <= 6
    for _, df in kept:
        df.unpersist()


def test_training_all_models_scores_rows_once(spark, monkeypatch):
    """The predictions that several tables are made of are one written table."""
    df = _data(spark)
    names = []
    monkeypatch.setattr(models, "written", lambda d, name: names.append(name) or d)
    res = models.train_all(df, df, ["row_id", "y_true"], ["decision_tree"])
    assert names == ["predictions"] and res.predictions.count() == 300
    assert models.build("random_forest", 1.0).getCacheNodeIds()
