from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import lsh_forest as L
from evenkeel.llm import spherical_cells as C
from evenkeel.llm.components import components


def _least(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 2000 + i) for i in range(200)]
    want = _least({x for e in links for x in e}, links)
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        n = min(5, len(w))
        out[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    return out


def _brute(rows):
    sets = _sets(rows)
    holders = defaultdict(list)
    links = []
    for i, s in sets.items():
        common = Counter(j for x in s for j in holders[x])
        links += [(i, j) for j, k in common.items() if 5 * k >= 4 * (len(s) + len(sets[j]) - k)]
        for x in s:
            holders[x].append(i)
    return _least(sets, links), Counter(x for e in links for x in e)


def _compare(df, rows):
    got = {r["doc_id"]: r for r in df.collect()}
    classes, links = _brute(rows)
    assert {i: r["class_id"] for i, r in got.items()} == classes
    assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in got}
    assert {i for i, r in got.items() if r["kept"]} == {i for i, c in classes.items() if i == c}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _compare(L.join(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.fixture(scope="module")
def crowded():
    """A large group of near copies, chains of them, and a passage that many different texts share."""
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(4000)]

    def words(n):
        return [vocab[i] for i in rng.integers(0, len(vocab), n)]
    base, rows = words(160), []
    for i in range(150):
        t = list(base)
        for p in rng.integers(0, len(t), rng.integers(0, 6)):
            t[p] = f"x{i}_{p}"
        rows.append((i, " ".join(t)))
    chain = words(120)
    for i in range(25):  # neighbours are alike, ends are not
        rows.append((1000 + i, " ".join(chain)))
        p = 4 * i
        chain = chain[:p] + words(2) + chain[p + 2:]
    passage = words(70)
    rows += [(2000 + i, " ".join(words(60) + passage + words(60))) for i in range(120)]
    rows += [(3000 + i, " ".join(words(3))) for i in range(20)] + [(3100, "a b c"), (3101, "a  b\nc"), (3102, "a b c")]
    return rows


@pytest.mark.parametrize("block", [256, 16])
def test_crowded_groups_match_brute_force(spark, crowded, block):
    _compare(L.join(spark.createDataFrame(crowded, "doc_id long, text string").repartition(4), block=block), crowded)


def test_prefixes_are_shortened_until_the_recall(spark):
    k = L.prefix_length()
    assert 1 - (1 - 0.8 ** k) ** L.TREES >= L.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** L.TREES
    assert L.prefix_length(recall=0.5) > k


def _pairs(rng, similarity, n, words=400):
    """Pairs of texts with about this similarity: a run of one is replaced in the other."""
    rows = []
    for i in range(n):
        a = [f"w{x}" for x in rng.integers(0, 10 ** 9, words)]
        cut = int(words * (1 - similarity) / (1 + similarity))
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[:words - cut] + [f"v{x}" for x in rng.integers(0, 10 ** 9, cut)]))]
    return rows


def _texts(spark, rows, prefix):
    df = spark.createDataFrame([(str(i).encode(), i, t) for i, t in rows], "mark binary, doc_id long, text string")
    sketch = df.mapInArrow(L._sketcher(L.TREES, L.DEPTH, prefix), "mark binary, doc_id long, key binary, nodes array<long>, sig binary")
    return sketch.select(F.col("doc_id").alias("rep"), "nodes", "sig")


def test_only_texts_below_the_recall_go_up_the_tries(spark):
    rng = np.random.default_rng(3)
    near, far = _pairs(rng, 0.95, 100), [(1000 + i, t) for i, t in _pairs(rng, 0.8, 200)]
    lone = [(5000 + i, " ".join(f"u{x}" for x in rng.integers(0, 10 ** 9, 100))) for i in range(50)]
    k = L.prefix_length()
    texts = _texts(spark, near + far + lone, k).cache()
    top = L._level(texts, None, L.DEPTH - k, L.TREES)
    done = {r["rep"] for r in L.reached(top, L.DEPTH, L.TREES, L.RECALL).collect()}
    assert done >= {i for i, _ in near} and not done & {i for i, _ in lone}
    assert len(done & {i for i, _ in far}) < 60
    below = L._level(texts, L.reached(top, L.DEPTH, L.TREES, L.RECALL), L.DEPTH - 1 - k, L.TREES)
    assert not {r["a"] for r in below.collect()} & {i for i, _ in near}
    met = {tuple(sorted(r)) for r in L.likely_relations(texts).collect()}
    at = {r["rep"]: set(r["nodes"][:L.TREES]) for r in texts.collect()}  # at the shortest prefix
    pairs = {(i, i + 1) for i, _ in near[::2] + far[::2]}
    assert met >= {(a, b) for a, b in pairs if at[a] & at[b]} and len(pairs - met) <= 2


def test_texts_that_stopped_are_still_met(spark):
    """A text below the recall goes up and finds a text whose own matches were enough."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(80):
        (_, a), (_, b) = _pairs(rng, 0.8, 1)
        copy = a.split()
        copy[0] = f"x{i}"
        rows += [(10 * i, a), (10 * i + 1, " ".join(copy)), (10 * i + 2, b)]
    _compare(L.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), rows)


def test_odd_documents(odd_docs, odd_rows, no_docs):
    got = defaultdict(list)
    for r in L.join(odd_docs).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(odd_rows)
    for i in (100, 101, 102):
        assert got[i][0]["class_id"] == i and got[i][0]["n_links"] == 0 and got[i][0]["kept"]
    assert {got[i][0]["class_id"] for i in (104, 105, 106)} == {104}
    assert all(r["n_links"] == 3 for i in (104, 105, 106) for r in got[i]) and len(got[106]) == 2
    assert got[104][0]["kept"] and not any(r["kept"] for i in (105, 106) for r in got[i])
    assert got[None][0]["class_id"] is None and got[None][0]["kept"]
    out = L.distinct_documents(odd_docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == odd_docs.columns and len(ids) == len(set(ids)) and 104 in ids and 105 not in ids
    assert L.join(no_docs).count() == 0 and L.distinct_documents(no_docs).count() == 0


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(7, "some words that are repeated here")] * 5, "doc_id long, text string")
    assert L.distinct_documents(df).count() == 1


# ---------------------------------------------------------------- embeddings

def _vectors(n=900, d=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            near = np.array(rows[int(rng.integers(0, i))][1])
            v = near + rng.normal(0, rng.choice([0.0, 0.02, 0.05, 0.2]), d) * np.linalg.norm(near) / np.sqrt(d)
        else:
            v = rng.normal(size=d)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize("per_centre,block", [(1000, 1024), (30, 16)])
def test_embeddings_match_brute_force(spark, per_centre, block):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in C.near_duplicates(df, per_centre=per_centre, block=block).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    assert link.sum() > 200
    comp = _least(range(len(rows)), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(link)))])
    assert {i: r["n_links"] for i, r in got.items()} == dict(enumerate(link.sum(axis=1).tolist()))
    assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (i == comp[i]) for i, r in got.items())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0]]
    rows = [(i, v, 1) for i, v in enumerate(odd)] + [(i + 10, v, 1) for i, v in enumerate(odd)]
    rows += [(20, [1.0, 2.0], None), (21, [1.0, 2.0], None), (22, [1.0, 2.0], 1), (23, [2.0, 4.0], 1), (24, [1.0, 2.0, 0.0], 1),
             (25, [1.0, 2.0], 1), (25, [1.0, 2.0], 1), (26, [3e38, 3e38], 1), (27, [1e-38, 1e-38], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit(1))
    got = {r["vec_id"]: r for r in C.near_duplicates(df).collect()}
    for i in [*range(6), *range(10, 16), 20, 21, 24]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert [got[i]["n_links"] for i in (22, 23, 25)] == [3, 3, 3] and {got[i]["component_id"] for i in (22, 23, 25)} == {22}
    assert got[26]["n_links"] == got[27]["n_links"] == 1 and got[27]["component_id"] == 26
    assert C.near_duplicates(df.where("false")).count() == 0


def test_vectors_of_many_cells_are_stored_once(spark, monkeypatch, tmp_path):
    """Vectors without clusters are guests of most cells; that must not multiply what is written."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[1::50] = x[::50] + np.float32(0.001)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    sizes = []

    def measured(table, name, written=C.written):
        out = written(table, name)
        sizes.append(out.agg(F.sum(F.size(F.coalesce("vector", F.array())))).first()[0] if "vector" in out.columns else 0)
        return out
    monkeypatch.setattr(C, "written", measured)
    got = {r["vec_id"]: r["n_links"] for r in C.near_duplicates(df, per_centre=100).collect()}
    assert sum(sizes) <= 2 * x.size  # 30 cells: most vectors were stored for several of them
    unit = C.unit(x)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert want.sum() == 120 and got == dict(enumerate(want.tolist()))


def test_a_vector_is_sent_once_for_each_block():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    centres = C.spherical_kmeans(C.unit(x), 40)
    batch = C.pa.RecordBatch.from_pydict({
        "rep": C.pa.array(range(500)), "label": C.pa.array([0] * 500), "dim": C.pa.array([16] * 500, C.pa.int32()),
        "copies": C.pa.array([1] * 500), "vector": C.pa.array(x.tolist(), C.pa.list_(C.pa.float32())),
        "rows": C.pa.array([500] * 500)})
    out = C.pa.Table.from_batches(C._assign({16: centres}, 0.2, 125)([batch]))
    sent = list(zip(out["rep"].to_pylist(), out["to"].to_pylist()))
    assert len(sent) == len(set(sent)) <= 500 * 2.5  # four blocks: at home in one, past about half of the others
    assert sum(out["home"].to_pylist()) == 500 and all(C.goes(a, b) != C.goes(b, a) for a in range(9) for b in range(a))


def test_one_crowded_cell_is_dealt_over_tasks(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=16) + rng.normal(0, 0.14, (400, 16))).astype(np.float32)
    x[0, 3], x[1] = 0.0, x[0]
    x[1, 3] = -0.0
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    link = C.unit(x) @ C.unit(x).T >= 0.98
    np.fill_diagonal(link, False)
    link[0, 1] = link[1, 0] = True
    assert 10_000 < link.sum() < 159_600
    got = {r["vec_id"]: r["n_links"] for r in C.near_duplicates(df, block=64).collect()}
    assert got == dict(enumerate(link.sum(axis=1).tolist()))
