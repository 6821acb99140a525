from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from evenkeel.llm import pseudo_likelihood as P
from evenkeel.llm import quadratic_classifier as Q

SF = "/root/testdata/sf0.01"


def _auc(good, bad):
    return (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    m = got.merge(labels.toPandas().drop_duplicates("doc_id"), on="doc_id")
    m = m[m.held_out]
    assert _auc(m[m.quality == 1].score.to_numpy(), m[m.quality == 0].score.to_numpy()) > 0.95
    assert (m[m.quality == 1].predicted == 1).mean() > 0.97


def test_held_out_labels_are_never_learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    swapped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 "
                                          "THEN 1 - quality ELSE quality END AS quality")
    a = {r["doc_id"]: r["score"] for r in Q.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in Q.classify(docs, swapped).collect()}
    assert all(abs(a[d] - b[d]) < 1e-9 for d in a)


def test_scores_are_bayes_rule_of_two_normals():
    rng = np.random.default_rng(0)
    mean, cov = rng.normal(size=3), np.cov(rng.normal(size=(3, 50)))
    w = np.linalg.inv(np.linalg.cholesky(cov))
    other = mean + 1
    model = Q.Quadratic(0.7, np.array([other, mean]), np.array([w, w]), np.full(2, np.linalg.slogdet(cov)[1]), 1.0)
    x = rng.normal(size=(20, 3))
    inv = np.linalg.inv(cov)
    d = [np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, inv, x - m)) for m in (other, mean)]
    assert np.allclose(model.score(x), 0.7 * d[1] / (0.7 * d[1] + 0.3 * d[0]))


def test_fit_and_scores_equal_numpy_on_the_same_rows(spark):
    """Moments, shrinkage, factors and scores of the whole query against plain numpy over all rows."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: np.array(Q.features((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect()}
    marks = {(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] in (0, 1)}
    learn = [(q, rows[d]) for d, q in marks if d in rows and crc32(str(d).encode()) % 4 != 2]
    x = [np.array([v for q, v in learn if q == k]) for k in (0, 1)]
    n = np.array([len(v) for v in x])
    covs = [np.cov(v.T, bias=True) for v in x]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    prior = (n[1] + 1) / (n.sum() + 2)
    every = np.array(list(rows.values()))
    dens = []
    for v, c in zip(x, covs):
        c = (1 - Q.TO_POOLED) * c + Q.TO_POOLED * pooled
        c = (1 - Q.TO_DIAGONAL) * c + Q.TO_DIAGONAL * np.diag(np.diag(c)) + Q.RIDGE * np.eye(Q.DIM)
        gap = every - v.mean(axis=0)
        dens.append(-0.5 * (gap * np.linalg.solve(c, gap.T).T).sum(axis=1) - 0.5 * np.linalg.slogdet(c)[1])
    z = (dens[1] - dens[0]) / Q.TEMPERATURE + np.log(prior / (1 - prior))
    wanted = dict(zip(rows, 1 / (1 + np.exp(-np.clip(z, -500, 500)))))
    got = Q.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(abs(r["score"] - wanted[r["doc_id"]]) < 1e-6 for r in got)


def test_odd_documents_and_missing_labels(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(31, None, 0), (None, 1, 0), (1, 1, 0), (1, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    got = Q.classify(odd_docs, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    none = Q.classify(odd_docs, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert Q.classify(no_docs, labels).count() == 0
    assert Q.accepted_documents(odd_docs, labels).columns == odd_docs.columns


@pytest.mark.parametrize("text", [b"", b" \n", b"a", b"x" * 100_000, "é ü ".encode() * 1000])
def test_features_are_finite(text):
    assert len(Q.features(text)) == Q.DIM and np.isfinite(Q.features(text)).all()


# ---------------------------------------------------------------- pseudo-likelihood

def _corpus(rows):
    """Counts of words and of neighbours (None: outside) over all rows."""
    words, pairs = Counter(), Counter()
    for text in rows:
        w = (text or "").encode().split()
        if w:
            words.update([*w, None])
            pairs.update(zip([None, *w], [*w, None]))
    return words, pairs


def _by_hand(net, classes, cls, words, pairs, text):
    w = text.encode().split()
    total = 0.0
    for k, x in enumerate(w):
        near = [w[i] if 0 <= i < len(w) else None for i in range(k - P.SIDE, k + P.SIDE + 1)]
        left, right = near[P.SIDE - 1], near[P.SIDE + 1]
        near.pop(P.SIDE)
        around = np.array([[P.CLASSES if v is None else cls[v] for v in near]])
        beside = np.array([[words[left] - 1, words[right] - 1]], float)
        _, _, p, weights = net.forward(around, beside)
        assert abs(p.sum() - 1) < 1e-5 and abs(weights.sum() - 1) < 1e-5
        own = p[0][cls[x]] * (words[x] - 1 + P.SMOOTH) / (classes.weight[cls[x]] - 1 + P.SMOOTH * classes.size[cls[x]])
        total += np.log(weights[0, 0] * own
                        + weights[0, 1] * (pairs[left, x] - 1) / max(words[left] - 1, 1)
                        + weights[0, 2] * (pairs[x, right] - 1) / max(words[right] - 1, 1))
    return total


@pytest.mark.parametrize("shard_words", [P.SHARD_WORDS, 3000])
def test_scores_match_brute_force(spark, odd_docs, odd_rows, shard_words, monkeypatch):
    monkeypatch.setattr(P, "SHARD_WORDS", shard_words)
    rows = odd_docs.collect()
    got = {(r["doc_id"], r["n_words"]): r for r in P.score(odd_docs).collect()}
    assert sum(1 for _ in rows) == P.score(odd_docs).count()
    assert got[100, 0]["log_prob"] == got[101, 0]["log_prob"] == got[102, 0]["log_prob"] == 0
    assert got[101, 0]["mean_log_prob"] is None
    words, pairs = _corpus([r["text"] for r in rows])
    encoded = P.encode(odd_docs)
    totals, bits = P.corpus_counts(encoded)
    assert (bits > 0) == (shard_words == 3000)
    classes = P.classes_of(totals)
    keys = P.word_hashes(pa.array([w for w in words if w], pa.large_binary())) >> np.uint64(64 - P.WORD_BITS - bits)
    assert len(set(keys.tolist())) == len(words) - 1
    cls = dict(zip([w for w in words if w], classes.of(keys, np.array([n for w, n in words.items() if w]))))
    size = Counter(cls.values())
    assert all(classes.size[c] == size[c] for c in range(P.CLASSES))
    assert all(classes.weight[c] == sum(words[w] for w in cls if cls[w] == c) for c in size)
    top = sorted((-n, k) for k, n in zip(keys.tolist(), (n for w, n in words.items() if w)))[:P.OWN]
    assert sorted(k for _, k in top) == classes.top.tolist()
    ready = P.with_counts(encoded, totals, bits, classes)
    net = P.Network(P.train(ready, classes))
    for doc, text in [(0, odd_rows[0][1]), (107, odd_rows[-2][1]), (108, "one"), (104, odd_rows[44][1])]:
        hand = _by_hand(net, classes, cls, words, pairs, text)
        assert abs(hand - got[doc, len(text.encode().split())]["log_prob"]) < 1e-3 * abs(hand)


def test_each_expert_is_a_distribution():
    """Over all words that could stand in the middle the probabilities add up to one (neighbours: at most)."""
    text = [("a b c a b d " * 5 + "e f").split(), "b a c d g".split()]
    words, pairs = _corpus([" ".join(t) for t in text])
    left, x = b"a", b"b"
    rest, follow = words.copy(), pairs.copy()
    rest[x] -= 1
    follow[left, x] -= 1
    assert sum(follow[left, v] for v in words) == words[left] - 1
    bins = {}
    for w, n in words.items():
        if w:
            size, weight = bins.get(int(P.count_bin(n)), (0, 0))
            bins[int(P.count_bin(n))] = (size + 1, weight + n)
    classes = P.Classes([], bins)
    cls = {w: int(classes.of(np.array([1], np.uint64), np.array([n]))[0]) for w, n in words.items() if w}
    c = cls[x]
    shares = [(rest[w] + P.SMOOTH) / (classes.weight[c] - 1 + P.SMOOTH * classes.size[c]) for w in cls if cls[w] == c]
    assert abs(sum(shares) - 1) < 1e-12
    assert abs(classes.share(np.array([c]), np.array([words[x]]))[0]
               - (rest[x] + P.SMOOTH) / (classes.weight[c] - 1 + P.SMOOTH * classes.size[c])) < 1e-12


def test_words_are_split_and_hashed_like_bytes():
    texts = [None, "", " \t", " a  b\u00a0c\x1cd\x0be ", "\u00e9 x" * 500, "y" * 70_000, "one"]
    sizes, flat = P.split_words(pa.array(texts))
    wanted = [(t or "").encode().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in wanted]
    assert flat.cast(pa.large_binary()).to_pylist() == [w for d in wanted for w in d]
    made = pa.array([f"{a}{b}" for a in "abcdefgh" for b in range(5000)])
    assert len(set(P.word_hashes(made).tolist())) == len(made)
    assert P.word_hashes(made.slice(7, 3)).tolist() == P.word_hashes(made).tolist()[7:10]


def _examples(rng, n):
    return (rng.integers(0, P.CLASSES + 1, (n, 2 * P.SIDE)), rng.integers(0, P.CLASSES, n),
            rng.integers(0, 3, (n, 2)).astype(float), rng.random((n, 3)) + 0.01)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    some = _examples(rng, 40)
    net = P.Network(dtype=np.float64)
    exact = np.concatenate([g.ravel() for g in net.gradients(*some)])
    at, step = net.flat(), 1e-5
    for i in rng.choice(len(at), 150, replace=False).tolist() + list(range(len(at) - 57, len(at))):
        ends = []
        for sign in (1, -1):
            moved = at.copy()
            moved[i] += sign * step
            ends.append(-P.Network(moved, np.float64).log_prob(*some).mean())
        assert abs((ends[0] - ends[1]) / (2 * step) - exact[i]) < 1e-6


def test_training_raises_the_likelihood():
    some = _examples(np.random.default_rng(1), 40)
    net = P.Network()
    before = net.log_prob(*some).mean()
    memory = [np.zeros_like(p) for p in net.parts]
    for _ in range(60):
        net.train(*some, memory)
    assert net.log_prob(*some).mean() > before + 1


def test_documents_that_occur_twice_are_scored_apart(spark):
    rng = np.random.default_rng(3)
    common = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(common, 120)) for _ in range(400)]
    twice = [f"t{k} " + t for k, t in enumerate(texts[:40])]
    rows = [(i, t) for i, t in enumerate([f"s{k} " + t for k, t in enumerate(texts[40:])] + twice + twice)]
    got = P.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).toPandas()
    single, double = (got[got.doc_id < 360].mean_log_prob.to_numpy(), got[got.doc_id >= 360].mean_log_prob.to_numpy())
    assert _auc(double, single) > 0.95


def test_state_grows_with_the_vocabulary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words, pairs = _corpus([r["text"] for r in docs.select("text").collect()])
    totals, _ = P.corpus_counts(P.encode(docs))
    kept = totals.where("block = -1").toPandas()
    assert kept["keys"].map(len).sum() == 8 * len(words)
    n = np.concatenate([np.frombuffer(t, "<u8") for t in kept["totals"]])
    assert sorted(n.tolist()) == sorted(words.values())


def test_learned_order_scores_higher(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'")
    words, _ = _corpus([r["text"] for r in docs.select("text").collect()])
    n = np.array([v for w, v in words.items() if w], float)
    unigram = (n * np.log(n / n.sum())).sum()
    assert P.score(docs).agg({"log_prob": "sum"}).first()[0] > unigram


def test_empty_corpus(no_docs):
    assert P.score(no_docs).count() == 0
