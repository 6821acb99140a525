from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from evenkeel.llm import feistel_shards as S
from evenkeel.llm import pareto_mix as M
from evenkeel.llm import queries


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 65_537])
def test_permutation_and_inverse(n):
    f = S.FeistelShuffle(n, seed=3)
    rows = np.arange(n)
    p = f.position(rows)
    assert sorted(p.tolist()) == rows.tolist() and (f.row(p) == rows).all()
    shard, slot = f.place(rows, 8)
    assert (f.row_at(shard, slot, 8) == rows).all()


def test_large_domains_stay_exact():
    f = S.FeistelShuffle((1 << 59) + 12_345)
    rows = np.array([0, 1, 1 << 40, (1 << 59) + 12_344])
    assert (f.row(f.position(rows)) == rows).all()


def test_the_order_is_mixed():
    p = S.FeistelShuffle(10_000).position(np.arange(10_000))
    assert abs(np.corrcoef(np.arange(10_000), p)[0, 1]) < 0.05


def test_shards_of_odd_documents(odd_docs, odd_rows):
    got = S.shard(odd_docs, 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, crc32((t or "").encode())) for d, t, *_ in odd_rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    counts = [len(by[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    order = sorted(((d is not None, d or 0, len((t or "").encode()) + 1, crc32((t or "").encode()))
                    for d, t, *_ in odd_rows))
    shard, slot = S.FeistelShuffle(len(order)).place(np.arange(len(order)), 8)
    want = Counter((k[1] if k[0] else None, int(a), int(b)) for k, a, b in zip(order, shard, slot))
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got) == want


def test_layout_does_not_matter(odd_docs):
    cols = ["doc_id", "shard", "slot"]
    a = sorted(map(str, S.shard(odd_docs.repartition(7), 8).select(*cols).collect()))
    assert a == sorted(map(str, S.shard(odd_docs.coalesce(1), 8).select(*cols).collect()))


def test_empty_tables(no_docs):
    assert S.shard(no_docs).count() == 0 and M.mix(no_docs).count() == 0 and M.mixed_documents(no_docs).count() == 0


def _targets(sizes):
    """Targets by handing the excess out again until none is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return goal | share
        for s in over:
            goal[s] = 3 * sizes[s]
            left -= goal[s]
        open_ -= over
    return goal


def _check_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, taken = _targets(dict(sizes)), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    return want, taken


def test_mix_of_documents_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, taken = _check_mix(M.mix(docs).collect())
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5
    assert abs(sum(taken.values()) - sum(want.values())) < 0.01 * sum(want.values())


def test_mix_of_odd_documents(odd_docs, odd_rows):
    rows = M.mix(odd_docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
    _check_mix(rows)
    again = M.mix(odd_docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_words_count_like_the_contract(odd_docs, odd_rows):
    import re
    got = Counter((r["doc_id"], r["size"]) for r in M.mix(odd_docs).collect())
    assert got == Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in odd_rows)


def test_mixed_documents_repeat_rows(odd_docs):
    want = Counter()
    for r in M.mix(odd_docs).collect():
        want[r["doc_id"]] += r["copies"]
    out = M.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +want


def test_each_row_is_drawn_by_itself(spark):
    """A third of the rows has no doc_id, some share one, some are equal: the mix has the words that it counts."""
    rows = [(None if i % 3 == 0 else 7 if i % 10 == 1 else i, " ".join(f"w{i}" for _ in range(20 + i * 37 % 150)),
             f"s{i % 4 // 2}", i) for i in range(1500)]
    rows += [(None, "the very same row again", "s1", 9000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place int").repartition(4)
    got = M.mix(df).collect()
    _check_mix(got)
    out = M.mixed_documents(df).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in got)
    times = Counter(r["place"] for r in out)
    texts = defaultdict(Counter)
    for r in got:
        texts[(r["doc_id"], r["source"], r["size"])][r["copies"]] += 1
    drawn = defaultdict(Counter)
    for d, t, s, place in rows:
        drawn[(d, s, len(t.split()))][times[place]] += 1
    assert drawn == texts
    assert len({r["copies"] for r in got if r["doc_id"] is None}) > 1


def test_long_and_certain_copies_come_first():
    """Inclusion odds rise with the rate: a class with twice the rate is taken about twice as often."""
    pi = {0.2: 0, 0.4: 0}
    for doc in range(20_000):
        u = (doc * 2_654_435_761 % (1 << 32) + 0.5) / (1 << 32)
        p = 0.2 if doc % 2 else 0.4
        pi[p] += (u / (1 - u)) * ((1 - p) / p) <= 1
    assert 1.8 < pi[0.4] / pi[0.2] < 2.2


def test_query_of_shards_has_its_columns(spark):
    df = queries.op4_feistel_shards(spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes)["grown_shard"] == "int" and dict(df.dtypes)["size"] == "bigint"


def test_stored_documents_are_mixed_without_a_copy(spark, tmp_path, monkeypatch):
    rows = [(i % 50, " ".join(["w"] * (i % 9)), "abc"[i % 3], i) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, extra long").repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    names, write = [], M.written

    def noted(df, name):
        names.append(name)
        return write(df, name)

    monkeypatch.setattr(M, "written", noted)
    out = M.mixed_documents(docs, stored=True)
    assert "mix_docs" not in names and out.columns == docs.columns
    taken = {r["k"]: r["n"] for r in M.mix(docs).groupBy(F.struct("doc_id", "source", "size").alias("k")).agg(F.sum("copies").alias("n")).collect()}
    got = out.groupBy("extra").count().collect()
    assert all(1 <= r["count"] <= M.CAP for r in got)
    size = F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long").alias("size")
    back = {r["k"]: r["n"] for r in out.groupBy(F.struct("doc_id", "source", size).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert back == {k: n for k, n in taken.items() if n}
    assert P._stored(docs) and not P._stored(docs.union(docs)) and not P._stored(spark.range(3).toDF("doc_id"))
