import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from evenkeel.llm import line_rules, lsh_forest, quadratic_classifier, queries
from evenkeel.plans.compare import compare
from evenkeel.session import written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, name):
    ok, rows, detail = compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], "/root/testdata/sf0.01")
    assert ok and rows, detail


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_feed_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append(docs.count())
        if name == "near_duplicates":
            assert docs.count() == docs.select("doc_id").distinct().count()
            assert lsh_forest.join(docs).where("n_links > 0").count() == 0
    assert seen[0] > seen[1] >= seen[2] > seen[3] and seen[4]
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert P.run(spark, SF).count() == last.count()


def test_stages_take_odd_and_empty_documents(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in P.STAGES:
            out = written(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert out.columns == docs.columns
            if docs is no_docs:
                assert out.count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_each_row_follows_its_own_verdict(spark, doc_id):
    """Rows without a doc_id, or with the same one, are as many documents as they have different texts."""
    good = [" ".join(f"{name}{'abcdefgh'[i % 8]}{'stuvwxyz'[i // 8]}" for i in range(30)) + "." for name in "mnop"]
    rows = [(doc_id, t, "s") for t in good] + [(doc_id, good[0], "s"), (doc_id, "too short", "s"), (doc_id, None, "s"),
                                               (doc_id, None, "s"), (1 if doc_id else 0, good[1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [r["text"] for r in line_rules.kept_documents(docs).collect()]
    assert sorted(kept) == sorted([*good, good[0], good[1]])
    out = lsh_forest.distinct_documents(docs).collect()
    assert sorted(r["text"] for r in out if r["text"]) == sorted([*good, "too short"])
    assert sum(r["text"] is None for r in out) == 2 and {r["doc_id"] for r in out if r["text"] == good[1]} == {1 if doc_id else 0}
    bad = "| $$$ !!! ||| ### 12 99\n" * 9
    learn = [(1000 + i, t + f" {i}", "s") for i, t in enumerate(good * 5)] + [(2000 + i, bad + f"{i}", "s") for i in range(20)]
    docs = docs.unionByName(spark.createDataFrame([*learn, (doc_id, bad, "s")], docs.schema))
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, *_ in learn], "doc_id long, quality int")
    same = F.col("doc_id").eqNullSafe(doc_id)
    assert {r["predicted"] for r in quadratic_classifier.classify(docs, labels).where(same).collect()} == {0, 1}
    got = [r["text"] for r in quadratic_classifier.accepted_documents(docs, labels).where(same).collect()]
    assert bad not in got and {*good} <= {*got} and got.count(good[0]) == 2


def test_the_reading_folder_is_the_argument(spark):
    df = queries.op5_pareto_mix(spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").agg(F.count("*")).first()[0]
