"""M2 and M3 beyond driver-sized state, row numbers within groups, and detection's reads of its source."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from evenkeel.operators import detect, prepare
from evenkeel.operators.numbering import rank_within, sorted_table


def test_a_wide_column_is_encoded_without_its_values_on_the_driver(spark):
    n = 200_000
    df = spark.range(n + 3).select(F.when(F.col("id") < n, F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 6, "0")))
                                   .alias("k"), (F.col("id") % 3).cast("int").alias("m"), "id")
    oh = prepare.OneHot.fit(df, ["k", "m"])
    assert oh.sizes == {"k": n, "m": 3} and oh.blocks == [n - 1, 2] and oh._lists is None
    got = oh.encode(df, ["id"])
    slot = F.array_position(vector_to_array("m__vec"), 1.0)
    rows = {r["id"]: (r["size"], r["hot"], r["m"]) for r in got.where("id IN (0, 1, 77777, 199999, 200001)").select(
        "id", F.expr("m__vec").alias("v"), "k__vec", slot.alias("m")).rdd.map(
        lambda r: {"id": r["id"], "size": r["k__vec"].size, "hot": r["k__vec"].indices.tolist(), "m": r["m"]}).collect()}
    assert rows[0] == (n - 1, [], 0) and rows[1] == (n - 1, [0], 1)
    assert rows[77777] == (n - 1, [77776], 77777 % 3) and rows[199999][1] == [199998] and rows[200001][1] == []
    assert oh._lists is None  # nothing fetched the vocabulary


def test_order_of_numbers_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(10, None, 1.5), (9, None, None), (None, None, -2.0), (100, None, 1.5)],
                               "a int, b string, c double")
    oh = prepare.OneHot.fit(df, ["a", "b", "c"])
    assert oh.categories == {"a": [9, 10, 100], "b": [], "c": [-2.0, 1.5]}
    assert oh.names() == ["a_10", "a_100", "c_1.5"]
    got = [tuple(vector_to_array_row) for vector_to_array_row in
           oh.encode(df, ["a"]).select("a", vector_to_array("a__vec").alias("x"), vector_to_array("c__vec").alias("y")).collect()]
    assert sorted(got, key=str) == sorted([(10, [1.0, 0.0], [1.0]), (9, [0.0, 0.0], [0.0]), (None, [0.0, 0.0], [0.0]),
                                           (100, [0.0, 1.0], [1.0])], key=str)
    assert prepare.OneHot.fit(df.where("false"), ["a"]).names() == []


def test_ten_thousand_classes_split_exactly(spark):
    df = spark.range(60_000).select("id", (F.col("id") * F.col("id") % 10_007).alias("c"))
    out = prepare.stratified_split(df, "c", ["id"])
    bad = out.groupBy("c").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).where(
        F.col("t") != F.ceil(F.col("n") * 0.2 - 1e-9)).count()
    assert out.count() == 60_000 and bad == 0


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_split_takes_the_least_hashes_of_every_class(spark, share):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("c"))
    rows = prepare.stratified_split(df, "c", ["id"], share).withColumn("h", F.xxhash64("id", F.lit(42))).collect()
    for c in (None, 1, 2):
        mine = sorted((r["h"], r["is_test"]) for r in rows if r["c"] == c)
        k = math.ceil(len(mine) * share - 1e-9)
        assert [t for _, t in mine] == [True] * k + [False] * (len(mine) - k)


def test_places_within_groups(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), (-F.col("id")).alias("v"))
    got = rank_within(sorted_table(df.repartition(7), ["g"], ["v"], "places"), ["g"]).collect()
    for g in (None, 1, 2, 3, 4):
        mine = sorted((r["v"], r["rank"]) for r in got if r["g"] == g)
        assert [r for _, r in mine] == list(range(1, 601))


def test_detection_reads_its_source_three_times(spark):
    n, seen = 500, spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    plain = spark.range(n).select((F.col("id") % 2).cast("int").alias("y"), F.concat(F.lit("a"), F.col("id") % 4).alias("a"),
                                  F.concat(F.lit("s"), F.col("id") % 6 % 2).alias("s"), (F.col("id") * 1.5).alias("x"),
                                  (F.col("id") % 7).alias("few"))
    source = plain.mapInArrow(count, plain.schema)
    flagged = detect.full_detection(source, "y", 1, ["s"])["flagged_features"].collect()
    assert flagged and seen.value <= 3 * n


def test_combinations_stand_for_rows(spark):
    df = spark.range(4000).select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 5).cast("string").alias("a"),
                                  F.when(F.col("id") % 7 > 0, (F.col("id") % 4).cast("string")).alias("b"),
                                  F.when(F.col("id") % 2 == 0, "p").otherwise("u").alias("s"))
    c = detect.combinations(df, ["a", "b", "s"], F.col("y"))
    y, w = F.col("_y"), "_n"

    def rows(x):
        return sorted(map(str, x.collect()))

    assert rows(detect.contingency(df, ["a", "b"], F.col("y"))) == rows(detect.contingency(c, ["a", "b"], y, weight=w))
    assert rows(detect.proxy_scan(df, ["a", "b"], ["s"])) == rows(detect.proxy_scan(c, ["a", "b"], ["s"], weight=w))
    assert rows(detect.disparate_impact_scan(df, ["a", "b"], F.col("y"))) == rows(
        detect.disparate_impact_scan(c, ["a", "b"], y, weight=w))
    plan = detect.proxy_scan(df, ["a", "b"], ["s"])._jdf.queryExecution().executedPlan().toString()
    assert plan  # the scan counts combinations in a written table before it multiplies them
