import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import angle_windows
from evenkeel.llm.queries import op12_angle_windows

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract over plain integers."""
    kept = []
    for v, e, l in rows:
        if l is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        if v is not None and v % 7 == 0:
            l = (l + 1) % 10
        kept.append((v, [int(np.floor(256 * float(np.float32(x)))) for x in e], l))
    out = []
    for i, (a, qa, la) in enumerate(kept):
        if a is None or a % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(qa, q)), v, l) for j, (v, q, l) in enumerate(kept)
                         if j != i and len(q) == len(qa)), key=lambda s: (s[0], s[1] is None, s[1] or 0))
        for s, p, _ in [t for t in scored if t[2] == la][:5]:
            good = [t for t in scored if t[2] != la and -50 * s <= -100 * t[0] <= -95 * s][:3]
            out += [(a, p, k + 1, t[1], -s, -t[0]) for k, t in enumerate(good)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force_on_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    assert len(want) > 50 and rows_of(op12_angle_windows(spark, SF)) == want


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(900):
        x = centres[i % 6] + rng.normal(size=12) * 0.4
        rows.append((i, [float(v) for v in np.float32(x)], int(i % 3) if i % 3 else int(i % 4)))
    rows += [(1000, None, 1), (1050, [1.0] * 12, None), (1100, [0.0] * 12, 1), (1150, [float("nan")] * 12, 2),
             (1200, [1.0, None] * 6, 2), (1250, [float("inf")] * 12, 2), (1300, [], 2), (1350, [1.0, 2.0], 2),
             (1351, [2.0, 2.0], 2), (1352, [0.9, 1.1], 3), (1400, [0.5] * 12, 2), (1401, [0.25] * 12, 1),
             (1403, [0.25] * 12, 3), (1404, [0.25] * 12, 3), (1405, [0.5] * 12, 2)]
    return rows


def test_equals_brute_force_on_odd_rows(spark, odd):
    df = (spark.createDataFrame(odd, SCHEMA).repartition(3).withColumn("row", F.lit("x")).withColumn("slice", F.lit(1))
          .withColumn("rank", F.lit("y")))
    assert rows_of(angle_windows.hard_negatives(df)) == brute(odd)


def test_many_chunks_slices_and_tiles(spark, odd, monkeypatch):
    monkeypatch.setattr(angle_windows, "CHUNK", 5)
    monkeypatch.setattr(angle_windows, "SLICES", 7)
    assert rows_of(angle_windows.hard_negatives(spark.createDataFrame(odd, SCHEMA).repartition(3))) == brute(odd)


def test_one_label_holds_most_rows_and_scores_tie(spark):
    rows = [(i, [1.0, float(i % 3), 0.5], 1) for i in range(1, 600)] + [(i, [0.7, float(i % 2), 0.3], 2)
                                                                        for i in range(601, 700)]
    assert rows_of(angle_windows.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(50, [1.0, 1.0], 1)] * 2 + [(None, [1.0, 0.9], 1), (3, [0.8, 0.9], 2), (3, [0.8, 0.9], 2), (None, [0.9, 0.8], 2)]
    assert rows_of(angle_windows.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert angle_windows.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_hold_scores_and_filter():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 2
    q = np.floor(256 * (centres[rng.integers(0, 8, 500)] + rng.normal(size=(500, 16)) * 0.05))
    q[0] = 0
    norm, angles = angle_windows.norms_and_angles(q, centres / np.linalg.norm(centres, axis=1)[:, None])
    low, high = angle_windows.score_bounds(norm[:50], angles[:50], norm, angles)
    score = q[:50] @ q.T
    assert (low <= score).all() and (score <= high).all()
    assert (high < 0.9 * norm[:50, None] * norm[None]).mean() > 0.5  # most rows of other clusters are ruled out


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2.0 ** 28 + 1, 3.0]])
    assert angle_windows.integer_scores(a, a, 2.0 ** 57)[0, 0] == (2 ** 28 + 1) ** 2 + 9
    with pytest.raises(ValueError, match="64 bits"):
        angle_windows.integer_scores(a, a, 2.0 ** 63)
