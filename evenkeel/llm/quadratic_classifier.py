"""Quality classifier: regularised quadratic discriminant over text statistics.

Every whole text becomes a short vector of transformed statistics (lengths,
character classes, repetition). Per class, mean and covariance come from
moments summed by Spark over all learning rows; each covariance is shrunk
towards the pooled one and towards its own diagonal, and factored once.
A text's score is the logistic of the difference of the two class
log-densities (Mahalanobis distances through the cached Cholesky factors)
plus the log prior odds, divided by a temperature: the statistics are
correlated in the tails, so raw differences are too sure.

Defined results: null text counts as empty and gets a score like any other;
without learning rows of both classes every score is the smoothed prior;
null labels are not learned from; a doc_id with several labels counts each
distinct one; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import mark, slices, texts_of, with_marks
from evenkeel.llm.line_rules import text_stats
from evenkeel.session import written

HELD_OUT = 2
CUT = 0.7
TEMPERATURE = 3.0
TO_POOLED = 0.2
TO_DIAGONAL = 0.1
RIDGE = 1e-3

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_ENDS = b".!?"
_MARKS = b".,;:'\"()-"


def features(text: bytes) -> list[float]:
    """Transformed statistics of one UTF-8 text; all finite, for the empty text too."""
    n, chars, symbols, dup_lines, repeated = text_stats(text)
    words = text.split()
    c, w = max(chars, 1), max(n, 1)

    def share(alphabet: bytes) -> float:
        return (len(text) - len(text.translate(None, alphabet))) / c

    def log_share(x: float) -> float:
        return float(np.log(x + 2e-3))

    distinct = len(set(words))
    lines = text.count(b"\n") + 1
    sizes = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    return [
        float(np.log1p(n)), float(np.log(chars / w + 0.1)), float(np.log(sizes.std() + 0.1)),
        log_share(symbols / c), log_share(share(_UPPER)), log_share(share(_DIGIT)), log_share(share(_MARKS)),
        log_share(share(_ENDS)), log_share(text.count(b"!") / c), log_share(text.count(b"|") / c),
        float(np.log((distinct + 1) / (w + 1))), log_share(min(1.0, repeated / w)),
        log_share(dup_lines / lines), float(np.log(w / lines + 0.1)),
        log_share((len(text) - chars) / max(len(text), 1)),
    ]


DIM = len(features(b""))
#: The columns that the verdict of a row is made of (doc_id only spreads copies of one text).
JUDGED = ("doc_id", "text")
_SCHEMA = pa.schema([("mark", pa.binary()), ("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            xs = [features(t) for t in texts_of(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("mark"), part.column("doc_id"),
                                              pa.array(xs, pa.list_(pa.float64()))], schema=_SCHEMA)


def feature_table(docs: DataFrame) -> DataFrame:
    """mark, doc_id, x: one written row per row of ``docs``."""
    rows = docs.select(mark(*JUDGED).alias("mark"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_featurise, "mark binary, doc_id long, x array<double>"), "features")


@dataclass
class Quadratic:
    """A fitted discriminant: class means, whitening factors (inverse Cholesky), log determinants."""

    prior: float
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    logdet: np.ndarray | None = None
    temperature: float = TEMPERATURE

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of ``x``."""
        odds = np.log(self.prior / (1 - self.prior))
        if self.means is None:
            return np.full(len(x), self.prior)
        dens = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d
                for m, w, d in zip(self.means, self.whiten, self.logdet)]
        z = (dens[1] - dens[0]) / self.temperature + odds
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(learn: DataFrame, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Quadratic:
    """Fit from rows (quality, x). Only two moment rows reach the driver."""
    x = [F.col("x")[i] for i in range(DIM)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)]
    outer = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(DIM) for j in range(i, DIM)]
    got = {r["quality"]: r for r in learn.where(F.col("quality").isin(0, 1)).groupBy("quality")
           .agg(F.count(F.lit(1)).alias("n"), *sums, *outer).collect()}
    n = np.array([float(got[k]["n"]) if k in got else 0.0 for k in (0, 1)])
    prior = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Quadratic(prior)
    means, covs = [], []
    for k in (0, 1):
        r = got[k]
        m = np.array([r[f"s{i}"] for i in range(DIM)]) / n[k]
        second = np.empty((DIM, DIM))
        for i in range(DIM):
            for j in range(i, DIM):
                second[i, j] = second[j, i] = r[f"p{i}_{j}"] / n[k]
        means.append(m)
        covs.append(second - np.outer(m, m))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    whiten, logdet = [], []
    for c in covs:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + RIDGE * np.eye(DIM)
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return Quadratic(prior, np.array(means), np.array(whiten), np.array(logdet))


def _judge(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Verdicts of ``classify`` with the mark of the row."""
    table = feature_table(docs).withColumn("held_out", held_out(F.col("doc_id")))
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where(F.col("quality").isin(0, 1)).distinct())
    model = fit(table.where(~F.col("held_out")).join(marks, "doc_id"))
    spec = pa.schema([("mark", pa.binary()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            yield pa.RecordBatch.from_arrays(
                [b.column("mark"), b.column("doc_id"), b.column("held_out"), pa.array(model.score(x), pa.float64())],
                schema=spec)

    return (table.mapInArrow(scores, "mark binary, doc_id long, held_out boolean, score double")
            .withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0)))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); ``labels``: doc_id, quality.

    Rows whose crc32 of doc_id (as text) mod 4 is 2 are held out and never learned from.
    """
    return _judge(docs, labels, cut).drop("mark")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def accepted_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` predicted good, with their own columns.

    A prediction follows from the text (and the model), so rows that share doc_id and text share it, and
    all others have their own.
    """
    return with_marks(docs, _judge(docs, labels, **options).where("predicted = 1").select("mark"), *JUDGED)
