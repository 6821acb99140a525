"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.shipping import ensure_shipped

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = b" \t\n\v\f\r"

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark; ships the package to local workers."""
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes of text (one row at least).

    Bounds the working memory of a task by the longest text, not by the batch.
    """
    sizes = np.array([0 if v is None else v for v in
                      pc.binary_length(batch.column(text)).to_pylist()], dtype=np.int64)
    at, n = 0, batch.num_rows
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        stop = int(np.searchsorted(ends, base + limit, side="right"))
        stop = min(max(stop, at + 1), n)
        yield batch.slice(at, stop - at)
        at = stop


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mark(*names: str) -> F.Column:
    """Digest of the named columns: rows with the same one are equal in all of them.

    Names a row by what its verdict depends on, alike in every read and without a copy of the table.
    """
    def part(name: str) -> F.Column:
        text = F.col(name).cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.unhex(F.md5(F.concat(*map(part, names)).cast("binary")))


def with_marks(docs: DataFrame, marks: DataFrame, *names: str) -> DataFrame:
    """The rows of ``docs`` whose mark over ``names`` is in the one column of ``marks``."""
    name, wanted = fresh(docs, "mark"), fresh(docs, "wanted")
    out = docs.withColumn(name, mark(*names)).join(marks.toDF(wanted), F.col(name) == F.col(wanted), "left_semi")
    return out.drop(name)


def n_words(text: F.Column) -> F.Column:
    """Words of a text column as a JVM expression (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
