"""Sharding by a Feistel permutation over global row numbers.

Rows get global numbers in the order (doc_id, size, text crc); a keyed
Feistel network over a domain just above the row count, walked along its
cycles until it lands inside the count, permutes them. Position ``p`` goes
to shard ``p mod shards`` at slot ``p div shards``: shard sizes differ by
one at most, slots have no gaps, and place and row number follow from each
other without a lookup (``place``, ``row_at``). The same rows give the
same shuffle whatever their files or partitions.

Defined results: null text has size 1 and crc 0; null doc_ids come first;
equal rows are interchangeable and each gets a place; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from hashlib import sha256
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import written

_PRIME = (1 << 31) - 1
_ROUNDS = 6
_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row within it below


class FeistelShuffle:
    """A keyed permutation of ``0 .. n-1`` (n up to 2^60)."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.a = max(1, isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        self.keys = []
        for r in range(_ROUNDS):
            d = sha256(f"feistel:{seed}:{r}".encode()).digest()
            self.keys.append((int.from_bytes(d[:4], "big") % _PRIME, 1 + int.from_bytes(d[4:8], "big") % (_PRIME - 1)))

    @staticmethod
    def _mix(v: np.ndarray, add: int, times: int) -> np.ndarray:
        v = (v + add) % _PRIME
        return v * v % _PRIME * times % _PRIME

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for r, key in enumerate(self.keys):
            if r % 2:
                right = (right + self._mix(left, *key)) % self.b
            else:
                left = (left + self._mix(right, *key)) % self.a
        return left * self.b + right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for r, key in reversed(list(enumerate(self.keys))):
            if r % 2:
                right = (right - self._mix(left, *key)) % self.b
            else:
                left = (left - self._mix(right, *key)) % self.a
        return left * self.b + right

    def _walk(self, x, step) -> np.ndarray:
        x = np.asarray(x, dtype=np.int64)
        out = step(x)
        outside = np.flatnonzero(out >= self.n)
        while len(outside):
            out[outside] = step(out[outside])
            outside = outside[out[outside] >= self.n]
        return out

    def position(self, row) -> np.ndarray:
        return self._walk(row, self._once)

    def row(self, position) -> np.ndarray:
        return self._walk(position, self._back)

    def place(self, row, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(shard, slot) of global row numbers."""
        p = self.position(row)
        return p % shards, p // shards

    def row_at(self, shard, slot, shards: int) -> np.ndarray:
        """Global row numbers of places: the inverse of ``place``."""
        return self.row(np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64))


def global_rows(keyed: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Append ``row``: 0-based number in the order of ``order``, ties in any order; and the row count.

    Range partitions are sorted and written with their local numbers; the
    first row number of each partition comes from one row per partition.
    The tie column splits a run of equal rows over partitions.
    """
    tied = keyed.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in order] + [F.col("_tie")]
    local = (tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
             .withColumn("_at", F.monotonically_increasing_id()))
    local = written(local, "rows").withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition of the written table: a single small window.
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    within = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    numbered = (local.join(F.broadcast(first), "_part")
                .withColumn("row", F.col("_first") + within).drop("_part", "_at", "_first"))
    return numbered, local.count()


def shard(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = global_rows(keyed, ["doc_id", "size", "text_crc32"])
    shuffle = FeistelShuffle(n, seed)

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(shuffle.position(row.to_numpy()))

    p = F.col("position")
    return (rows.withColumn("position", position("row"))
            .withColumn("shard", (p % shards).cast("int"))
            .withColumn("slot", F.expr(f"position div {int(shards)}"))
            .drop("position"))
