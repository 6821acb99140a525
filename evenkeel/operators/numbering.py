"""Numbers of sorted rows within groups, with no group in one task."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.session import written


def sorted_table(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by groups and order, with a long ``row`` that ascends with
    them (partition in the high bits); a written table."""
    keys = [*groups, *order]
    return written(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn("row", F.monotonically_increasing_id()), name)


def rank_within(table: DataFrame, groups: Sequence[str], rank: str = "rank") -> DataFrame:
    """Adds the place, from 1, of each row of a ``sorted_table`` within its group (nulls are a group).

    A group's rows are consecutive in each partition, so their places follow from ``row`` and one
    count per partition and group; no row is moved or sorted again.
    """
    groups = list(groups)
    held = table.withColumn("_part", F.shiftright("row", 33))
    counts = held.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_n")
    offsets = written(counts.select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_part").alias("_of"), "_first",
                                    before.alias("_before")), "group_counts")
    on = F.col("_part") == F.col("_of")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return (held.join(offsets, on).withColumn(rank, F.col("row") - F.col("_first") + F.col("_before") + 1)
            .drop("_part", "_of", "_first", "_before", *[f"_g_{g}" for g in groups]))
