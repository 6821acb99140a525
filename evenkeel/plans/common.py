"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def report_round(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column at the report edge (oracle hygiene)."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def sql_melt(source: str, ids: list[str], attributes: list[str]) -> str:
    """UNION ALL unpivot of attribute columns (oracle side only)."""
    parts = [
        f"SELECT {', '.join(ids)}, '{a}' AS attribute, CAST({a} AS VARCHAR) AS grp FROM {source}"
        for a in attributes]
    return "\n  UNION ALL ".join(parts)
