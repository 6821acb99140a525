"""Audit specification: column roles and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Mapping, Optional, Sequence

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FairnessThresholds:
    """Flag limits for the group audit (fixed values of the reference)."""
    dpd: float = 0.10   # |demographic parity difference| above this is biased
    eod: float = 0.10   # |equal opportunity difference| above this is biased
    dir: float = 0.80   # disparate impact ratio below this is biased


@dataclass(frozen=True)
class DetectionThresholds:
    """Flag limits for the detection scans (fixed values of the reference)."""
    correlation: float = 0.15
    proxy: float = 0.20
    disparate_impact: float = 0.80
    p_value: float = 0.05
    min_group_rows: int = 5        # disparate impact scan ignores smaller groups
    min_numeric_rows: int = 10     # point-biserial needs at least this many pairs
    max_categories: int = 10       # numeric columns with <= this many values are categorical


@dataclass(frozen=True)
class AuditSpec:
    """Roles of a table's columns.

    ``privileged`` maps a sensitive attribute to its privileged value; an
    attribute without an entry falls back to the group with the highest
    positive prediction rate.
    """
    target: str
    positive: Any = None
    sensitive: Sequence[str] = ()
    privileged: Mapping[str, str] = field(default_factory=dict)
    categorical: Sequence[str] = ()
    continuous: Sequence[str] = ()
    drop: Sequence[str] = ()
    row_id: Optional[str] = None

    def feature_columns(self, df: DataFrame) -> list[str]:
        """All columns but the target (and dropped ones)."""
        return [c for c in df.columns if c != self.target and c not in self.drop]

    def validate(self, df: DataFrame) -> "AuditSpec":
        """Fail before planning when a named column is absent."""
        cols = set(df.columns)
        if self.target not in cols:
            raise ValueError(f"target column '{self.target}' not in table")
        for c in list(self.sensitive) + list(self.categorical) + list(self.continuous):
            if c not in cols:
                raise ValueError(f"column '{c}' not in table")
        for a in self.privileged:
            if a not in self.sensitive:
                raise ValueError(f"privileged value given for non-sensitive '{a}'")
        return self
