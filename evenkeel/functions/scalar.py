"""Column expressions (P1-P19). All JVM-side, all codegen'd."""

from __future__ import annotations

from itertools import chain
from typing import Any, Mapping, Optional, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Union[Column, str]

__all__ = ["col_of", "clean_label", "recode", "two_way_bucket", "binarize",
           "null_category", "effect_label", "safe_div", "privileged_marker",
           "privileged_lookup", "compound_cell", "direction_label", "strategy_short_name",
           "clip01", "is_missing", "nan_as_null"]


def col_of(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_label(c: ColumnOrName) -> Column:
    """Trim and remove every '.' (second census split ends labels with '.')."""
    return F.translate(F.trim(col_of(c)), ".", "")


def recode(c: ColumnOrName, mapping: Mapping[Any, Any]) -> Column:
    """Map lookup; unmapped values become null. A null key gives null its own value."""
    known = {k: v for k, v in mapping.items() if k is not None}
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    out = m[col_of(c)] if known else F.lit(None)
    return F.when(col_of(c).isNull(), F.lit(mapping[None])).otherwise(out) if None in mapping else out


def two_way_bucket(c: ColumnOrName, cut: float, at_or_above: str, below: str) -> Column:
    """Value >= cut -> first label, else (null included) second label."""
    return F.when(col_of(c) >= cut, F.lit(at_or_above)).otherwise(F.lit(below))


def binarize(c: ColumnOrName, positive: Any) -> Column:
    """P5: 1 when the value equals the positive label, else 0 (null -> 0)."""
    return F.coalesce((col_of(c) == F.lit(positive)).cast("int"), F.lit(0))


def null_category(c: ColumnOrName, label: str = "MISSING") -> Column:
    """Null as its own category (values as strings)."""
    return F.coalesce(col_of(c).cast("string"), F.lit(label))


def is_missing(df: DataFrame, c: str) -> Column:
    """Null, or NaN in a floating-point column."""
    t = df.schema[c].dataType
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def nan_as_null(df: DataFrame) -> DataFrame:
    """``df`` with NaN replaced by null in floating-point columns."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name)
                       for f in df.schema.fields])


def effect_label(v: ColumnOrName) -> Column:
    """Effect size words; fixed cut points 0.10 / 0.20 / 0.40."""
    v = col_of(v)
    return (F.when(v < 0.10, "Negligible").when(v < 0.20, "Small")
            .when(v < 0.40, "Medium").otherwise("Large"))


def safe_div(num: ColumnOrName, den: ColumnOrName, default: float = 0.0) -> Column:
    """Ratio, or ``default`` when the denominator is 0 (A2)."""
    num, den = col_of(num), col_of(den)
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(default))


def privileged_lookup(attr_col: ColumnOrName, privileged: Optional[Mapping[str, str]]) -> Column:
    """Privileged value of the attribute named in ``attr_col`` (null if none)."""
    if not privileged:
        return F.lit(None).cast("string")
    return recode(attr_col, {k: str(v) for k, v in privileged.items()})


def privileged_marker(group: ColumnOrName, priv: Column) -> Column:
    """group == privileged, null when no privileged value is given."""
    return F.when(priv.isNotNull(), col_of(group) == priv)


def compound_cell(y: ColumnOrName, is_priv: ColumnOrName) -> Column:
    """y*2 + is_privileged, codes 0..3."""
    return col_of(y).cast("int") * 2 + col_of(is_priv).cast("int")


def direction_label(diff: ColumnOrName) -> Column:
    """Sign of an attribution difference in words (fixed values of the report)."""
    return F.when(col_of(diff) > 0, "Favors Privileged").otherwise("Favors Unprivileged")


# Short names of the mitigation strategies for report tables.
STRATEGY_SHORT_NAMES = {
    "baseline": "Baseline",
    "resampling": "Resampling",
    "reweighing": "Reweighing",
    "fair_classifier": "Fair Classifier",
    "thresholds": "Thresholds",
}


def strategy_short_name(c: ColumnOrName) -> Column:
    """Label mapping; unknown names pass through."""
    return F.coalesce(recode(c, STRATEGY_SHORT_NAMES), col_of(c))


def clip01(c: ColumnOrName) -> Column:
    return F.least(F.greatest(col_of(c).cast("double"), F.lit(0.0)), F.lit(1.0))
