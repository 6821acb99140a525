"""Feature preparation.

Order as in the reference: drop, binarise target, keep sensitive strings,
impute, one-hot encode, split, scale. Modes, medians, means and deviations
are scalars on the driver, and their row-level steps column expressions;
category vocabularies and the cuts of the split are written tables, joined to
the rows (the planner broadcasts what is small).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any, Dict, List, Optional, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.scalar import binarize, nan_as_null
from evenkeel.operators.newton import spread
from evenkeel.operators.numbering import rank_within, sorted_table
from evenkeel.operators.quantile import exact_medians
from evenkeel.session import written
from evenkeel.spec import AuditSpec

SEED = 42


def column_modes(df: DataFrame, cols: Sequence[str]) -> Dict[str, Optional[str]]:
    """Most frequent non-null value per column (smallest on ties, in the
    column's own order: numeric for numbers), as strings. One unpivot +
    partially aggregated count for all columns."""
    cols = list(cols)
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    packed = df.select(*[F.struct(F.col(c).cast("string").alias("s"),
                                  (F.lit(None).cast("double") if isinstance(types[c], T.StringType)
                                   else F.col(c).cast("double")).alias("d")).alias(c) for c in cols])
    long = packed.unpivot([], cols, "column", "v").where(F.col("v.s").isNotNull())
    g = long.groupBy("column", F.col("v.d").alias("d"), F.col("v.s").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    m = g.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("d"), F.col("value"))).alias("mode"))
    got = {r["column"]: r["mode"] for r in m.collect()}
    return {c: got.get(c) for c in cols}


@dataclass
class Imputer:
    """M1: mode for categorical, exact median for continuous columns."""
    modes: Dict[str, Optional[str]] = field(default_factory=dict)
    medians: Dict[str, Optional[float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, categorical: Sequence[str], continuous: Sequence[str]) -> "Imputer":
        df = nan_as_null(df)
        return cls(column_modes(df, categorical), exact_medians(df, continuous))

    def transform(self, df: DataFrame) -> DataFrame:
        df = nan_as_null(df)
        types = {f.name: f.dataType for f in df.schema.fields}
        cols = []
        for c in df.columns:
            if c in self.modes and self.modes[c] is not None:
                cols.append(F.coalesce(F.col(c), F.lit(self.modes[c]).cast(types[c])).alias(c))
            elif c in self.medians and self.medians[c] is not None:
                cols.append(F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(c))
            else:
                cols.append(F.col(c))
        return df.select(*cols)

    def table(self, spark) -> DataFrame:
        rows = [(c, "most_frequent", v) for c, v in self.modes.items()] + \
               [(c, "median", None if v is None else repr(float(v))) for c, v in self.medians.items()]
        return spark.createDataFrame(rows, "column string, strategy string, fill_value string")


def _native(s: str, t):
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(s)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return float(s)
    return s


class OneHot:
    """M2: one dummy per category except the alphabetically (or numerically) first.

    The vocabulary is a written table (column, value, place from 0), numbered by partition counts;
    only the number of values per column comes to the driver. ``categories`` and ``names`` fetch the
    values themselves, for reports on models of that size.
    """

    def __init__(self, sizes: Dict[str, int], vocabulary: Optional[DataFrame] = None, types: Optional[dict] = None) -> None:
        self.sizes, self.vocabulary, self._types, self._lists = sizes, vocabulary, types or {}, None

    @classmethod
    def fit(cls, df: DataFrame, categorical: Sequence[str]) -> "OneHot":
        """Distinct values of every categorical column in one job: an unpivot and a distinct, then a
        sort by (column, value), numeric for numbers."""
        cats = list(categorical)
        if not cats:
            return cls({})
        types = {f.name: f.dataType for f in df.schema.fields}
        packed = df.select(*[F.struct(F.col(c).cast("string").alias("s"),
                                      (F.col(c).cast("double") if not isinstance(types[c], T.StringType)
                                       else F.lit(None).cast("double")).alias("d")).alias(c)
                             for c in cats])
        values = (packed.unpivot([], cats, "column", "v").where(F.col("v.s").isNotNull())
                  .select("column", F.col("v.d").alias("d"), F.col("v.s").alias("value")).distinct())
        placed = rank_within(sorted_table(values, ["column"], ["d", "value"], "values"), ["column"], "place")
        vocabulary = written(placed.select("column", "value", (F.col("place") - 1).alias("place")), "vocabulary")
        found = {r["column"]: r["n"] for r in vocabulary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        return cls({c: found.get(c, 0) for c in cats}, vocabulary, types)

    @property
    def categories(self) -> Dict[str, List[Any]]:
        """Values per column in order, fetched from the vocabulary."""
        if self._lists is None:
            self._lists = {c: [] for c in self.sizes}
            if self.vocabulary is not None:
                for r in self.vocabulary.orderBy("column", "place").collect():
                    self._lists[r["column"]].append(_native(r["value"], self._types.get(r["column"])))
        return self._lists

    @property
    def blocks(self) -> List[int]:
        """Dummies per column."""
        return [max(n - 1, 0) for n in self.sizes.values()]

    def names(self) -> List[str]:
        return [f"{c}_{v}" for c, vals in self.categories.items() for v in vals[1:]]

    def columns(self) -> List[Column]:
        """Dense 0/1 dummy columns (for small reports; models use ``encode``)."""
        out = []
        for c, vals in self.categories.items():
            for v in vals[1:]:
                out.append(F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}"))
        return out

    @property
    def encoded(self) -> List[str]:
        """Columns with dummies: a column of one value or none has no other category to tell."""
        return [c for c, n in self.sizes.items() if n > 1]

    def indexed(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and, per encoded column, ``<column>__idx``: values after the first -> 0..n-2; the
        first and nulls -> n-1, the slot OneHotEncoder drops. Carries ML nominal metadata so the
        encoder needs no scan to size itself."""
        out = df
        for c in self.encoded:
            n = self.sizes[c]
            meta = {"ml_attr": {"type": "nominal", "num_vals": n, "name": f"{c}__idx"}}
            v = self.vocabulary.where((F.col("column") == c) & (F.col("place") > 0)).select(
                F.col("value").alias(f"{c}__value"), (F.col("place") - 1).cast("double").alias(f"{c}__place"))
            out = out.join(v, out[c].cast("string") == v[f"{c}__value"], "left").withColumn(
                f"{c}__idx", F.coalesce(f"{c}__place", F.lit(float(n - 1))).alias(f"{c}__idx", metadata=meta)).drop(
                f"{c}__value", f"{c}__place")
        return out.select(*keep, *[f"{c}__idx" for c in self.encoded])

    def vector_names(self) -> List[str]:
        return [f"{c}__vec" for c in self.encoded]

    def encode(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Sparse one-hot vectors ``<col>__vec`` (slot j = category j + 1)."""
        from pyspark.ml.feature import OneHotEncoder
        cols = self.encoded
        x = self.indexed(df, keep)
        if not cols:
            return x
        enc = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=self.vector_names(),
                            dropLast=True, handleInvalid="error").fit(x)
        return enc.transform(x).drop(*[f"{c}__idx" for c in cols])


def _split_cuts(d: DataFrame, label: str, test_size: float) -> DataFrame:
    """(class, cut, need, at): per class the cut-off hash, rows needed at it, rows that have it.

    Rows are counted by class and first 16 bits of their hash, then, in the bucket that holds the
    wanted rank, by class and whole hash: two reads, both collapsed by partial aggregation. The
    tables stay in Spark, so any number of classes will do; a class's window sorts at most 2^16
    buckets, then the distinct hashes of one.
    """
    def holding(counts: DataFrame, rank: Column, by: str) -> DataFrame:
        """The row of each class that holds its wanted rank, and how far into it the rank lies."""
        upto = F.sum("n").over(Window.partitionBy("class").orderBy(by))
        return (counts.withColumn("want", rank).withColumn("upto", upto)
                .where((F.col("want") > F.col("upto") - F.col("n")) & (F.col("want") <= F.col("upto")))
                .withColumn("need", F.col("want") - F.col("upto") + F.col("n")))

    rows = d.select(F.col(label).alias("class"), "_h").withColumn("digit", F.shiftright("_h", 48))
    total = F.sum("n").over(Window.partitionBy("class"))
    first = holding(rows.groupBy("class", "digit").agg(F.count(F.lit(1)).alias("n")),
                    F.ceil(total * test_size - 1e-9), "digit")
    first = written(first.select(F.col("class").alias("_c"), F.col("digit").alias("_d"), F.col("need").alias("_need")),
                    "split_digits")
    bucket = rows.join(first, rows["class"].eqNullSafe(first["_c"]) & (F.col("digit") == F.col("_d")))
    hashes = bucket.groupBy("class", "_h", "_need").agg(F.count(F.lit(1)).alias("n"))
    cut = holding(hashes, F.col("_need"), "_h")
    return written(cut.select("class", F.col("_h").alias("cut"), "need", F.col("n").alias("at")), "split_cuts")


def stratified_split(df: DataFrame, label: str, key_cols: Sequence[str], test_size: float = 0.2,
                     seed: int = SEED) -> DataFrame:
    """M3: exact stratified split; adds boolean ``is_test``.

    Test rows of class c are the ceil(test_size * n_c) rows with the
    smallest ``xxhash64(keys, seed)`` (rows sharing a hash have equal keys and are interchangeable).
    The cut-off hashes are a written table with a row per class, joined to the rows: where the
    planner broadcasts it, no row moves.
    """
    d = df.withColumn("_h", F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed)))
    cuts = _split_cuts(d, label, test_size)
    joined = d.join(cuts, F.col(label).eqNullSafe(F.col("class")), "left")
    below = F.coalesce(F.col("_h") < F.col("cut"), F.lit(False))
    at = F.coalesce(F.col("_h") == F.col("cut"), F.lit(False))
    if not cuts.where(F.col("at") > F.col("need")).limit(1).count():
        return joined.withColumn("is_test", below | at).select(*df.columns, "is_test")
    # rare: identical keys straddle the cut; they are interchangeable, so any of them may be the test rows
    rest = joined.where(~at).withColumn("is_test", below)
    edge = rank_within(sorted_table(joined.where(at), [label], ["_h"], "edge"), [label], "_rank")
    edge = edge.withColumn("is_test", F.col("_rank") <= F.col("need"))
    return rest.select(*df.columns, "is_test").unionByName(edge.select(*df.columns, "is_test"))


@dataclass
class Scaler:
    """M4: z-score with train mean and POPULATION deviation (0 -> 1)."""
    stats: Dict[str, tuple] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> "Scaler":
        cols = list(cols)
        if not cols:
            return cls({})
        r = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"),
                                                 F.stddev_pop(c).alias(f"s_{c}"))]).first()
        st = {}
        for c in cols:
            s = r[f"s_{c}"]
            st[c] = (r[f"m_{c}"], s if s not in (None, 0.0) and not math.isnan(s) else 1.0)
        return cls(st)

    def columns(self) -> List[Column]:
        return [((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in self.stats.items()]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, float(m), float(s)) for c, (m, s) in self.stats.items()],
                                     "column string, mean double, std double")


@dataclass
class Prepared:
    """M5 result: train / test with ``features`` vector, ``y_true`` label,
    row key and the raw sensitive strings kept beside the features (P7)."""
    train: DataFrame
    test: DataFrame
    imputer: Imputer
    onehot: OneHot
    scaler: Scaler
    spec: AuditSpec

    @property
    def layout(self) -> tuple:
        """Numbers that lead the feature vector, and the sizes of the one-hot blocks behind them."""
        return len(self.scaler.stats), self.onehot.blocks

    @property
    def feature_names(self) -> List[str]:
        """Names in vector order (fetches the vocabulary)."""
        return list(self.scaler.stats) + self.onehot.names()

    def report(self, spark) -> DataFrame:
        """M6: the preparation decisions as a small table."""
        rows = [("dropped_columns", ",".join(self.spec.drop)),
                ("imputation", "categorical=most_frequent; continuous=median"),
                ("encoding", "one_hot (first category dropped)"),
                ("scaling", "z-score, population deviation, fit on train"),
                ("train_test_split", "test_size=0.2; stratified; seed=42"),
                ("total_features", str(len(self.scaler.stats) + sum(self.onehot.blocks)))]
        return spark.createDataFrame(rows, "decision string, value string")


def prepare(df: DataFrame, spec: AuditSpec, key_cols: Optional[Sequence[str]] = None,
            test_size: float = 0.2, seed: int = SEED, impute_on: str = "all") -> Prepared:
    """M5: drop -> target -> keep sensitive -> impute -> encode -> split -> scale.

    ``impute_on='all'`` fits imputation on all rows like the reference (T7);
    ``'train'`` fits it on the training split only.
    """
    spec.validate(df)
    d = nan_as_null(df.drop(*[c for c in spec.drop if c in df.columns]))
    key_cols = list(key_cols or ([spec.row_id] if spec.row_id else d.columns))
    cat = [c for c in spec.categorical if c in d.columns]
    cont = [c for c in spec.continuous if c in d.columns]
    sens = [c for c in spec.sensitive if c in d.columns]
    base = d.select(*[F.col(c) for c in dict.fromkeys(key_cols + cat + cont)],
                    *[F.col(s).cast("string").alias(f"sens_{s}") for s in sens],
                    binarize(spec.target, spec.positive).alias("y_true"))
    # one read of the source for all fits and split passes
    base = written(base, "base")
    # the reference imputes only when something is missing; fit only those columns
    nulls = base.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cat + cont], F.lit(1).alias("_one")).first()
    cat_n = [c for c in cat if nulls[c]]
    cont_n = [c for c in cont if nulls[c]]
    split = stratified_split(base, "y_true", key_cols, test_size, seed)
    if impute_on == "all":
        imputer = Imputer.fit(base, cat_n, cont_n)
    else:
        imputer = Imputer.fit(split.where(~F.col("is_test")), cat_n, cont_n)
    onehot = OneHot.fit(base, cat)
    imp = imputer.transform(split)
    scaler = Scaler.fit(imp.where(~F.col("is_test")), cont)
    keep = list(dict.fromkeys(key_cols)) + [f"sens_{s}" for s in sens] + ["y_true", "is_test"]
    scaled = imp.select(*[F.col(k) for k in keep], *scaler.columns(), *[F.col(c) for c in cat])
    enc = onehot.encode(scaled, keep + cont)
    assembler = VectorAssembler(inputCols=cont + onehot.vector_names(), outputCol="features",
                                handleInvalid="keep")
    out = assembler.transform(enc).select(*keep, "features")
    for s in sens:
        out = out.withColumnRenamed(f"sens_{s}", s)
    # Written once for the iterative fits: nothing is left persisted, and a lost executor costs only its
    # tasks. Few rows from few files are dealt over all cores by their key.
    out = written(spread(out, *key_cols).sortWithinPartitions(*key_cols), "prepared")
    return Prepared(out.where(~F.col("is_test")), out.where(F.col("is_test")), imputer, onehot, scaler, spec)
