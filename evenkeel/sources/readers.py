"""Readers and writers.

The census and credit files are read with an explicit schema (no
inference pass over the data); cleaning is plain column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.scalar import clean_label, recode, two_way_bucket

# Census income column names in file order.
CENSUS_COLUMNS = [
    ("age", T.IntegerType()), ("workclass", T.StringType()), ("fnlwgt", T.IntegerType()),
    ("education", T.StringType()), ("education_num", T.IntegerType()),
    ("marital_status", T.StringType()), ("occupation", T.StringType()),
    ("relationship", T.StringType()), ("race", T.StringType()), ("sex", T.StringType()),
    ("capital_gain", T.IntegerType()), ("capital_loss", T.IntegerType()),
    ("hours_per_week", T.IntegerType()), ("native_country", T.StringType()),
    ("income", T.StringType()),
]

# Credit risk column names in file order.
CREDIT_COLUMNS = [
    ("checking_account", T.StringType()), ("duration", T.IntegerType()),
    ("credit_history", T.StringType()), ("purpose", T.StringType()),
    ("credit_amount", T.IntegerType()), ("savings_account", T.StringType()),
    ("employment", T.StringType()), ("installment_rate", T.IntegerType()),
    ("personal_status_sex", T.StringType()), ("other_debtors", T.StringType()),
    ("residence_since", T.IntegerType()), ("property", T.StringType()),
    ("age", T.IntegerType()), ("other_installments", T.StringType()),
    ("housing", T.StringType()), ("existing_credits", T.IntegerType()),
    ("job", T.StringType()), ("num_dependents", T.IntegerType()),
    ("telephone", T.StringType()), ("foreign_worker", T.StringType()),
    ("credit_risk", T.IntegerType()),
]

# Status code -> sex, and credit label recoding.
CREDIT_SEX_CODES = {"A91": "male", "A92": "female", "A93": "male", "A94": "male",
                    "A95": "female"}
CREDIT_LABELS = {1: 1, 2: 0}


#: Raw text of lines that don't have the expected fields.
CORRUPT = "_corrupt_record"


def _schema(cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


def _read_text_fields(spark: SparkSession, path: str, columns, **options) -> DataFrame:
    """Every line of a CSV file: numbers read as text and cast, broken lines also raw in ``CORRUPT``."""
    raw = [(n, T.StringType()) for n, _ in columns] + [(CORRUPT, T.StringType())]
    df = (spark.read.schema(_schema(raw)).options(
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT, **options).csv(path))
    cols = [F.col(n) if isinstance(t, T.StringType) else F.expr(f"try_cast({n} AS DOUBLE)").cast(t).alias(n)
            for n, t in columns]
    return df.select(*cols, CORRUPT)


def read_census_csv(spark: SparkSession, path: str, skip_first_line: bool = False) -> DataFrame:
    """Comma separated, blank after comma, '?' is null, labels cleaned.

    The second split of the census data starts with one junk line; it is
    dropped by reading that file with ``header=True`` (explicit schema, so
    the header line is discarded, never parsed). Every other line is kept:
    numbers are read as text and cast, so ``40.0`` is 40 and what is no
    number is null; a line with too few or too many fields keeps its raw
    text in ``_corrupt_record``.
    """
    df = _read_text_fields(spark, path, CENSUS_COLUMNS, sep=",", nullValue="?", header=skip_first_line)
    return df.withColumn("income", clean_label("income"))


def read_credit_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: space separated credit file; derives sex and age_group.

    Numbers and broken lines are treated as in ``read_census_csv``.
    """
    df = _read_text_fields(spark, path, CREDIT_COLUMNS, sep=" ")
    return (df.withColumn("sex", recode("personal_status_sex", CREDIT_SEX_CODES))
              .withColumn("age_group", two_way_bucket("age", 25, "adult", "young"))
              .withColumn("credit_risk", recode("credit_risk", CREDIT_LABELS))
              .drop("personal_status_sex"))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet is the at-rest format (pushdown + pruning at the scan)."""
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by=None) -> None:
    """S4 sink: parquet, overwrite."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink for datasets and audit reports (one file per task)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, n: int = 8) -> DataFrame:
    """First rows for a look at the table (a limit is the feature here)."""
    return df.limit(n)
