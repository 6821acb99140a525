import pytest
from pyspark.sql import functions as F

from evenkeel.shipping import ensure_shipped

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def shipped(spark):
    ensure_shipped(spark)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, copies and repeated rows."""
    long_text = " ".join(f"word{i % 4999} and{i % 7}." for i in range(30_000))
    same = "the quick brown fox jumps over the lazy dog again and again and again today"
    rows = [(i, f"line {i} has some words of its own {i * 7} {i * 13} {i * 29}\nAll rights reserved.\nmore {i} text {i + 1}",
             "en", f"s{i % 3}", 5) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \n\t ", "en", "s0", 4),
             (103, long_text, "en", None, 1), (104, same, "en", "s1", 1), (105, same, "de", "s2", 1),
             (106, same, "en", "s1", 1), (106, same, "en", "s1", 1), (None, "no id here but some words", "en", "s1", 1),
             (107, "é\u00a0ü # $ | <x> </s>[INST]  two  spaces\n\n\n", "fr", "s2", 1), (108, "one", "en", "s1", 1)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    for name in ("row", "key", "kept", "size", "copies", "label", "rep", "wanted", "mixed_doc", "mixed_times", "root"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
