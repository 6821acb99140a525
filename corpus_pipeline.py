"""The corpus pipeline: five stages over ``documents``, each written and read again.

quality_classifier  op 6: documents predicted below the cut go
quality_rules       op 1: documents that fail the rules go
near_duplicates     op 10: one document of each group stays
source_mix          op 5: documents as often as the mix takes them
packing             op 8: pieces placed in sequences (the result)

The last stages have no SQL form (tokenizer ids, a genetic algorithm), so
``ORACLE_SQL`` is None and tests compare stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import grouping_packer, line_rules, lsh_forest, pareto_mix, quadratic_classifier
from evenkeel.llm.common import table
from evenkeel.session import written
from evenkeel.shipping import ensure_shipped


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quadratic_classifier.accepted_documents(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsh_forest.distinct_documents(docs)


def _stored(docs: DataFrame) -> bool:
    """Whether Parquet files hold the rows, as the table of a stage before does."""
    try:
        return bool(docs.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pareto_mix.mixed_documents(docs, stored=_stored(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grouping_packer.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [(f.__name__, f) for f in (quality_classifier, quality_rules, near_duplicates, source_mix, packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    ensure_shipped(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
