"""A corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``docs``.

Defined cases: a null or empty text has no language and goes in the first stage; rows
with equal texts, or with near copies, leave one row; ties go as each operator's
docstring says; very long texts pass through as a whole; further columns are kept as
they are, clashing names included; an empty table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontamination, language_id, near_dedup, packing, pii
from vellum.llm.common import BATCH_ROWS, in_batches, store, table


def _bounded(spark: SparkSession) -> None:
    """Rows go to Python in small batches from now on: a stage's caller writes its result,
    so the setting must outlast the stage. ``run`` puts the caller's value back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the others go."""
    _bounded(spark)
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    _bounded(spark)
    return near_dedup.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly are such passages go."""
    _bounded(spark)
    return decontamination.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    _bounded(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document and its place in a sequence."""
    _bounded(spark)
    return packing.pack(spark, docs)


STAGES = [
    ("language ID", identify_languages),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Signatures, trained models and packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with in_batches(spark):
        for name, stage in STAGES[:-1]:
            docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return STAGES[-1][1](spark, docs, sf_dir)
