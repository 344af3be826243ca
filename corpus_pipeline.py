"""Raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet into
the shared folder and reads them back for the next one, so a lost executor costs one
stage's tasks at most. A stage starts by letting executors and Python workers go of what
earlier ones left there, also where it is called by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toponet.llm import decontaminate, line_dedup, neardup, packing, quality_fm
from toponet.llm.tables import small_batches, table, take_back, tidy_workers, written


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text is now; a null text keeps what was there."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn(
        "n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    )


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that an earlier one has."""
    return _with_length(line_dedup.remove_repeats(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark go."""
    return _with_length(decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token pieces."""
    return packing.pack(docs)


def _tidied(stage: Callable) -> Callable:
    """``stage`` on small batches, after what earlier stages left behind is gone."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        take_back()
        tidy_workers(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_classifier", _tidied(quality)),
    ("line_dedup", _tidied(lines)),
    ("near_duplicates", _tidied(near_duplicates)),
    ("decontamination", _tidied(benchmark)),
    ("best_fit_packing", _tidied(packed)),
]

#: The classifier, the automaton and the tokenizer aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
