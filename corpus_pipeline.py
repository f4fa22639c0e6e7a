"""Corpus pipeline: from raw documents to packed training sequences.

Each stage calls one operator of ``tasklens.llm`` on what the stage before it
kept, and is written as Parquet and read again. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tasklens.llm import decontaminate, language_id, packing, simhash_dedup, suffix_dedup
from tasklens.llm.common import written
from tasklens.llm.queries import id_fold, tokenizer_file
from tasklens.session import table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the byte network finds no language go."""
    model = language_id.fit(docs.filter(id_fold(4) != 2))
    return language_id.keep_languages(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_dedup.keep_one(docs, shingle=4, radius=4)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier too are cut out."""
    return suffix_dedup.deduplicate(docs, length=100)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in occurrences of the benchmark's 10-word windows are cut out."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with like words are packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_file(), window=1024)


STAGES = [
    ("language ID", languages),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_text),
    ("benchmark decontamination", benchmark_text),
    ("packing", sequences),
]

#: No SQL: networks, fingerprints and token ids are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
