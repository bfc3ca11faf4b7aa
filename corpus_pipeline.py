"""The corpus pipeline: stages over the whole documents table, each written and read again.

Defined results: null and empty texts and texts without a letter go in the first stage, unless no
label is learned, when only a letter is asked for; equal or similar rows are told apart by stored
row numbers, so null and repeated ids take no other rows with them; ties go to the smallest id,
null last, then the first row; texts of any length are read whole; other columns, whatever their
names, are kept until the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandjoin.llm import decontaminate, exact_dedup, jaccard, langid, packing
from strandjoin.llm.common import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter."""
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the one with the smallest id stays."""
    return jaccard.keep_one_of_each(docs, shingle=5, threshold=(80, 100))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a notable part of a benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmark),
    ("best_fit_packing", best_fit),
]

#: The language model and the packing search have no SQL; tests/llm/test_pipeline.py holds run() to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
