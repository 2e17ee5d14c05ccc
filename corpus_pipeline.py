"""The corpus pipeline: stages over documents, each written and read again before the next."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from hillspan.llm.language import with_language
from hillspan.llm.mixing import mixed
from hillspan.llm.queries import TOKENIZER
from hillspan.llm.shared import shared_folder
from hillspan.llm.simhash import one_of_each
from hillspan.llm.tiling import decontaminate
from hillspan.llm.tokens import definition_of, token_output
from hillspan.sources.folders import removed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without a letter, and without a language that has half of it, go."""
    return with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, the one with the smallest id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of their sources takes them."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the files of token ids."""
    return token_output(docs, definition_of(TOKENIZER))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL can express neither the model nor the fingerprints; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. Every stage's output is a Parquet folder in the shared one, which the next one reads; only the last one stays."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if read:
            removed(spark, read)
        read = f"{folder}/{name}"
    return docs
