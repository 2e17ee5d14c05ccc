"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .html import extract
from .language import identify
from .merkle import SQL as MERKLE_SQL
from .merkle import manifest
from .mixing import SQL as MIXING_SQL
from .mixing import mix
from .nearest import SQL as NEAREST_SQL
from .nearest import nearest
from .ngram import SQL as NGRAM_SQL
from .ngram import jaccard_components
from .pii import find_pii
from .simhash import simhash_components
from .substring import SQL as SUBSTRING_SQL
from .substring import substring_dedup
from .suffix import SQL as SUFFIX_SQL
from .suffix import suffix_dedup
from .tiling import contaminated
from .tokens import definition_of, token_output
from .trie import SQL as TRIE_SQL
from .trie import prefix_trie

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("removed")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("removed")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), definition_of(TOKENIZER))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_simhash_near_dedup, op3_suffix_dedup, op4_benchmark_decontamination, op5_nearest_neighbours, op6_main_text, op7_language_id, op8_mix_sources, op9_personal_data, op10_token_output, op11_prefix_trie, op12_jaccard_join, op13_merkle_manifest)}

ORACLES: dict[str, str] = {"op1_substring_dedup": SUBSTRING_SQL, "op3_suffix_dedup": SUFFIX_SQL, "op5_nearest_neighbours": NEAREST_SQL, "op8_mix_sources": MIXING_SQL, "op11_prefix_trie": TRIE_SQL, "op12_jaccard_join": NGRAM_SQL, "op13_merkle_manifest": MERKLE_SQL}
