"""What the operators share: the folder all executors see, and how many pieces a shuffle is dealt into."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import FEW_ROWS, broadcast_if_few
from ..sources.folders import checkpointed, shared_folder

__all__ = ["FEW_ROWS", "SPACES", "broadcast_if_few", "checkpointed", "in_arrow", "shared_folder", "shuffle_partitions", "tidy", "unused", "word_count"]


def release_memory() -> None:
    """Gives memory that a worker holds but does not use back to the system: the worker lives on, idle, beside later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work over a task's batches, with release_memory() at the end."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release_memory()

    return run


#: Bytes of a batch between the JVM and Python, about, and the setting's own default, which is what a user has not chosen.
BATCH_BYTES, DEFAULT_BYTES = "8m", "67108864b"


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df through work, tidied, in batches of about BATCH_BYTES (a setting of the session): texts make rows large."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, DEFAULT_BYTES) == DEFAULT_BYTES:
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(tidy(work), schema)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: White space that ends a word, everywhere in this package: a word is a longest run of other characters.
SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    """Number of words of a text column; null and empty have none."""
    pieces = F.size(F.split(text, SPACES)) - F.substring(text, 1, 1).rlike(SPACES).cast("int") - F.right(text, F.lit(1)).rlike(SPACES).cast("int")
    return F.when(F.length(text) > 0, pieces).otherwise(F.lit(0)).cast("long")
