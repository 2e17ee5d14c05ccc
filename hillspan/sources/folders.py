"""The folder that all executors see, for checkpoints and for tables between jobs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Folder for checkpoints where the session names none; local mode alone may use it.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode without that setting, LOCAL_CHECKPOINTS."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return LOCAL_CHECKPOINTS


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df, computed once, as Parquet in the shared folder, and its path, which the caller removes. Its size is that of its files; a checkpoint keeps its plan's estimate, whose digits double in each round that joins a table with itself."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
