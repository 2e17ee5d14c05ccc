"""Sessions with the settings that the library's plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans, one time zone, Arrow between Python and the JVM.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(name: str = "hillspan", cores: int | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; cores makes it local, settings (with _ for .) come last."""
    builder = SparkSession.builder.appName(name)
    if cores:
        builder = builder.master(f"local[{cores}]")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in settings.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
