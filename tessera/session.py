"""A session with the settings that the library's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", cores: int | str = "*", shuffle_partitions: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A local session (on a cluster, the master and sizes come from spark-submit): UTC, adaptive plans, no UI."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.master(f"local[{cores}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
