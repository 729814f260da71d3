"""The library's Spark session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "weirstone", *, master: str | None = None, memory: str = "4g", shuffle_partitions: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution.

    On a cluster leave ``shuffle_partitions`` out: adaptive execution merges small partitions, and
    the number is then an upper bound to be set by input size (about 128 MB of shuffle each).
    """
    builder = SparkSession.builder.appName(app).master(master or os.environ.get("SPARK_MASTER", "local[*]"))
    held = {
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        held["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for name, value in (held | (conf or {})).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
