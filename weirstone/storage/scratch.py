"""Folders for what a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the one that all executors share, as ``spark.checkpoint.dir`` names it; a local one only for a session whose executors are local, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    shared = shared or tempfile.mkdtemp(prefix="weirstone-")
    return f"{shared}/{purpose}-{uuid.uuid4().hex}"
