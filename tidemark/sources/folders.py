"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; only a local session without one (tests) gets its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
