"""A folder for tables and files in between."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that the driver and all executors share: below spark.checkpoint.dir; in local mode, where that is unset, below a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wavelake-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/wavelake-{name}-{uuid.uuid4().hex[:12]}"
