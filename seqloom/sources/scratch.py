"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a folder of this machine, for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = Path(tempfile.mkdtemp(prefix="seqloom-")).as_uri()
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whole after the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/seqloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
