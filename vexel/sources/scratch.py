"""A folder for tables that only live while a plan runs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str = "scratch") -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; where that is unset, in a local one if there are no other machines, as in tests."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vexel-"))
        at = sc.getCheckpointDir()
    return f"{at.rstrip('/')}/vexel-{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: what is used several times is computed once, and outlives any executor."""
    at = scratch(df.sparkSession, "settled")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
