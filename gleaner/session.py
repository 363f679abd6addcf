"""Lineage cuts for plans of several stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a new one in local mode if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written to Parquet in the shared folder and read again: lineage is cut, and the last stage runs once, not twice as for checkpoint()."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = 20_000) -> DataFrame:
    """``df``, to be broadcast if it has ``most`` rows at most; else Spark chooses. Counted by an action, so for what is cheap to compute."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
