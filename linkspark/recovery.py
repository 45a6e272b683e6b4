"""Intermediate results that survive lost executors: tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  A session on one machine may do without it; on a cluster its lack raises."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "linkspark-checkpoints")
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, into Parquet in the shared folder, and read from there by all that follows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
