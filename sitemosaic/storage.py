"""The folder that driver and executors share, and reliable checkpoints in it."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session may do without: it gets a temporary folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc._conf.set("spark.checkpoint.dir", root)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str = "sitemosaic") -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(*frames: DataFrame) -> DataFrame:
    """The rows from Parquet files below the shared folder: later plans are one scan of the columns they need, and nothing is held in memory.

    Several frames of the same columns are written one after the other: the driver never has the plan of all of them at once.
    """
    spark = frames[0].sparkSession
    path = new_folder(spark)
    for df in frames:
        df.write.mode("append").parquet(path)
    return spark.read.schema(frames[0].schema).parquet(path)
