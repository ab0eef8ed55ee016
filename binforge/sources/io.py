"""Tables in; histograms out and in again as Parquet or JSON lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(hist: DataFrame, path: str, format: str = "parquet") -> None:
    hist.coalesce(1).write.format(format).mode("overwrite").save(path)  # a histogram is small


def load(spark: SparkSession, path: str, schema, format: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(format).load(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a session of one process without it gets one of its own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
