"""Example data, made by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normal(spark: SparkSession, n: int = 10_000, dims: int = 1, mean: float = 0.0, sigma: float = 1.0, seed: int = 42) -> DataFrame:
    """n points of independent normal coordinates x, y, z."""
    if not 1 <= dims <= 3:
        raise ValueError("one to three coordinates are made")
    return spark.range(n).select(*((F.randn(seed + i) * sigma + mean).alias(c) for i, c in enumerate("xyz"[:dims])))


def uniform(spark: SparkSession, n: int = 10_000, low: float = 0.0, high: float = 1.0, seed: int = 42) -> DataFrame:
    return spark.range(n).select((F.rand(seed) * (high - low) + low).alias("x"))
