"""Small binary contents by key, as an append-only Parquet log: a write appends, a read takes the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import is_screenshot
from .readers import append


def put(blobs: DataFrame, path: str) -> None:
    """Appends (key, at, content). Contents that are no screenshots are refused, as a read would never show them."""
    append(blobs.where(F.coalesce(is_screenshot(F.col("content")), F.lit(False))).select("key", "at", "content"), path)


def newest(log: DataFrame) -> DataFrame:
    """(key, at, content): the newest content of each key; of equal times, the one with the greatest hash."""
    return log.groupBy("key").agg(F.max_by(F.struct("at", "content"), F.struct("at", F.sha2("content", 256))).alias("b")).select("key", "b.at", "b.content")


def fetch(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """keys with their newest at and content; nulls where nothing is stored. Only rows of these keys are grouped."""
    log = spark.read.parquet(path)
    return keys.join(newest(log.join(keys.select("key").distinct(), "key", "left_semi")), "key", "left")
