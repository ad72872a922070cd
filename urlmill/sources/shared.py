"""The folder that driver and executors share, and streams that are replayed from it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a private folder if all runs in one process (tests), else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_urlmill"
    if "dir" not in _OWN:
        keep = tempfile.TemporaryDirectory(prefix="urlmill-")
        atexit.register(keep.cleanup)
        _OWN["dir"] = f"file://{keep.name}"
    return _OWN["dir"]


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: computed once, and not lost with an executor."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replay(rows: DataFrame, order: str, fold: Callable[[DataFrame], DataFrame], parts: int = 2, tag: str = "replay") -> DataFrame:
    """What a streaming fold appends while rows arrive in `parts` portions along the column `order` (a number).

    Each portion is written to the source folder and run as an available-now query to its end; the next query goes on from the checkpoint of the one before, as after a restart. The
    session says which state store is used (RocksDB where keys are many). Portions are equal widths of `order`; rows with a null there come with the first.
    """
    spark = rows.sparkSession
    top = fresh(spark, tag)
    source, out, kept = f"{top}/source", f"{top}/out", f"{top}/checkpoint"
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = ((high or 0) - (low or 0)) / parts
    for i in range(parts):
        portion = F.lit(True)
        if i:
            portion &= F.col(order) >= low + i * step if low is not None else F.lit(False)
        if i < parts - 1:
            portion &= F.col(order).isNull() | (F.col(order) < (low or 0) + (i + 1) * step)
        rows.where(portion).write.mode("append").parquet(source)
        stream = fold(spark.readStream.schema(rows.schema).parquet(source))
        kind = stream.schema
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.schema(kind).parquet(out)
    found._checkpoint = kept  # for those who inspect the state that is left
    return found
