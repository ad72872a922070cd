"""Places in a whole table without one task that sorts it all: places within order-preserving buckets, plus what earlier buckets hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .corpus import hash_order


def score_bucket(score: Column) -> Column:
    """A whole number that does not fall as the score grows: about 90,000 for scores in 0..1. Null comes before all numbers, NaN after them."""
    x = score.cast("double")
    scaled = F.floor(F.signum(x) * F.log1p(F.least(F.abs(x), F.lit(1e300)) * 10_000.0) * 10_000.0)
    return F.when(x.isNull(), F.lit(-(1 << 40))).when(F.isnan(x), F.lit(1 << 40)).otherwise(scaled).cast("long")


SAMPLE, BORDERS = 4_096, 128


def key_bucket(df: DataFrame, key: str) -> Column:
    """An order-preserving bucket of a key: runs of 65,536 whole numbers; for other keys the number of borders up to it, BORDERS values spread over a sample of SAMPLE rows by hash."""
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return F.floor(F.col(key).cast("double") / 65_536.0)
    picked = df.select(F.col(key).alias("k")).where("k is not null").orderBy(F.xxhash64("k"), "k").limit(SAMPLE).distinct().orderBy("k")
    some = [r.k for r in picked.collect()]
    step = max(1, len(some) // BORDERS)
    borders = F.array(*[F.lit(k) for k in some[step::step]]).cast(T.ArrayType(df.schema[key].dataType))
    return F.when(F.col(key).isNotNull(), F.size(F.filter(borders, lambda b: b <= F.col(key))))


def with_place(df: DataFrame, name: str, bucket: Column, *order: Column | str) -> DataFrame:
    """df with its place (from 1) in the given order; bucket never falls along the order, and has few values against the rows."""
    b = df.withColumn("_bucket", bucket)
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return b.withColumn(name, inside).join(offsets, F.col("_bucket").eqNullSafe(F.col("_of"))).withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_of", "_before")


def with_hash_place(df: DataFrame, name: str, seed: str, key: str) -> DataFrame:
    """df with its place in the random order of a seed, in buckets of the hash's first four digits."""
    digest = hash_order(seed, F.col(key))
    return with_place(df, name, F.substring(digest, 1, 4), digest, F.col(key))
