"""Splits by whole groups: stratified folds, unseen and seen hosts, values worked out once a group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import hash_order, hash_split
from .ranks import with_place


def group_folds(df: DataFrame, group: str, label: str, seed: str, parts: int = 10) -> DataFrame:
    """(group, rows, fold in 0..parts-1) of every group, so that folds are alike in rows and in shares of label 1.

    Groups of like size (the same power of two) and like mix (the same tenth of positives) follow each other in random order and are dealt in turn. The
    largest groups come first and one deal runs through all of them, so folds differ by at most one group of each kind. A null group is a group.
    """
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("_ones"))
    size = F.lpad(F.lit(64) - F.length(F.bin("rows")), 2, "0")
    g = g.withColumn("_kind", F.concat(size, F.lpad(F.floor(10 * F.col("_ones") / F.col("rows")).cast("string"), 2, "0")))
    digest = hash_order(seed, F.col(group))
    placed = with_place(g, "_place", F.concat("_kind", F.substring(digest, 1, 3)), "_kind", digest, F.col(group))
    return placed.select(group, "rows", F.pmod(F.col("_place") - 1, F.lit(parts)).cast("int").alias("fold"))


def with_folds(df: DataFrame, group: str, label: str, seed: str, parts: int = 10) -> DataFrame:
    """df with the fold of its group."""
    folds = group_folds(df, group, label, seed, parts).select(F.col(group).alias("_group"), "fold")
    return df.join(folds, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def three_way(df: DataFrame, group: str, label: str, seed: str, outer: int = 10, inner: int = 9) -> DataFrame:
    """df with split: the first of the outer folds is the test, the first inner fold of the rest the validation."""
    d = with_folds(df, group, label, seed, outer)
    test, rest = d.where("fold = 0").drop("fold"), d.where("fold <> 0").drop("fold")
    inside = with_folds(rest, group, label, f"{seed}|inner", inner)
    split = F.when(F.col("fold") == 0, "validation").otherwise("train")
    return test.withColumn("split", F.lit("test")).unionByName(inside.withColumn("split", split).drop("fold"))


def known_keys(key: str, *splits: DataFrame) -> DataFrame:
    """The distinct keys of all splits."""
    return reduce(DataFrame.unionByName, [s.select(key) for s in splits]).distinct()


def unseen_and_seen(test: DataFrame, group: str, *known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of groups that no known split has, the others)."""
    keys = known_keys(group, *known)
    return test.join(keys, group, "left_anti"), test.join(keys, group, "left_semi")


def by_share(df: DataFrame, group: str, share: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """(about this share of the groups, the others): whole groups by hash, in steps of 1/1000."""
    d = hash_split(df, group, seed, 1000)
    return d.where(F.col("fold") < round(share * 1000)).drop("fold"), d.where(F.col("fold") >= round(share * 1000)).drop("fold")


def mapped(df: DataFrame, key: str, name: str, of: Callable[[Column], Column]) -> DataFrame:
    """df with of(key) as `name`, worked out once per distinct key: for functions that cost more than a join."""
    table = df.select(key).distinct().select(F.col(key).alias("_key"), of(F.col(key)).alias(name))
    return df.join(table, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def record_lookup(df: DataFrame, key: str, label: str) -> DataFrame:
    """df with key_rows and label_mask (1: label 0, 2: label 1, 3: both) of all rows of its key."""
    mask = F.bit_or(F.when(F.col(label) == 0, 1).when(F.col(label) == 1, 2).otherwise(0))
    per = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("key_rows"), mask.alias("label_mask"))
    return df.join(per, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
