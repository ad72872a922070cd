"""Page-corpus operators: normalised rows, samples, coverage selection, group splits, leakage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import parse

LOGIN = r"(?i)<input\b[^>]*\btype\s*=\s*[\"']?password"
MIN_HTML, MAX_HTML, BUDGET, SHORT = 20, 1_000_000, 300_000, 2_000


def hash_order(seed: str, *key: Column) -> Column:
    """A reproducible random order that other engines can repeat."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key]), 256)


def normalize_pages(pages: DataFrame) -> DataFrame:
    """html, html_len, label_id, url, host, sha256 (before truncation), is_login, short, of rows with a known label and a fair length."""
    size = F.length("html")
    label = F.when(F.col("label") == "benign", 0).when(F.col("label") == "phish", 1)
    kept = pages.where(F.col("html").isNotNull() & size.between(MIN_HTML, MAX_HTML) & label.isNotNull())
    host = F.regexp_replace(parse(F.col("url"))["host"], r"\.+$", "")
    return kept.select(F.left("html", F.lit(BUDGET)).alias("html"), size.alias("html_len"), label.alias("label_id"), "url", host.alias("host"), F.sha2("html", 256).alias("sha256"), F.col("html").rlike(LOGIN).alias("is_login"), (size <= SHORT).alias("short"))


def host_group(host: Column, sha: Column) -> Column:
    return F.when(F.coalesce(host, F.lit("")) != "", F.concat(F.lit("host:"), host)).otherwise(F.concat(F.lit("hash:"), sha))


def sample(df: DataFrame, k: int, seed: str, key: str, *by: str) -> DataFrame:
    """A uniform sample of k rows per group, equal in every run."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(seed, F.col(key)), key))
    return df.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def coverage(df: DataFrame, limit: int, phases: list[tuple[str, float]], seed: str, key: str, *by: str) -> DataFrame:
    """limit rows per group: round(limit * share) of those with each flag in turn, then any others.

    Each phase ranks the rows that earlier ones left; a flag short of rows leaves its places to the last phase.
    """
    order = [hash_order(seed, F.col(key)), F.col(key)]
    out = df.withColumn("_in", F.lit(False))
    for flag, share in phases:
        rank = F.row_number().over(Window.partitionBy(*by, "_in", F.col(flag)).orderBy(*order))
        out = out.withColumn("_in", F.col("_in") | (F.col(flag) & (rank <= round(limit * share))))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_in"), *order))
    return out.withColumn("_n", rank).where(F.col("_n") <= limit).drop("_in", "_n")


def split_groups(df: DataFrame, quota: int, seed: str, group: str, label: str = "label_id") -> tuple[DataFrame, DataFrame]:
    """(training, validation): whole groups go to validation in random order while neither class exceeds the quota.

    The order matters, so this is a fold over (group, n0, n1) - one small row per group, and those that exceed the quota on their own are left out beforehand.
    """
    counts = df.groupBy(group).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).where(f"n0 <= {quota} and n1 <= {quota}")
    seq = counts.agg(F.array_sort(F.collect_list(F.struct(hash_order(seed, F.col(group)).alias("h"), F.col(group).alias("g"), "n0", "n1"))).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.array().cast("array<string>").alias("g"))

    def step(s: Column, x: Column) -> Column:
        fits = (s.a + x.n0 <= quota) & (s.b + x.n1 <= quota)
        return F.struct(F.when(fits, s.a + x.n0).otherwise(s.a).alias("a"), F.when(fits, s.b + x.n1).otherwise(s.b).alias("b"), F.when(fits, F.concat(s.g, F.array(x.g))).otherwise(s.g).alias("g"))

    chosen = seq.select(F.explode(F.aggregate("s", start, step, lambda s: s.g)).alias(group))
    return df.join(chosen, group, "left_anti"), df.join(chosen, group, "left_semi")


def leakage(splits: dict[str, DataFrame], group: str = "group", sha: str = "sha256", label: str = "label_id") -> DataFrame:
    """Per split: rows, repeated hashes, groups and hashes that other splits have, and classes; all is well if the middle three are 0 and classes 2."""
    all_ = reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("split"), F.col(group).alias("g"), F.col(sha).alias("s"), F.col(label).alias("l")) for n, d in splits.items()])
    shared = lambda c: all_.select("split", c).distinct().withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(c))).where("k > 1").groupBy("split").agg(F.count(F.lit(1)).alias(f"shared_{c}"))
    base = all_.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.countDistinct("s")).alias("repeated"), F.countDistinct("l").alias("classes"))
    return base.join(shared("g"), "split", "left").join(shared("s"), "split", "left").na.fill(0, ["shared_g", "shared_s"])


def without_known(test: DataFrame, known: DataFrame, group: str = "group", sha: str = "sha256") -> DataFrame:
    """test rows whose group and hash are both unknown: two anti joins."""
    return test.join(known.select(group).distinct(), group, "left_anti").join(known.select(sha).distinct(), sha, "left_anti")


def hash_split(df: DataFrame, group: str, seed: str, parts: int = 10) -> DataFrame:
    """Adds fold in 0..parts-1, equal for all rows of a group."""
    return df.withColumn("fold", (F.conv(F.substring(hash_order(seed, F.col(group)), 1, 8), 16, 10).cast("long") % parts).cast("int"))


def shard_indices(total: int, wanted: int) -> list[int]:
    """Evenly spaced file numbers."""
    n = min(total, wanted)
    return sorted({round(i * (total - 1) / max(n - 1, 1)) for i in range(n)})


def sampling_report(df: DataFrame, target: int) -> DataFrame:
    return df.groupBy("label_id").agg(F.count(F.lit(1)).alias("actual"), F.lit(target).cast("long").alias("target"), F.countDistinct("host").alias("hosts"))


def split_report(df: DataFrame, target: int, shard: str = "shard") -> DataFrame:
    """Per split and label: rows, target, hosts, the shards they come from in order, and whether the rows fall short."""
    g = df.groupBy("split", "label_id").agg(F.count(F.lit(1)).alias("actual"), F.countDistinct("host").alias("hosts"), F.sort_array(F.collect_set(shard)).alias("shards"))
    return g.withColumn("target", F.lit(target).cast("long")).withColumn("short", F.col("actual") < target)


def manifest_difference(a: DataFrame, b: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows only in a, only in b, in both."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, key, "full_outer")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))
