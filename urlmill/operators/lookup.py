"""Lookups, batch scoring, ledgers and bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import features
from ..functions.rules import probability_band
from ..functions.urls import train_normalize
from .ranks import key_bucket, with_hash_place, with_place


def scan_by_id(log: DataFrame, ref: str, schema: str) -> DataFrame:
    """The stored result of one scan, read from its JSON; no row if it is missing or invalid."""
    parsed = log.where(F.col("scan_ref") == ref).select("scan_ref", F.from_json("raw_response_json", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col("r._bad").isNull()).select("scan_ref", "r.*").drop("_bad")


def with_explanation(results: DataFrame, explanations: DataFrame) -> DataFrame:
    """results (scan_id, evidence_scan_id) with the explanation saved for their evidence, else for themselves."""
    e = explanations.select(F.col("scan_id").alias("_e"), "explanation")
    return results.join(e, F.coalesce("evidence_scan_id", "scan_id") == F.col("_e"), "left").drop("_e")


def score_batch(rows: DataFrame, model: Callable[[dict[str, Column]], Column], review: float, block: float, url: str = "url") -> DataFrame:
    """Every row with status, probability, prediction and reason; invalid URLs stay, with nulls. model maps feature columns to a probability."""
    n = train_normalize(rows, url)
    f = features(n.withColumn("_url", F.col(url)), "_url")
    scored = f.select("_url", model({c: F.col(c) for c in f.columns}).alias("probability")).dropDuplicates(["_url"])
    joined = n.join(scored, F.col(url).eqNullSafe(F.col("_url")), "left")
    p = F.col("probability")
    return joined.select(*rows.columns, F.col("normalized.value").alias("normalized_url"), F.when(F.col("normalized.ok"), "scored").otherwise("invalid").alias("status"), "probability", F.when(p.isNotNull(), probability_band(p, review, block)).alias("prediction"), F.col("normalized.reason").alias("validation_error"))


def split_failures(df: DataFrame, result: str, *identity: str) -> tuple[DataFrame, DataFrame]:
    """(rows that parsed, ledger of identity and reason) of a struct(value, error) column."""
    ok = F.col(f"{result}.error").isNull()
    return df.where(ok), df.where(~ok).select(*identity, F.col(f"{result}.error").alias("reason"))


def decisions(scored: DataFrame, failures: DataFrame, threshold: float) -> DataFrame:
    """sha256, label_id, score, prediction, outcome of scored rows, and of failures, which count as predicted benign."""
    both = scored.select("sha256", "label_id", "score").unionByName(failures.select("sha256", "label_id", F.lit(None).cast("double").alias("score")))
    p = F.coalesce((F.col("score") >= threshold).cast("int"), F.lit(0))
    y = F.col("label_id")
    return both.withColumn("prediction", p).withColumn("outcome", F.when((p == 1) & (y == 1), "TP").when(p == 1, "FP").when(y == 1, "FN").otherwise("TN"))


def incomplete(records: DataFrame, manifest: DataFrame, key: str = "sha256") -> DataFrame:
    """Keys that are not exactly once in both: empty if the audit passes."""
    a, b = records.groupBy(key).agg(F.count(F.lit(1)).alias("records")), manifest.groupBy(key).agg(F.count(F.lit(1)).alias("listed"))
    j = a.join(b, key, "full_outer").na.fill(0, ["records", "listed"])
    return j.where("records <> 1 or listed <> 1")


def best_checkpoint(runs: DataFrame) -> DataFrame:
    """The run with the highest recall, then the lowest rate of false positives, then the lowest loss."""
    best = F.max_by(F.struct(*runs.columns), F.struct("recall_at_fpr", -F.col("operating_fpr"), -F.col("loss")))
    return runs.agg(best.alias("b")).select("b.*")


def shuffled_labels(df: DataFrame, seed: str, key: str, label: str) -> DataFrame:
    """A control: labels dealt to rows in another order. Rows meet by their ranks."""
    a = with_place(df, "_n", key_bucket(df, key), F.col(key))
    b = with_hash_place(df.select(key, label), "_n", seed, key).select("_n", F.col(label).alias("shuffled"))
    return a.join(b, "_n").drop("_n")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"))


def split_summary(df: DataFrame, split: str = "split", label: str = "label_id", group: str = "group") -> DataFrame:
    """rows, share of rows, share of positives, groups per split."""
    g = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.avg(label).alias("positives"), F.countDistinct(group).alias("groups"))
    return g.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """groups, rows in repeated groups, largest group."""
    g = df.groupBy(group).count()
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("rows_in_repeated"), F.max("count").alias("largest"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> int:
    return a.select(key).intersect(b.select(key)).count()


def column_groups(df: DataFrame, groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """Which columns of df belong to each named group, and the rest."""
    known = {c for cs in groups.values() for c in cs}
    return {**{g: [c for c in df.columns if c in cs] for g, cs in groups.items()}, "other": [c for c in df.columns if c not in known]}
