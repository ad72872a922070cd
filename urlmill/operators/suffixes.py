"""Registrable domains by the rules of a public suffix list: plain rules, wildcards and exceptions, as a join on label suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import is_ip_host
from ..sources.shared import written


def parse_rules(lines: DataFrame) -> DataFrame:
    """name, kind ('plain', 'wild' or 'exception') and private of the rules among the lines (line_no, line) of a list; comments and blank lines are left out, and a rule ends at white space.

    What stands between the list's marks of private domains is private. A list is small (some 10,000 lines), so its lines are ordered in one task.
    """
    mark = F.regexp_extract("line", r"^\s*//\s*===\s*(BEGIN|END)\s+PRIVATE", 1)
    inside = F.last(F.nullif(mark, F.lit("")), ignorenulls=True).over(Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rule = F.lower(F.regexp_extract("line", r"^\s*(\S+)", 1))
    rows = lines.select(F.coalesce(inside == "BEGIN", F.lit(False)).alias("private"), rule.alias("rule")).where("rule <> '' and not startswith(rule, '//')")
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wild").otherwise("plain")
    return rows.select(F.regexp_replace("rule", r"^(!|\*\.|\.)", "").alias("name"), kind.alias("kind"), "private").distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a list file (UTF-8)."""
    whole = spark.read.text(path, wholetext=True)
    return parse_rules(whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")))


def suffixes(df: DataFrame, host: str, rules: DataFrame, private: bool = False) -> DataFrame:
    """(host, suffix, domain) of each distinct host that a rule names: its public suffix and one label more (null if the host has no more). Private rules count if asked for.

    An exception beats other rules and its suffix is one label shorter; else the longest rule wins. Hosts are lower-cased and stripped of dots at the end; IP addresses match no
    rule. A host has one key for each of its label suffixes (127 at most).
    """
    clean = F.regexp_replace(F.lower(host), r"\.+$", "")
    own = df.select(host).where(F.col(host).isNotNull()).distinct().withColumn("_labels", F.split(clean, r"\.")).where(~is_ip_host(clean) & ~clean.contains(":") & (clean != ""))
    tail = lambda k: F.array_join(F.slice("_labels", F.size("_labels") - k + 1, k), ".")
    each = own.withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_labels")))).withColumn("name", tail(F.col("_k")))
    counted = rules if private else rules.where("not private")
    size = F.when(F.col("kind") == "plain", F.col("_k")).when(F.col("kind") == "exception", F.col("_k") - 1).when(F.col("_k") < F.size("_labels"), F.col("_k") + 1)
    hits = each.join(counted.select("name", "kind"), "name").withColumn("_size", size).where("_size is not null")
    best = hits.groupBy(host).agg(F.first("_labels").alias("_labels"), F.max(F.struct(F.col("kind") == "exception", "_size"))["_size"].alias("_n"))
    return best.select(host, tail(F.col("_n")).alias("suffix"), F.when(F.size("_labels") > F.col("_n"), tail(F.col("_n") + 1)).alias("domain"))


def registrable(df: DataFrame, host: str, rules: DataFrame, name: str = "domain") -> DataFrame:
    """df with the registrable domain of its hosts by the public rules; null for IP addresses, for suffixes themselves and where no rule holds."""
    found = written(suffixes(df, host, rules).select(host, F.col("domain").alias(name)), "suffixes")
    return df.join(found, host, "left").select(*df.columns, name)


def split_group(df: DataFrame, host: str, rules: DataFrame, name: str = "group") -> DataFrame:
    """df with the group of its hosts in leakage-free splits: the registrable domain, private rules counted, else the host itself."""
    found = written(suffixes(df, host, rules, private=True).select(host, F.col("domain").alias("_domain")), "suffixes")
    own = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.+$", "")
    return df.join(found, host, "left").withColumn(name, F.coalesce("_domain", own)).select(*df.columns, name)
