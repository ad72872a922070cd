"""Threat-feed and reputation joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import is_well_known, popular_key
from ..functions.urls import is_ip_host, parse


def threat_type(threat: Column, tags: Column) -> Column:
    """threat, else the tags joined by commas, else null."""
    return F.coalesce(F.nullif(threat, F.lit("")), F.nullif(F.array_join(F.filter(tags, lambda t: t != ""), ","), F.lit("")))


def first_seen(*fields: Column) -> Column:
    """The first field that is not empty, with white space collapsed."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_replace(f, r"\s+", " ")), F.lit("")) for f in fields])


def _path(path: Column) -> Column:
    cut = F.regexp_replace(path, "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


def match_exact(scans: DataFrame, feed: DataFrame) -> DataFrame:
    """scans (scan_id, url) left-joined with the first feed row (feed_seq, url, id, threat) of the same URL."""
    first = feed.groupBy("url").agg(F.min_by(F.struct("feed_seq", "id", "threat"), "feed_seq").alias("f"))
    return scans.join(first, "url", "left").select("scan_id", "url", F.col("f").isNotNull().alias("matched"), "f.feed_seq", "f.id", "f.threat")


def match_host(scans: DataFrame, feed: DataFrame) -> DataFrame:
    """scans with the first feed row of the same host whose path is the URL's or one above it.

    An IP host matches any of its rows; a listing of the root matches only the root. The join has an equi key, and each prefix of a
    path that can match is a key of its own (`keys`), so a host with many listings and many scans never multiplies.
    """
    u = parse(F.col("url"))
    path = _path(u["path"])
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keys = F.when(is_ip_host(u["host"]), F.array(F.lit("*"))).when(path == "/", F.array(F.lit("/"))).otherwise(prefixes)
    asked = scans.select("scan_id", "url", u["host"].alias("host"), F.explode(keys).alias("key"))
    listed = feed.select("feed_seq", "id", "threat", u["host"].alias("host"), F.when(is_ip_host(u["host"]), "*").otherwise(_path(u["path"])).alias("key"))
    first = listed.groupBy("host", "key").agg(F.min_by(F.struct("feed_seq", "id", "threat"), "feed_seq").alias("f"))
    best = asked.join(first, ["host", "key"], "left").groupBy("scan_id", "url").agg(F.min("f").alias("f"))
    return best.select("scan_id", "url", F.col("f").isNotNull().alias("matched"), "f.feed_seq", "f.id", "f.threat")


def match_feed(scans: DataFrame, feed: DataFrame) -> DataFrame:
    """Exact matches before host matches: scan_id, url, matched, match_kind, id, threat."""
    e = match_exact(scans, feed).select("scan_id", "url", F.when(F.col("matched"), F.struct(F.lit("url").alias("k"), "id", "threat")).alias("e"))
    h = match_host(scans, feed).select("scan_id", F.when(F.col("matched"), F.struct(F.lit("host").alias("k"), "id", "threat")).alias("h"))
    both = e.join(h, "scan_id").withColumn("m", F.coalesce("e", "h"))
    return both.select("scan_id", "url", F.col("m").isNotNull().alias("matched"), F.col("m.k").alias("match_kind"), "m.id", "m.threat")


def with_reputation(df: DataFrame, popular: DataFrame, host: str = "host") -> DataFrame:
    """Adds is_popular (exact host less www.) and is_well_known (root or exact host)."""
    listed = popular.select(F.lower(F.trim("domain")).alias("_d")).where("_d <> ''").distinct()
    return df.join(listed, popular_key(F.col(host)) == F.col("_d"), "left").withColumn("is_popular", F.col("_d").isNotNull()).withColumn("is_well_known", is_well_known(F.col(host))).drop("_d")


def latest(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The last row per key in the given order."""
    keys = [key] if isinstance(key, str) else key
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order]))
    return df.withColumn("_n", rank).where("_n = 1").drop("_n")
