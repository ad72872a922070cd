"""Which addresses are no public hosts: a join of addresses with a table of networks, by prefix length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import address_bits
from ..functions.urls import let
from ..sources.shared import written

# Networks by kind, in the order of the reasons given; addresses in `public` are not private; `extra` ones are named in their reason.
NETWORKS = {
    "unspecified": "0.0.0.0/32 ::/128",
    "loopback": "127.0.0.0/8 ::1/128",
    "link-local": "169.254.0.0/16 fe80::/10",
    "multicast": "224.0.0.0/4 ff00::/8",
    "private": "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 "
    "::1/128 ::/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10",
    "public": "192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28",
    "reserved": "240.0.0.0/4 ::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 4000::/3 6000::/3 8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fe00::/9",
    "extra": "100.64.0.0/10 192.0.0.0/24 192.0.2.0/24 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4 ::/128 2001:db8::/32",
}


def networks(spark: SparkSession, by_kind: dict[str, str] = NETWORKS) -> DataFrame:
    """place, kind, network: the table to join with; any table of these columns may take its place."""
    rows = [(i, kind, n) for i, (kind, n) in enumerate((k, n) for k, names in by_kind.items() for n in names.split())]
    return spark.createDataFrame(rows, "place long, kind string, network string")


def matches(addresses: DataFrame, ip: str, table: DataFrame) -> DataFrame:
    """(ip, place, kind, network) of every network that holds an address of the column `ip`.

    An address has one key for each prefix length that occurs in the table (162 at most), so the range join is an equi join; neither side's size matters.
    """
    net = F.split("network", "/")
    key = lambda a, n: F.struct(a["version"].alias("_v"), n.alias("_n"), F.concat_ws("/", a["version"], n, F.left(a["bits"], n)).alias("_key"))
    held = table.select("place", "kind", "network", let(address_bits(F.get(net, 0)), lambda a: F.when(a.isNotNull(), key(a, F.get(net, 1).cast("int")))).alias("k")).select("place", "kind", "network", "k.*")
    held = written(held.where("_key is not null"), "networks")
    lengths = sorted(tuple(r) for r in held.select("_v", "_n").distinct().collect())
    known = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(n).alias("n")) for v, n in lengths])

    def keys(a) -> Column:  # noqa: ANN001
        return F.transform(F.filter(known, lambda x: x.v == a["version"]), lambda x: F.concat_ws("/", x.v, x.n, F.left(a["bits"], x.n)))

    own = addresses.select(ip).where(F.col(ip).isNotNull()).distinct()
    return own.select(ip, F.explode(let(address_bits(F.col(ip)), keys)).alias("_key")).join(held.drop("_v", "_n"), "_key").drop("_key")


def classify(df: DataFrame, ip: str, table: DataFrame | None = None, name: str = "reason") -> DataFrame:
    """df with `name`: why the address in column `ip` is no public host, '' if it is one."""
    found = matches(df, ip, networks(df.sparkSession) if table is None else table)
    per = written(found.groupBy(ip).agg(F.collect_set("kind").alias("_kinds"), F.min(F.when(F.col("kind") == "extra", F.struct("place", "network")))["network"].alias("_extra")), "networks")
    is_ = lambda k: F.array_contains("_kinds", k)
    # Reasons that callers see.
    reason = F.when(address_bits(F.col(ip)).isNull(), "unparseable IP address")
    for kind in ("unspecified", "loopback", "link-local", "multicast", "private", "reserved"):
        reason = reason.when(is_(kind) & ~is_("public") if kind == "private" else is_(kind), f"{kind} address")
    reason = F.when(F.col(ip).isNull(), "unparseable IP address").otherwise(reason.when(F.col("_extra").isNotNull(), F.concat(F.lit("non-routable range "), "_extra")).otherwise(""))
    return df.join(per, ip, "left").withColumn(name, reason).select(*df.columns, name)


