"""IPv4 and IPv6 addresses as bits: expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import v4_number
from .urls import let

_MAPPED = "0" * 20 + "ffff"


def _groups(side: Column) -> Column:
    """The 16-bit groups of one side of '::', four hex digits each; a dotted IPv4 address at the end is two."""
    dotted = F.regexp_extract(side, r"(^|:)([0-9.]+\.[0-9.]+)$", 2)
    halves = let(v4_number(F.nullif(dotted, F.lit(""))), lambda n: F.concat(F.lpad(F.hex(F.floor(n / 65536).cast("long")), 4, "0"), F.lit(":"), F.lpad(F.hex(n % 65536), 4, "0")))
    plain = F.when(dotted == "", side).otherwise(F.concat(F.left(side, F.length(side) - F.length(dotted)), halves))

    def padded(parts: Column) -> Column:
        fine = F.forall(parts, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(fine, F.transform(parts, lambda g: F.lpad(F.lower(g), 4, "0")))

    return F.when(side == "", F.array().cast("array<string>")).otherwise(let(F.split(plain, ":"), padded))


def v6_hex(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address, null if it is none. One '::' stands for at least one group; a zone (%name) is left out."""
    bare = F.when(text.contains("%"), F.nullif(F.regexp_extract(text, "^([^%]*)%[^%]+$", 1), F.lit(""))).otherwise(text)
    # A dotted address stands at the very end only.
    sides = F.when(~F.regexp_replace(bare, r"[^:]*$", "").contains("."), F.split(bare, "::"))

    def joined(s: Column) -> Column:
        left, right = F.get(s, 0), F.get(s, 1)
        given = F.size(left) + F.size(right)
        filled = F.concat(left, F.array_repeat(F.lit("0000"), (8 - given).cast("int")), right)
        return F.when((F.size(s) == 1) & (F.size(left) == 8), F.array_join(left, "")).when((F.size(s) == 2) & left.isNotNull() & right.isNotNull() & (given <= 7), F.array_join(filled, ""))

    return let(F.transform(sides, _groups), joined)


def address_bits(ip: Column) -> Column:
    """struct(version, bits) of an address literal, null if it is none: 32 or 128 characters '0' and '1'.

    One pair of brackets around an IPv6 address is allowed. An IPv4 address mapped into IPv6 is the IPv4 address.
    """
    held = ip.startswith("[") & ip.endswith("]") & (F.length(ip) > 1)
    v4 = F.when(~held, F.lpad(F.lower(F.hex(v4_number(ip))), 8, "0"))
    v6 = v6_hex(F.when(held, F.substring(ip, F.lit(2), F.length(ip) - 2)).otherwise(ip))
    plain = F.coalesce(v4, let(v6, lambda x: F.when(F.startswith(x, F.lit(_MAPPED)), F.right(x, F.lit(8))).otherwise(x)))
    chunk = lambda h, i: F.lpad(F.conv(F.substring(h, 8 * i + 1, 8), 16, 2), 32, "0")

    def both(h: Column) -> Column:
        short = F.length(h) == 8
        bits = F.when(short, chunk(h, 0)).otherwise(F.concat(*[chunk(h, i) for i in range(4)]))
        return F.when(h.isNotNull(), F.struct(F.when(short, 4).otherwise(6).alias("version"), bits.alias("bits")))

    return let(plain, both)
