"""Queries over addresses, hosts and scores that rows of events and pages spell out: each row fixes a value and a way to write it, and the SQL states the
answer from the value where it can, not from the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import domains, guards, rules
from .common import listed, table
from .hosts import _RANGES, _bound


def _events(spark, sf):  # noqa: ANN001, ANN202
    """event_id, and a number of 32 bits from its digest."""
    number = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long")
    return table(spark, sf, "events").where("event_id is not null").select("event_id", number.alias("n"))


_E = "e AS (SELECT event_id, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT AS n FROM events WHERE event_id IS NOT NULL)"
_OCTETS = "[n >> 24, n >> 16 & 255, n >> 8 & 255, n & 255]"


def _octet(n: Column, i: int) -> Column:
    return F.shiftright(n, 24 - 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _dotted(n: Column) -> Column:
    return F.concat_ws(".", *[_octet(n, i).cast("string") for i in range(4)])


def legacy_ipv4(spark, sf):
    """A number of each event as inet_aton may be given it: in eight forms that say it, and in six that say none."""
    n = F.col("n")
    text = lambda c: c.cast("string")
    octets = [_octet(n, i) for i in range(4)]
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    octal = lambda c: F.concat(F.lit("0"), F.conv(text(c), 10, 8))
    low = lambda bits: n.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    dots = lambda *parts: F.concat_ws(".", *parts)
    forms = [
        _dotted(n), text(n), hexed(n), F.concat(F.lit("0X"), F.hex(n)), dots(text(octets[0]), text(low(24))), dots(text(octets[0]), text(octets[1]), text(low(16))), dots(*[octal(x) for x in octets]), dots(hexed(octets[0]), octal(octets[1]), text(octets[2]), hexed(octets[3])),
        dots(_dotted(n), F.lit("1")), text(n + (1 << 32)), dots(text(octets[0]), text(low(24) + (1 << 24))), dots(F.lit("256"), text(low(24))), F.concat(F.lit("09."), _dotted(n)), F.concat(F.lit("h"), F.lower(F.hex(n))),
    ]
    host = F.get(F.array(*forms), F.pmod("event_id", F.lit(len(forms))).cast("int"))
    return _events(spark, sf).select("event_id", host.alias("host")).withColumn("number", F.coalesce(guards.legacy_ipv4(F.col("host")), F.lit(-1)))


SQL_LEGACY_IPV4 = f"""WITH {_E}, o AS (SELECT *, event_id % 14 AS k, {_OCTETS} AS o, array_to_string({_OCTETS}, '.') AS d FROM e)
SELECT event_id, CASE k WHEN 0 THEN d WHEN 1 THEN n::VARCHAR WHEN 2 THEN format('0x{{:x}}', n) WHEN 3 THEN format('0X{{:X}}', n) WHEN 4 THEN o[1] || '.' || (n & 16777215) WHEN 5 THEN o[1] || '.' || o[2] || '.' || (n & 65535)
  WHEN 6 THEN format('0{{:o}}.0{{:o}}.0{{:o}}.0{{:o}}', o[1], o[2], o[3], o[4]) WHEN 7 THEN format('0x{{:x}}.0{{:o}}.{{}}.0x{{:x}}', o[1], o[2], o[3], o[4]) WHEN 8 THEN d || '.1' WHEN 9 THEN (n + 4294967296)::VARCHAR
  WHEN 10 THEN o[1] || '.' || ((n & 16777215) + 16777216) WHEN 11 THEN '256.' || (n & 16777215) WHEN 12 THEN '09.' || d ELSE format('h{{:x}}', n) END AS host, CASE WHEN k < 8 THEN n ELSE -1 END AS number FROM o"""

#: Where ranges begin or end, in hex.
_EDGES = sorted({x for _, v4, _ in _RANGES for x in v4.split()})


def ip_classify_v4(spark, sf):
    """A dotted address of each event: its number, a number beside an edge of a range, or a text that is no address."""
    i, n = F.col("event_id"), F.col("n")
    third = lambda by: F.pmod(F.floor(i / 3), F.lit(by)).cast("int")
    edge = F.conv(F.get(F.array(*[F.lit(x) for x in _EDGES]), third(len(_EDGES))), 16, 10).cast("long")
    beside = F.pmod(edge + F.pmod(F.floor(i / (3 * len(_EDGES))), F.lit(3)) - 1, F.lit(1 << 32))
    wrong = F.get(F.array(F.concat(F.lit("0"), _dotted(n)), F.concat(_dotted(n), F.lit(".7")), F.regexp_replace(_dotted(n), "[.][0-9]+$", ""), F.regexp_replace(_dotted(n), "^[0-9]+", "256"), F.lit("")), third(5))
    ip = F.when(i % 3 == 0, _dotted(n)).when(i % 3 == 1, _dotted(beside)).otherwise(wrong)
    return _events(spark, sf).select("event_id", ip.alias("ip")).withColumn("reason", guards.classify_ip_v4(F.col("ip")))


def _v4_case() -> str:
    out = []
    for reason, v4, _ in _RANGES:
        b = v4.split()
        out += [f"WHEN x BETWEEN {_bound(low)} AND {_bound(high)} THEN '{reason}'" for low, high in zip(b[::2], b[1::2])]
    return " ".join(out)


SQL_IP_CLASSIFY = f"""WITH {_E}, k AS (SELECT event_id, CASE WHEN event_id % 3 = 1 THEN (('0x' || [{listed(_EDGES)}][event_id // 3 % {len(_EDGES)} + 1])::BIGINT + event_id // {3 * len(_EDGES)} % 3 - 1 + 4294967296) % 4294967296 ELSE n END AS n FROM e),
o AS (SELECT *, array_to_string({_OCTETS}, '.') AS d, printf('%08x', n) AS x FROM k)
SELECT event_id, CASE WHEN event_id % 3 < 2 THEN d ELSE CASE event_id // 3 % 5 WHEN 0 THEN '0' || d WHEN 1 THEN d || '.7' WHEN 2 THEN array_to_string(string_split(d, '.')[1:3], '.') WHEN 3 THEN '256.' || array_to_string(string_split(d, '.')[2:], '.') ELSE '' END END AS ip,
  CASE WHEN event_id % 3 = 2 THEN 'unparseable IP address' {_v4_case()} END AS reason FROM o"""


def risk_bands(spark, sf):
    """Band and plain-HTTP penalty of a score of each event, in thousandths from -0.1 to 1.1, or none."""
    k = F.pmod(F.col("event_id") * 37, F.lit(1202))
    score = F.when(k < 1201, (k - 100) / F.lit(1000.0))
    return table(spark, sf, "events").select("event_id", score.alias("score")).select("event_id", "score", rules.risk_level(F.col("score")).alias("risk_level"), rules.with_http_penalty(F.col("score"), F.lit("http")).alias("http_score"))


SQL_RISK_BANDS = """WITH k AS (SELECT event_id, nullif(event_id * 37 % 1202, 1201) - 100 AS k FROM events)
SELECT event_id, k / 1000.0::DOUBLE AS score, CASE WHEN k < 0 OR k > 1000 THEN NULL WHEN k >= 800 THEN 'High Risk' WHEN k >= 600 THEN 'MALICIOUS' WHEN k >= 400 THEN 'POTENTIALLY UNSAFE' WHEN k IS NOT NULL THEN 'SAFE' END AS risk_level,
  CASE WHEN k IS NOT NULL THEN least(1000, k + 100) / 1000.0::DOUBLE END AS http_score FROM k"""

#: Endings of hosts: their public suffix, and the private one if they have one.
_ENDINGS = [("co.uk", "co.uk", ""), ("com.br", "com.br", ""), ("com", "com", ""), ("org", "org", ""), ("github.io", "io", "github.io"), ("s3.amazonaws.com", "com", "s3.amazonaws.com"), ("pages.dev", "dev", "pages.dev")]


def public_domains(spark, sf):
    """Hosts of pages, one label each, below endings of all kinds, and endings and addresses alone: the registrable domain and the group."""
    i, m = F.col("page_id"), len(_ENDINGS)
    name = F.replace(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1)), F.lit("."), F.lit("-"))
    end = F.get(F.array(*[F.lit(x) for x, _, _ in _ENDINGS]), F.pmod(i, F.lit(m)).cast("int"))
    depth = F.pmod(F.floor(i / m), F.lit(5))
    host = F.when(depth == 0, end).when(depth == 1, F.concat_ws(".", name, end)).when(depth == 2, F.concat_ws(".", F.lit("a.b"), name, end)).when(depth == 3, F.concat(F.upper(F.concat_ws(".", F.lit("www"), name, end)), F.lit(".")))
    host = host.otherwise(F.concat(F.lit("198.51.100."), F.pmod(i, F.lit(256)).cast("string")))
    d = table(spark, sf, "pages").select("page_id", host.alias("host"))
    return d.select("page_id", "host", domains.public_domain(F.col("host")).alias("icann"), domains.group_domain(F.col("host")).alias("grouped"))


SQL_DOMAINS = f"""WITH t(k, ending, public, private) AS (VALUES {", ".join(f"({i}, '{e}', '{p}', '{q}')" for i, (e, p, q) in enumerate(_ENDINGS))}),
p AS (SELECT page_id, replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '.', '-') AS name, page_id // {len(_ENDINGS)} % 5 AS depth, ending, public, private, '198.51.100.' || page_id % 256 AS ip FROM pages JOIN t ON k = page_id % {len(_ENDINGS)})
SELECT page_id, CASE depth WHEN 0 THEN ending WHEN 1 THEN name || '.' || ending WHEN 2 THEN 'a.b.' || name || '.' || ending WHEN 3 THEN upper('www.' || name || '.' || ending) || '.' ELSE ip END AS host,
  CASE WHEN depth = 4 OR depth = 0 AND private = '' THEN NULL WHEN private = '' THEN name || '.' || ending ELSE array_to_string(string_split(ending, '.')[-2:], '.') END AS icann,
  CASE WHEN depth = 4 THEN ip WHEN depth = 0 THEN ending ELSE name || '.' || ending END AS grouped FROM p"""

_ALL = {legacy_ipv4: SQL_LEGACY_IPV4, ip_classify_v4: SQL_IP_CLASSIFY, risk_bands: SQL_RISK_BANDS, public_domains: SQL_DOMAINS}
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: s for f, s in _ALL.items()}
