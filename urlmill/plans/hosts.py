"""Queries over addresses and hosts made from page rows: ranges of both IP versions, public suffix rules. Their SQL states ranges as bounds and rules as endings, and reads no table of the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import networks, suffixes
from .common import parts_sql, table


def _group(h, i):  # noqa: ANN001, ANN202
    return F.regexp_replace(F.substring(h, 4 * i + 1, 4), "^0{1,3}", "")


def page_addresses(spark, sf):
    """An address literal of each page, from its URL's digest: one of nine forms by page_id, of which some lie in special ranges, and two are none."""
    h, i = F.md5("url"), F.col("page_id")
    octet = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10)
    first = F.get(F.array(*[F.lit(x) for x in ("10", "127", "169.254", "172.20", "192.0.0", "192.0.2", "192.168", "198.19", "203.0.113", "224", "240", "255", "100.100", "0", "198.51.100", "192.0.1")]), (F.pmod(F.floor(i / 9), F.lit(16))).cast("int"))
    tail = lambda n: F.concat_ws(".", *[octet(k) for k in range(n)])
    dots = F.length(first) - F.length(F.replace(first, F.lit("."), F.lit("")))
    special = F.concat_ws(".", first, F.when(dots == 0, tail(3)).when(dots == 1, tail(2)).otherwise(tail(1)))
    prefix = F.get(F.array(*[F.lit(x) for x in ("fe80:", "fd12:3456", "2001:db8", "2002:7f00", "ff02:", "64:ff9b:1", "100:", "2001:0", "2a00:1450", "::", "2001:20", "fec0:", "5f00:")]), (F.pmod(F.floor(i / 9), F.lit(13))).cast("int"))
    host = F.concat(_group(h, 1), F.lit(":"), _group(h, 2))
    v6 = F.concat_ws(":", *[_group(h, k) for k in range(8)])
    forms = [tail(4), special, v6, F.concat(prefix, F.when(prefix == "::", host).otherwise(F.concat(F.lit("::"), host))), F.concat(F.lit("::ffff:"), special), F.concat(F.lit("["), v6, F.lit("]")), F.concat(F.lit("::FFFF:"), _group(h, 0), F.lit(":"), _group(h, 1)), F.concat(tail(4), F.lit(".1")), F.concat(F.lit("1::"), v6)]
    ip = F.get(F.array(*forms), F.pmod(i, F.lit(9)).cast("int"))
    # A prefix that ends in a colon brings one of the two.
    ip = F.regexp_replace(ip, ":::", "::")
    return networks.classify(table(spark, sf, "pages").select("page_id", ip.alias("ip")), "ip")


# Bounds of ranges as hex digits, first match first; IPv4 has eight.
_RANGES = [
    ("unspecified address", "00000000 00000000", "0*32 0*32"), ("loopback address", "7f000000 7fffffff", "0*31,1 0*31,1"), ("link-local address", "a9fe0000 a9feffff", "fe80,0*28 febf,f*28"), ("multicast address", "e0000000 efffffff", "ff,0*30 ff,f*30"),
    ("private address", "00000000 00ffffff 0a000000 0affffff ac100000 ac1fffff c0000000 c0000008 c000000b c00000ff c0000200 c00002ff c0a80000 c0a8ffff c6120000 c613ffff c6336400 c63364ff cb007100 cb0071ff f0000000 ffffffff",
     "0064ff9b0001,0*20 0064ff9b0001,f*20 0100,0*28 01000000,0*8,f*16 20010000,0*24 20010001,0*24 20010001,0*23,3 20010002,f*24 20010004,0*24 200100040111,f*20 200100040113,0*20 2001001f,f*24 20010040,0*24 200101ff,f*24 20010db8,0*24 20010db8,f*24 2002,0*28 2002,f*28 fc,0*30 fd,f*30"),
    ("reserved address", "", "00,0*30 1f,f*30 40,0*30 f7,f*30 f8,0*30 fb,f*30 fe00,0*28 fe7f,f*28"),
    ("non-routable range 100.64.0.0/10", "64400000 647fffff", ""), ("non-routable range 192.0.0.0/24", "c0000000 c00000ff", ""), ("", "00000000 ffffffff", "0*32 f*32"),
]


def _bound(text: str) -> str:
    return "'" + "".join(p[0] * int(p[2:]) if p[1:2] == "*" else p for p in text.split(",")) + "'"


def _case() -> str:
    out = []
    for reason, v4, v6 in _RANGES:
        for text in (v4, v6):
            b = text.split()
            for low, high in zip(b[::2], b[1::2]):
                low, high = _bound(low), _bound(high)
                out.append(f"WHEN length(x) = {len(low) - 2} AND x BETWEEN {low} AND {high} THEN '{reason}'")
    return " ".join(out)


# The same addresses as hex digits, built from the digest; the literal as the query writes it.
SQL_ADDRESSES = f"""WITH p AS (SELECT page_id, md5(url) AS h, ['10', '127', '169.254', '172.20', '192.0.0', '192.0.2', '192.168', '198.19', '203.0.113', '224', '240', '255', '100.100', '0', '198.51.100', '192.0.1'][(page_id // 9) % 16 + 1] AS f,
  ['fe80:', 'fd12:3456', '2001:db8', '2002:7f00', 'ff02:', '64:ff9b:1', '100:', '2001:0', '2a00:1450', '::', '2001:20', 'fec0:', '5f00:'][(page_id // 9) % 13 + 1] AS pre, page_id % 9 AS k FROM pages),
o AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS INT), 2))::BIGINT) AS o, list_transform(range(0, 8), lambda i: regexp_replace(substr(h, CAST(4 * i + 1 AS INT), 4), '^0{{1,3}}', '')) AS g,
  list_transform(string_split(f, '.'), lambda x: x::BIGINT) AS fo FROM p),
a AS (SELECT *, list_concat(fo, o[1:4 - len(fo)]) AS so, array_to_string(g, ':') AS v6 FROM o),
b AS (SELECT *, array_to_string(list_transform(so, lambda x: x::VARCHAR), '.') AS sp, array_to_string(list_transform(so, lambda x: printf('%02x', x)), '') AS sx, array_to_string(list_transform(o[1:4], lambda x: x::VARCHAR), '.') AS t FROM a),
c AS (SELECT page_id, CASE k WHEN 0 THEN t WHEN 1 THEN sp WHEN 2 THEN v6 WHEN 3 THEN CASE WHEN pre = '::' THEN '::' WHEN pre LIKE '%:' THEN pre || ':' ELSE pre || '::' END || g[2] || ':' || g[3] WHEN 4 THEN '::ffff:' || sp WHEN 5 THEN '[' || v6 || ']' WHEN 6 THEN '::FFFF:' || g[1] || ':' || g[2] WHEN 7 THEN t || '.1' ELSE '1::' || v6 END AS ip,
  CASE k WHEN 0 THEN substr(h, 1, 8) WHEN 1 THEN sx WHEN 2 THEN h WHEN 3 THEN rpad(CASE WHEN pre = '::' THEN '' ELSE array_to_string(list_transform(string_split(rtrim(pre, ':'), ':'), lambda x: lpad(x, 4, '0')), '') END, 24, '0') || substr(h, 5, 8) WHEN 4 THEN sx WHEN 5 THEN h WHEN 6 THEN substr(h, 1, 8) END AS x FROM b)
SELECT page_id, ip, CASE WHEN x IS NULL THEN 'unparseable IP address' {_case()} END AS reason FROM c"""

#: A list with rules of all kinds, as its file would have them.
RULES = """// a comment
com
net
io

uk
co.uk
jp
*.kawasaki.jp
!city.kawasaki.jp
*.ck
!www.ck
kobe.jp  trailing words
// ===BEGIN PRIVATE DOMAINS===
github.io
*.compute.example.net
// ===END PRIVATE DOMAINS===
org"""
_TAILS = ("com", "co.uk", "uk", "kawasaki.jp", "a.kawasaki.jp", "city.kawasaki.jp", "ck", "x.ck", "www.ck", "github.io", "q.compute.example.net", "compute.example.net", "org", "invalid", "Kobe.JP.", "kobe.jp")


def host_suffixes(spark, sf):
    """Hosts of pages under endings that rules of all kinds name, and addresses: the registrable domain, and the group with private rules."""
    lines = spark.createDataFrame(list(enumerate(RULES.split("\n"))), "line_no int, line string")
    rules = suffixes.parse_rules(lines)
    first = F.replace(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1), F.lit("."), F.lit("-"))
    tail = F.get(F.array(*[F.lit(t) for t in _TAILS]), F.pmod("page_id", F.lit(len(_TAILS))).cast("int"))
    n = F.pmod(F.floor(F.col("page_id") / len(_TAILS)), F.lit(4))
    host = F.when(n == 0, tail).when(n == 1, F.concat(first, F.lit("."), tail)).when(n == 2, F.concat(F.lit("a."), first, F.lit("."), tail)).otherwise(F.concat(F.lit("10.0.0."), F.pmod("page_id", F.lit(256)).cast("string")))
    d = table(spark, sf, "pages").select("page_id", host.alias("host"))
    return suffixes.split_group(suffixes.registrable(d, "host", rules), "host", rules)


_ENDINGS = [(r, p) for p, block in enumerate(RULES.split("// ===BEGIN PRIVATE DOMAINS===")) for r in block.split("\n") if r and not r.startswith("//")]
_VALUES = ", ".join("('{}', {}, {}, {})".format(r.split()[0].lstrip("!").removeprefix("*."), 2 if r[0] == "!" else 1 if r[0] == "*" else 0, p == 1 and r != "org", len(r.split()[0].lstrip("!").removeprefix("*.").split("."))) for r, p in _ENDINGS)
SQL_SUFFIXES = f"""WITH {parts_sql("pages", keep="page_id")}, r(name, kind, private, n) AS (VALUES {_VALUES}),
t AS (SELECT page_id, replace(regexp_extract(authority, '^([^:]*)', 1), '.', '-') AS f, [{", ".join(f"'{t}'" for t in _TAILS)}][page_id % {len(_TAILS)} + 1] AS tail, page_id // {len(_TAILS)} % 4 AS k FROM h),
o AS (SELECT page_id, CASE k WHEN 0 THEN tail WHEN 1 THEN f || '.' || tail WHEN 2 THEN 'a.' || f || '.' || tail ELSE '10.0.0.' || page_id % 256 END AS host, k = 3 AS ip FROM t),
c AS (SELECT *, rtrim(lower(host), '.') AS c FROM o),
m AS (SELECT c.page_id, r.private, r.kind, CASE r.kind WHEN 0 THEN n WHEN 1 THEN n + 1 ELSE n - 1 END AS k FROM c, r WHERE NOT ip AND (c = name AND kind <> 1 OR ends_with(c, '.' || name))),
b AS (SELECT page_id, CASE WHEN max(kind) FILTER (NOT private) = 2 THEN max(k) FILTER (NOT private AND kind = 2) ELSE max(k) FILTER (NOT private) END AS k, CASE WHEN max(kind) = 2 THEN max(k) FILTER (kind = 2) ELSE max(k) END AS kp FROM m GROUP BY 1),
d AS (SELECT c.*, string_split(c, '.') AS l, k, kp FROM c LEFT JOIN b USING (page_id))
SELECT page_id, host, CASE WHEN len(l) > k THEN array_to_string(l[-(k + 1):], '.') END AS domain, CASE WHEN len(l) > kp THEN array_to_string(l[-(kp + 1):], '.') ELSE c END AS "group" FROM d"""

QUERIES = {f.__name__: f for f in (page_addresses, host_suffixes)}
ORACLES = {"page_addresses": SQL_ADDRESSES, "host_suffixes": SQL_SUFFIXES}
