"""Queries over pages: feed and reputation joins, HTML operators, the decision cascade, corpus rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages as pg
from ..functions import rules, urls
from ..operators import corpus, intel, policy
from .common import parts_sql, quoted, table
from .urls import _RISK

POPULAR = ["example.com", "thther.example.org", "tionsh.example.net"]


def _scans(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("scan_id"), "url")


def _feed(spark, sf) -> DataFrame:
    """A feed made of pages: every tenth URL as it is, and every seventh one's host with its first path segment."""
    p = table(spark, sf, "pages").select("page_id", "url")
    u = urls.parse(F.col("url"))
    exact = p.where("page_id % 10 = 0").select((F.col("page_id") * 2).alias("feed_seq"), "url")
    above = p.where("page_id % 7 = 0").select((F.col("page_id") * 2 + 1).alias("feed_seq"), F.concat(u["scheme"], F.lit("://"), u["host"], F.regexp_extract(u["path"], "^(/[^/]*)", 1)).alias("url"))
    return exact.unionByName(above).select("feed_seq", "url", F.concat(F.lit("id"), F.col("feed_seq").cast("string")).alias("id"), F.when(F.col("feed_seq") % 3 == 0, "malware_download").otherwise("phishing").alias("threat"))


_FEED = f"""{parts_sql("pages", keep="page_id, url")},
feed AS (SELECT page_id * 2 AS feed_seq, url, host, path FROM h WHERE page_id % 10 = 0 UNION ALL
  SELECT page_id * 2 + 1, scheme || '://' || host || regexp_extract(path, '^(/[^/]*)', 1), host, regexp_extract(path, '^(/[^/]*)', 1) FROM h WHERE page_id % 7 = 0),
fd AS (SELECT feed_seq, url, host, coalesce(nullif(regexp_replace(path, '/+$', ''), ''), '/') AS lp, 'id' || feed_seq AS id, CASE WHEN feed_seq % 3 = 0 THEN 'malware_download' ELSE 'phishing' END AS threat FROM feed),
ex AS (SELECT url, min(feed_seq) AS s FROM fd GROUP BY url),
e AS (SELECT h.page_id AS scan_id, h.url, s FROM h LEFT JOIN ex USING (url)),
ho AS (SELECT h.page_id AS scan_id, min(fd.feed_seq) AS s FROM h JOIN fd ON fd.host = h.host AND CASE WHEN lp = '/' THEN coalesce(nullif(regexp_replace(h.path, '/+$', ''), ''), '/') = '/'
  ELSE coalesce(nullif(regexp_replace(h.path, '/+$', ''), ''), '/') = lp OR starts_with(coalesce(nullif(regexp_replace(h.path, '/+$', ''), ''), '/'), lp || '/') END GROUP BY 1)"""


def feed_exact(spark, sf):
    return intel.match_exact(_scans(spark, sf), _feed(spark, sf)).na.fill(-1, ["feed_seq"])


def feed_host_prefix(spark, sf):
    return intel.match_host(_scans(spark, sf), _feed(spark, sf)).na.fill(-1, ["feed_seq"])


def feed_precedence(spark, sf):
    return intel.match_feed(_scans(spark, sf), _feed(spark, sf))


SQL_FEED_EXACT = f"WITH {_FEED} SELECT scan_id, e.url, s IS NOT NULL AS matched, coalesce(s, -1) AS feed_seq, fd.id, fd.threat FROM e LEFT JOIN fd ON fd.feed_seq = s"
SQL_FEED_HOST = f"WITH {_FEED} SELECT h.page_id AS scan_id, h.url, s IS NOT NULL AS matched, coalesce(s, -1) AS feed_seq, fd.id, fd.threat FROM h LEFT JOIN ho ON ho.scan_id = h.page_id LEFT JOIN fd ON fd.feed_seq = s"
SQL_FEED_BOTH = f"WITH {_FEED} SELECT e.scan_id, e.url, coalesce(e.s, ho.s) IS NOT NULL AS matched, CASE WHEN e.s IS NOT NULL THEN 'url' WHEN ho.s IS NOT NULL THEN 'host' END AS match_kind, fd.id, fd.threat FROM e LEFT JOIN ho USING (scan_id) LEFT JOIN fd ON fd.feed_seq = coalesce(e.s, ho.s)"


def popular_hosts(spark, sf):
    listed = spark.createDataFrame([(d,) for d in POPULAR], "domain string")
    own = urls.parse(F.col("url"))["host"]
    # Every fifth page stands for a host of the fixed list, below www or another label, or for a look-alike.
    some = F.element_at(F.array(*[F.lit(x) for x in rules.WELL_KNOWN]), (F.col("page_id") % len(rules.WELL_KNOWN) + 1).cast("int"))
    host = F.when(F.col("page_id") % 15 == 0, F.concat(F.lit("www."), some)).when(F.col("page_id") % 15 == 5, F.concat(F.lit("not"), some)).when(F.col("page_id") % 15 == 10, F.concat(F.lit("a.b."), some)).otherwise(own)
    p = table(spark, sf, "pages").select("page_id", host.alias("host"))
    return intel.with_reputation(p, listed).select("page_id", "is_popular", "is_well_known")


SQL_POPULAR = f"""WITH {parts_sql('pages', keep='page_id')} SELECT page_id, regexp_replace(host, '^www[.]', '') IN ({', '.join(map(quoted, POPULAR))}) AS is_popular,
  list_contains(k, host) OR list_contains(k, array_to_string(string_split(host, '.')[-2:], '.')) AS is_well_known FROM (SELECT page_id, k, CASE page_id % 15 WHEN 0 THEN 'www.' || w WHEN 5 THEN 'not' || w WHEN 10 THEN 'a.b.' || w ELSE host END AS host
  FROM (SELECT *, k[page_id % len(k) + 1] AS w FROM h, (SELECT [{', '.join(map(quoted, rules.WELL_KNOWN))}] AS k)))"""


def allowlist_anti(spark, sf):
    """Pages whose exact address is not on the allowlist (every third page's address)."""
    p = table(spark, sf, "pages").select("page_id", urls.allow_key(F.col("url")).alias("k"))
    return p.join(p.where("page_id % 3 = 0").select("k").distinct(), "k", "left_anti").select("page_id")


SQL_ALLOWLIST = f"""WITH {parts_sql('pages', keep='page_id')}, k AS (SELECT page_id, scheme || host || port_text || path || '?' || query AS k FROM h)
SELECT page_id FROM k WHERE k NOT IN (SELECT k FROM k WHERE page_id % 3 = 0)"""


def html_clean_len(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(pg.clean_regex(F.col("html"))).cast("long").alias("clean_chars"))


_CLEAN = "html"
_CLEAN = f"regexp_replace({_CLEAN}, '(?s)<!--.*?-->', '', 'g')"
for _t in pg.DROPPED:
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_t}\\b[^>]*>.*?</{_t}\\s*>', '', 'g')"
SQL_CLEAN = f"SELECT page_id, length({_CLEAN}) AS clean_chars FROM pages"


def page_signals(spark, sf):
    return table(spark, sf, "pages").select("page_id", pg.signals(F.col("html")).alias("s")).select("page_id", "s.*")


SQL_SIGNALS = f"""SELECT page_id, len(regexp_extract_all(c, '(?i)<form\\b'))::INT AS forms, len(regexp_extract_all(c, '(?i)<input\\b[^>]*\\btype\\s*=\\s*[\"'']?password'))::INT AS password_inputs,
  len(regexp_extract_all(c, '(?i)<input\\b'))::INT AS inputs, len(regexp_extract_all(c, '(?i)<a\\b[^>]*\\bhref'))::INT AS links, len(regexp_extract_all(c, '(?i)<iframe\\b'))::INT AS iframes FROM (SELECT page_id, {_CLEAN} AS c FROM pages)"""


def page_signals_regex(spark, sf):
    return table(spark, sf, "pages").select("page_id", pg.signals_regex(pg.clean_regex(F.col("html"))).alias("s")).select("page_id", "s.*")


def page_text_nodes(spark, sf):
    return pg.text_nodes(table(spark, sf, "pages").select("page_id", "html"))


def policy_cascade(spark, sf):
    """Every page through the cascade, with made-up scores, feed, approvals and outages by page_id."""
    i = F.col("page_id")
    n = urls.normalize(table(spark, sf, "pages").select("page_id", "url"))
    n = n.withColumn("url", F.coalesce("normalized.value", "url"))
    d = rules.lexical_risk(n)
    host = urls.parse(F.col("url"))["host"]
    d = d.select(
        "page_id", "heuristic", F.col("normalized.error_code").alias("error"), (i % 31 != 0).alias("archive_ok"), (i % 11 == 0).alias("rescan"), (i % 13 == 0).alias("inspect_page"), (i % 17 == 0).alias("approved"), (i % 19 != 0).alias("feed_ok"),
        (i % 10 == 0).alias("listed"), F.when(i % 6 == 0, F.struct(F.lit("benign").alias("classification"), F.lit(80).alias("confidence"), F.lit(0.25).alias("score"), F.lit("safe").alias("verdict"), (i % 12 == 0).alias("reusable"))).alias("prior"),
        urls.registered_domain(host).isin("example.com").alias("known"), (i % 23 != 0).alias("page_ok"), (F.pmod(i * 37, F.lit(100)) / F.lit(100.0)).alias("page_score"), (i % 2).cast("int").alias("password_inputs"),
        F.when(F.col("url").startswith("http:"), "http").otherwise("https").alias("scheme"),
    )
    return policy.decide(d).select("page_id", "classification", "confidence", "risk_score", "risk_level", "decision_stage", "error_code", "verdict")


SQL_POLICY = f"""WITH src AS (SELECT page_id, url FROM pages), {_RISK},
ids AS (SELECT page_id AS i, label, confidence AS hc, risk_score / 100.0::DOUBLE AS hr, s0, (page_id * 37 % 100) / 100.0::DOUBLE AS ps, regexp_matches(host, '(^|[.])example[.]com$') AS dom FROM lex),
gates AS (SELECT *, i % 11 <> 0 AND i % 13 <> 0 AS fresh, i % 17 = 0 AND i % 19 <> 0 AND i % 31 <> 0 AS cleared FROM ids),
pick AS (SELECT *, CASE WHEN i % 31 = 0 AND fresh THEN 1 WHEN cleared AND i % 10 <> 0 THEN 2 WHEN i % 12 = 0 AND fresh AND i % 31 <> 0 AND NOT (cleared AND i % 10 = 0) THEN 3 WHEN i % 19 = 0 THEN 4 WHEN i % 10 = 0 THEN 5
  WHEN i % 13 <> 0 AND label = 'benign' AND hc > 80 AND dom THEN 6 WHEN i % 23 = 0 THEN 7 WHEN ps < 0.6::DOUBLE AND label = 'phishing' THEN 8 WHEN ps >= 0.6::DOUBLE AND label = 'benign' AND i % 2 = 0 THEN 9 ELSE 10 END AS k FROM gates),
res AS (SELECT *, CASE k WHEN 2 THEN 'benign' WHEN 3 THEN 'benign' WHEN 5 THEN 'malware' WHEN 6 THEN 'benign' WHEN 8 THEN 'phishing' WHEN 9 THEN 'benign' WHEN 10 THEN CASE WHEN ps >= 0.6::DOUBLE THEN 'phishing' ELSE 'benign' END ELSE 'unavailable' END AS classification,
  CASE k WHEN 2 THEN 100 WHEN 3 THEN 80 WHEN 5 THEN 97 WHEN 6 THEN hc WHEN 8 THEN hc WHEN 9 THEN 50 WHEN 10 THEN round_even(CASE WHEN ps >= 0.6::DOUBLE THEN ps ELSE 1 - ps END * 100, 0) ELSE 0 END AS confidence,
  CASE k WHEN 2 THEN 0 WHEN 3 THEN 0.25::DOUBLE WHEN 5 THEN 1 WHEN 6 THEN hr WHEN 8 THEN greatest(ps, hr, 0.6::DOUBLE) WHEN 9 THEN ps WHEN 10 THEN ps END AS s1 FROM pick),
fin AS (SELECT *, round(CASE WHEN k <> 3 AND s0 = 'http' AND s1 IS NOT NULL THEN least(1.0::DOUBLE, round(s1 + 0.1::DOUBLE, 4)) ELSE s1 END, 4) AS risk_score FROM res)
SELECT i AS page_id, classification, CAST(confidence AS INT) AS confidence, risk_score,
  CASE WHEN risk_score >= 0.8::DOUBLE THEN 'High Risk' WHEN risk_score >= 0.6::DOUBLE THEN 'MALICIOUS' WHEN risk_score >= 0.4::DOUBLE THEN 'POTENTIALLY UNSAFE' WHEN risk_score IS NOT NULL THEN 'SAFE' END AS risk_level,
  CASE k WHEN 2 THEN 'approved' WHEN 3 THEN 'history' WHEN 5 THEN 'urlhaus' WHEN 6 THEN 'heuristic' WHEN 8 THEN 'page' WHEN 9 THEN 'page' WHEN 10 THEN 'page' ELSE 'error' END AS decision_stage,
  CASE k WHEN 1 THEN 'history_unavailable' WHEN 4 THEN 'threat_intel_unavailable' WHEN 7 THEN 'page_unavailable' END AS error_code,
  CASE WHEN k = 3 THEN 'safe' WHEN classification = 'malware' THEN 'malicious' WHEN classification = 'unavailable' THEN 'unknown' WHEN k < 8 THEN 'safe' WHEN ps > 0.6::DOUBLE THEN 'malicious' WHEN ps >= 0.4::DOUBLE THEN 'potentially_unsafe' ELSE 'safe' END AS verdict FROM fin"""


def _rows(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "url", "html", F.when(F.col("page_id") % 3 == 0, "phish").otherwise("benign").alias("label"))
    return corpus.normalize_pages(p)


_ROWS = f"""{parts_sql("pages", keep="page_id, url, html")},
r AS (SELECT html, length(html) AS html_len, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS label_id, url, host, sha256(html) AS sha256, regexp_matches(html, '(?i)<input\\b[^>]*\\btype\\s*=\\s*[\"'']?password') AS is_login, length(html) <= 2000 AS short FROM h WHERE length(html) BETWEEN 20 AND 1000000)"""


def page_rows(spark, sf):
    return _rows(spark, sf).select("url", F.col("html_len").cast("long").alias("html_len"), "label_id", "host", "sha256", "is_login", "short", F.length("html").cast("long").alias("kept"))


SQL_PAGE_ROWS = f"WITH {_ROWS} SELECT url, html_len, label_id, host, sha256, is_login, short, least(html_len, 300000) AS kept FROM r"


def coverage_select(spark, sf):
    return corpus.coverage(_rows(spark, sf), 30, [("short", 0.2), ("is_login", 0.2)], "cov", "sha256", "label_id").select("sha256", "label_id", "short")


SQL_COVERAGE = f"""WITH {_ROWS}, o AS (SELECT *, sha256('cov|' || sha256) AS k FROM r),
a AS (SELECT *, short AND row_number() OVER (PARTITION BY label_id, short ORDER BY k, sha256) <= 6 AS picked FROM o)
SELECT sha256, label_id, short FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY picked DESC, k, sha256) AS n FROM a) WHERE n <= 30"""


def group_split(spark, sf):
    d = _rows(spark, sf).withColumn("group", corpus.host_group(F.col("host"), F.col("sha256")))
    train, val = corpus.split_groups(d, 20, "split", "group")
    return train.select(F.lit("train").alias("split"), "sha256").unionByName(val.select(F.lit("validation").alias("split"), "sha256"))


def split_leakage_check(spark, sf):
    d = _rows(spark, sf).withColumn("group", corpus.host_group(F.col("host"), F.col("sha256")))
    train, val = corpus.split_groups(d, 20, "split", "group")
    # A third split that does share groups and hashes with the others.
    mixed = d.where(F.substring("sha256", 1, 1).isin("0", "1", "2"))
    return corpus.leakage({"train": train, "validation": val, "mixed": mixed}).select("split", "repeated", "classes", "shared_g", "shared_s")


_SPLIT = f"""WITH RECURSIVE {_ROWS},
d AS (SELECT sha256, label_id, CASE WHEN coalesce(regexp_replace(host, '[.]+$', ''), '') <> '' THEN 'host:' || regexp_replace(host, '[.]+$', '') ELSE 'hash:' || sha256 END AS g FROM r),
c AS (SELECT g, count(*) FILTER (label_id = 0) AS n0, count(*) FILTER (label_id = 1) AS n1 FROM d GROUP BY g),
o AS (SELECT *, row_number() OVER (ORDER BY sha256('split|' || g), g) AS i FROM c WHERE n0 <= 20 AND n1 <= 20),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, NULL::VARCHAR AS g, FALSE AS fits UNION ALL
  SELECT o.i, CASE WHEN a + n0 <= 20 AND b + n1 <= 20 THEN a + n0 ELSE a END, CASE WHEN a + n0 <= 20 AND b + n1 <= 20 THEN b + n1 ELSE b END, o.g, a + n0 <= 20 AND b + n1 <= 20 FROM f JOIN o ON o.i = f.i + 1),
t AS (SELECT CASE WHEN g IN (SELECT g FROM f WHERE fits) THEN 'validation' ELSE 'train' END AS split, d.* FROM d)"""
SQL_SPLIT = f"{_SPLIT} SELECT split, sha256 FROM t"
SQL_LEAKAGE = f"""{_SPLIT}, m AS (SELECT 'mixed' AS split, * FROM d WHERE substr(sha256, 1, 1) IN ('0', '1', '2')), e AS (SELECT * FROM t UNION ALL SELECT * FROM m),
x AS (SELECT g FROM e GROUP BY g HAVING count(DISTINCT split) > 1), y AS (SELECT sha256 FROM e GROUP BY sha256 HAVING count(DISTINCT split) > 1)
SELECT split, count(*) - count(DISTINCT sha256) AS repeated, count(DISTINCT label_id) AS classes, count(DISTINCT g) FILTER (g IN (SELECT g FROM x)) AS shared_g, count(DISTINCT sha256) FILTER (sha256 IN (SELECT sha256 FROM y)) AS shared_s FROM e GROUP BY split"""


def sampling_report(spark, sf):
    return corpus.sampling_report(_rows(spark, sf), 100)


SQL_SAMPLING = f"WITH {_ROWS} SELECT label_id, count(*) AS actual, 100::BIGINT AS target, count(DISTINCT host) AS hosts FROM r GROUP BY 1"

QUERIES = {f.__name__: f for f in (feed_exact, feed_host_prefix, feed_precedence, popular_hosts, allowlist_anti, html_clean_len, page_signals, page_signals_regex, page_text_nodes, policy_cascade, page_rows, coverage_select, group_split, split_leakage_check, sampling_report)}
ORACLES = {
    "feed_exact": SQL_FEED_EXACT, "feed_host_prefix": SQL_FEED_HOST, "feed_precedence": SQL_FEED_BOTH, "popular_hosts": SQL_POPULAR, "allowlist_anti": SQL_ALLOWLIST, "html_clean_len": SQL_CLEAN, "page_signals": SQL_SIGNALS,
    "page_signals_regex": SQL_SIGNALS, "policy_cascade": SQL_POLICY, "page_rows": SQL_PAGE_ROWS, "coverage_select": SQL_COVERAGE, "group_split": SQL_SPLIT, "split_leakage_check": SQL_LEAKAGE, "sampling_report": SQL_SAMPLING,
}
