"""Queries over gates, lookups, reviews and coverage: rows made from events, pages and labels, with SQL that states each rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, domains, guards
from ..operators import archive, intel, lookup, policy, profile, state
from .common import table
from .tables import _seconds

_AT = """CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"""


def response_gate(spark, sf):
    """Responses of every kind of status, type and disposition."""
    i = F.col("page_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "Application/XHTML+XML", "application/pdf", "text/plain", " text/html ")]), (i % 5 + 1).cast("int"))
    named = F.when(i % 2 == 0, "Content-Type").otherwise("content-type")
    headers = F.when(i % 7 == 0, F.create_map(F.lit("Server"), F.lit("x"))).when(i % 11 == 0, F.create_map(named, kind, F.lit("CONTENT-DISPOSITION"), F.lit("Attachment; filename=a"))).otherwise(F.create_map(named, kind))
    status = F.when(i % 13 != 0, (i % 8 * 50 + 150).cast("int"))
    return table(spark, sf, "pages").select("page_id", guards.headers_refused(headers).alias("refused"), guards.status_ok(status).alias("status_ok"))


SQL_RESPONSE = """SELECT page_id, page_id % 7 = 0 OR page_id % 11 = 0 OR page_id % 5 IN (2, 3) AS refused, page_id % 13 <> 0 AND page_id % 8 * 50 + 150 IN (200, 250) AS status_ok FROM pages"""


def answers_public(spark, sf):
    """Every user stands for a host, every event for an answer."""
    ip = F.concat_ws(".", F.col("event_id") % 223 + 1, F.col("event_id") % 256, F.col("user_id") % 256, F.lit(1))
    d = table(spark, sf, "events").select(F.col("user_id").alias("host"), ip.alias("ip")).where("host % 3 = 0")
    key, passed = guards.all_public(F.col("host"), F.col("ip"))
    return d.groupBy(key).agg(passed)


SQL_ANSWERS = """WITH a AS (SELECT user_id AS host, event_id % 223 + 1 AS a, event_id % 256 AS b, user_id % 256 AS c FROM events WHERE user_id % 3 = 0)
SELECT host, bool_and(NOT (a IN (10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113))) AS all_public FROM a GROUP BY host"""


def replayable(spark, sf):
    """Archive rows with whole, broken, unfinished and missing JSON."""
    i = F.col("page_id")
    raw = (
        F.when(i % 6 == 0, F.lit('{"classification":"benign","page":{"status":"ok","final_url":"https://urlmill.test/"}}')).when(i % 6 == 1, F.lit('{"classification":"unavailable"}'))
        .when(i % 6 == 2, F.lit('{"classification":"phishing","error_code":"x"}')).when(i % 6 == 3, F.lit('{"classification":"benign","page":{"status":"ok","final_url":"https://urlmill.test/a.pdf"}}')).when(i % 6 == 4, F.lit("{broken"))
    )
    d = table(spark, sf, "pages").select("page_id", raw.alias("raw_response_json"), F.when(i % 4 == 0, "malware").otherwise("unavailable").alias("last_classification"), F.when(i % 5 == 0, "unknown").otherwise("safe").alias("last_verdict"), F.lit("page").alias("last_decision_stage"))
    keep = domains.result_reusable(F.col("last_classification"), F.col("last_verdict"), F.col("last_decision_stage"), F.when(i % 3 == 0, "timeout"), F.lit("ok"), F.lit("https://urlmill.test/"), F.when(i % 10 == 4, "https://urlmill.test/a.zip"))
    return d.select("page_id", archive.reusable(d).alias("replay"), keep.alias("keep"))


SQL_REPLAY = """SELECT page_id, page_id % 6 = 0 OR (page_id % 6 = 5 AND page_id % 4 = 0 AND page_id % 5 <> 0) AS replay, page_id % 4 = 0 AND page_id % 5 <> 0 AND page_id % 3 <> 0 AND page_id % 10 <> 4 AS keep FROM pages"""


def cache_lookups(spark, sf):
    """Clicks look up what views wrote, valid for a day."""
    e = _seconds(spark, sf)
    entries = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("key"), F.col("at").alias("fetched_at")).agg(F.max("event_id").alias("payload")).withColumn("expires_at", F.col("fetched_at") + 86_400)
    asked = e.where("event_type = 'click'").select(F.col("user_id").alias("key"), "at")
    return state.cache_as_of(asked, entries).groupBy("key").agg(F.count(F.lit(1)).alias("lookups"), F.count("payload").alias("hits"), F.coalesce(F.sum("payload"), F.lit(0)).alias("payloads"))


SQL_CACHE = f"""WITH e AS (SELECT event_id, user_id, event_type, {_AT} AS t FROM events), v AS (SELECT user_id, t, max(event_id) AS p FROM e WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click'),
j AS (SELECT c.event_id, c.user_id, arg_max(v.p, v.t) AS p FROM c LEFT JOIN v ON v.user_id = c.user_id AND v.t <= c.t AND c.t < v.t + 86400 GROUP BY 1, 2)
SELECT user_id AS key, count(*) AS lookups, count(p) AS hits, CAST(coalesce(sum(p), 0) AS BIGINT) AS payloads FROM j GROUP BY 1"""


def review_log(spark, sf):
    """Events as review decisions: users are hosts of four addresses."""
    url = F.concat_ws("/", F.col("user_id"), F.col("event_id") % 4)
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), url.alias("url"), F.col("user_id").alias("host"), F.when(F.col("event_type") == "error", "reject").otherwise("approve").alias("decision"), F.concat(F.lit("r"), F.col("event_id") % 3).alias("reviewer"), F.col("event_id").alias("at"))
    sites = log.select("url", "host").distinct()
    return archive.apply_reviews(sites, log).select("url", "approved_at", "approved_by")


SQL_REVIEWS = """WITH l AS (SELECT event_id AS seq, user_id || '/' || event_id % 4 AS url, user_id AS host, event_type = 'error' AS reject FROM events), s AS (SELECT DISTINCT url, host FROM l),
a AS (SELECT url, max(seq) AS seq FROM l WHERE NOT reject GROUP BY 1), c AS (SELECT host, max(seq) AS seq FROM l WHERE reject GROUP BY 1)
SELECT s.url, CASE WHEN a.seq > coalesce(c.seq, -1) THEN a.seq END AS approved_at, CASE WHEN a.seq > coalesce(c.seq, -1) THEN 'r' || a.seq % 3 END AS approved_by FROM s LEFT JOIN a USING (url) LEFT JOIN c USING (host)"""


def report_scans(spark, sf):
    """Every purchase is a report on the scan of its number; three in four scans are kept."""
    e = table(spark, sf, "events")
    log = e.where("event_id % 4 <> 0").select(F.col("event_id").alias("scan_ref"), "value", F.col("event_id").alias("scanned_at")).select("scan_ref", "scanned_at", F.when(F.col("value") > 50, "malicious").otherwise("safe").alias("verdict"), F.col("value").alias("score"))
    reports = e.where("event_type = 'purchase'").select(F.col("event_id").alias("report_id"), (F.col("event_id") + 1).alias("scan_ref"))
    return archive.with_scan(reports, log).select("report_id", "scan_ref", F.col("scan.verdict").alias("verdict"), F.col("scan.score").alias("score"))


SQL_REPORT_SCANS = """SELECT r.event_id AS report_id, r.event_id + 1 AS scan_ref, CASE WHEN s.value > 50 THEN 'malicious' WHEN s.event_id IS NOT NULL THEN 'safe' END AS verdict, s.value AS score FROM events r LEFT JOIN events s ON s.event_id = r.event_id + 1 AND s.event_id % 4 <> 0 WHERE r.event_type = 'purchase'"""


def explanations(spark, sf):
    e = table(spark, sf, "pages").select(F.col("page_id").alias("scan_id"), F.when(F.col("page_id") % 3 == 0, F.col("page_id") - 1).alias("evidence_scan_id"))
    saved = e.where("scan_id % 2 = 0").select("scan_id", F.concat(F.lit("why "), F.col("scan_id")).alias("explanation"))
    return lookup.with_explanation(e, saved)


SQL_EXPLANATIONS = """WITH e AS (SELECT page_id AS scan_id, CASE WHEN page_id % 3 = 0 THEN page_id - 1 END AS evidence_scan_id FROM pages)
SELECT scan_id, evidence_scan_id, CASE WHEN coalesce(evidence_scan_id, scan_id) % 2 = 0 AND coalesce(evidence_scan_id, scan_id) IN (SELECT page_id FROM pages) THEN 'why ' || coalesce(evidence_scan_id, scan_id) END AS explanation FROM e"""


def record_fields(spark, sf):
    """First non-empty fields, health and parse ledger over page ids."""
    i = F.col("page_id")
    flag = lambda n: i % n != 0
    d = table(spark, sf, "pages").select(
        "page_id", intel.threat_type(F.when(i % 2 == 0, "malware").otherwise(""), F.when(i % 3 == 0, F.array(F.lit("a"), F.lit(""), F.lit("b"))).otherwise(F.array().cast("array<string>"))).alias("threat"),
        intel.first_seen(F.when(i % 4 == 0, "").otherwise(F.lit(" 2024-01-02   03:04 ")), F.lit("later")).alias("first_seen"), display.health(flag(2), flag(3), flag(5), i % 7 == 0, flag(11)).alias("health"),
        F.struct(i.alias("value"), F.when(i % 9 == 0, "no_nodes").alias("error")).alias("parsed"),
    )
    good, ledger = lookup.split_failures(d, "parsed", "page_id", "threat", "first_seen", "health")
    return ledger.unionByName(good.select("page_id", "threat", "first_seen", "health", F.lit(None).cast("string").alias("reason")))


SQL_RECORDS = """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'malware' WHEN page_id % 3 = 0 THEN 'a,b' END AS threat, CASE WHEN page_id % 4 = 0 THEN 'later' ELSE '2024-01-02 03:04' END AS first_seen,
  CASE WHEN page_id % 2 <> 0 AND page_id % 3 <> 0 AND page_id % 5 <> 0 AND (page_id % 7 <> 0 OR page_id % 11 <> 0) THEN 'ok' ELSE 'degraded' END AS health, CASE WHEN page_id % 9 = 0 THEN 'no_nodes' END AS reason FROM pages"""


def navigation(spark, sf):
    """Event numbers as bits of a browser's state."""
    i = F.col("event_id")
    bit = lambda n: (F.shiftright(i, n) % 2) == 1
    d = table(spark, sf, "events").select(
        "event_id", (i % 9 != 0).alias("protected"), (i % 7 != 0).alias("main_frame"), (i % 11 == 0).alias("ignored"), (i % 13 == 0).alias("skipped_once"), (i % 17 == 0).alias("trusted"), (i % 19 == 0).alias("allowlisted"),
        F.when(i % 3 != 0, bit(0)).alias("cached_high_risk"), bit(1).alias("server_ok"), bit(2).alias("server_high_risk"),
    )
    return policy.navigation(d).select("event_id", "action")


SQL_NAVIGATION = """SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 THEN 'open'
  WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN 'open' WHEN (event_id >> 1) % 2 = 1 THEN CASE WHEN (event_id >> 2) % 2 = 1 THEN 'block' ELSE 'open' END WHEN event_id % 3 <> 0 THEN 'block' ELSE 'open' END AS action FROM events"""


def label_values(spark, sf):
    """Labels that are neither 0 nor 1, by value."""
    raw = F.when(F.col("doc_id") % 5 == 0, " maybe ").when(F.col("doc_id") % 5 == 1, F.concat(F.lit(" "), F.col("quality"))).when(F.col("doc_id") % 5 == 2, "2").when(F.col("doc_id") % 5 == 3, F.col("toxic").cast("string"))
    return profile.invalid_labels(table(spark, sf, "labels").select(raw.alias("label")), "label")


SQL_LABELS = """WITH v AS (SELECT trim(coalesce(CASE doc_id % 5 WHEN 0 THEN ' maybe ' WHEN 1 THEN ' ' || quality WHEN 2 THEN '2' WHEN 3 THEN CAST(toxic AS VARCHAR) END, '')) AS value FROM labels) SELECT value, count(*) AS rows FROM v WHERE value NOT IN ('0', '1') GROUP BY 1"""


def slice_coverage(spark, sf):
    """Rows of each slice of page length and host by split, and where they are too few."""
    d = table(spark, sf, "pages").select(F.when(F.col("page_id") % 10 == 0, "test").when(F.col("page_id") % 10 == 1, "validation").otherwise("train").alias("part"), F.length("html").alias("n"), "url")
    return profile.coverage_table(d, "part", {"short": F.col("n") <= 2000, "long": F.col("n") > 10_000, "plain_http": F.col("url").startswith("http:")})


SQL_COVERAGE_TABLE = """WITH d AS (SELECT CASE page_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, length(html) AS n, url FROM pages),
c AS (SELECT split, 'short' AS slice, count(*) FILTER (n <= 2000) AS rows FROM d GROUP BY 1 UNION ALL SELECT split, 'long', count(*) FILTER (n > 10000) FROM d GROUP BY 1 UNION ALL SELECT split, 'plain_http', count(*) FILTER (starts_with(url, 'http:')) FROM d GROUP BY 1)
SELECT *, rows < 10 AS gap FROM c"""

_ALL = {
    response_gate: SQL_RESPONSE, answers_public: SQL_ANSWERS, replayable: SQL_REPLAY, cache_lookups: SQL_CACHE, review_log: SQL_REVIEWS, report_scans: SQL_REPORT_SCANS, explanations: SQL_EXPLANATIONS, record_fields: SQL_RECORDS,
    navigation: SQL_NAVIGATION, label_values: SQL_LABELS, slice_coverage: SQL_COVERAGE_TABLE,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: s for f, s in _ALL.items()}
