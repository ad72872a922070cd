"""Queries over lookups, domains and display texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, domains, urls
from ..operators import lookup
from .common import parts_sql, quoted, table
from .tables import _S, _scored
from .urls import SOURCE, SQL_TRAIN_REJECT, all_urls


def page_domains(spark, sf):
    u = urls.parse(F.col("url"))
    return table(spark, sf, "pages").select("page_id", domains.public_domain(u["host"]).alias("domain"), domains.netloc(F.col("url")).alias("netloc"), domains.slug(u["host"]).alias("slug"))


SQL_PAGE_DOMAINS = f"WITH {parts_sql('pages', keep='page_id')} SELECT page_id, array_to_string(string_split(host, '.')[-2:], '.') AS domain, lower(authority) AS netloc, regexp_replace(host, '[^a-zA-Z0-9]+', '_', 'g') AS slug FROM h"


def client_lists(spark, sf):
    u = F.col("url")
    return all_urls(spark, sf).select("page_id", domains.is_trusted(u).alias("trusted"), domains.is_ignored(u, "https://example.org").alias("ignored"))


SQL_CLIENT = f"""WITH {SOURCE}, {parts_sql("src", keep="page_id, url")}
SELECT page_id, scheme IN ('http', 'https') AND regexp_replace(regexp_replace(host, '[.]$', ''), '^www[.]', '') IN ({', '.join(map(quoted, domains.TRUSTED))}) AS trusted,
  scheme NOT IN ('http', 'https') OR host = '' OR (port_text <> '' AND (NOT regexp_matches(port_text, '^[0-9]{{1,9}}$') OR TRY_CAST(port_text AS BIGINT) > 65535)) OR regexp_extract(lower(authority), '([^@]*)$', 1) = 'example.org' OR (host IN ('localhost', '127.0.0.1') AND port_text IN ('8000', '5173')) AS ignored FROM h"""


def page_reasoning(spark, sf):
    s = F.struct(F.lit(0).alias("password_inputs"), (F.col("page_id") % 3).cast("int").alias("forms"), (F.col("page_id") % 2).cast("int").alias("iframes"))
    return table(spark, sf, "pages").select("page_id", display.page_reasoning(F.col("page_id") % 100 / F.lit(100.0), s).alias("text"))


SQL_REASONING = """SELECT page_id, 'The fetched page scored ' || format('{:.2f}', page_id % 100 / 100.0::DOUBLE) || ' on the markup classifier. ' || CASE WHEN page_id % 3 > 0 THEN 'It carries ' || (page_id % 3) || ' form(s) but no password field.' ELSE 'It carries no form at all.' END
  || CASE WHEN page_id % 2 > 0 THEN ' 1 iframe(s) are embedded.' ELSE '' END AS text FROM pages"""


def badges(spark, sf):
    c = F.when(F.col("page_id") % 4 == 0, "malware").when(F.col("page_id") % 4 == 1, "benign").when(F.col("page_id") % 4 == 2, "phishing").otherwise("unavailable")
    v = F.when(F.col("page_id") % 5 == 0, "malicious").when(F.col("page_id") % 5 == 1, "potentially_unsafe").otherwise("safe")
    return table(spark, sf, "pages").select("page_id", display.badge(c, v, F.col("page_id") % 10 / F.lit(10.0)).alias("badge"), display.shown_state(c, v, F.col("page_id") % 10 / F.lit(10.0)).alias("state"))


SQL_BADGES = """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'malware' WHEN 1 THEN 'benign' WHEN 2 THEN 'phishing' ELSE 'unavailable' END AS c, CASE page_id % 5 WHEN 0 THEN 'malicious' WHEN 1 THEN 'potentially_unsafe' ELSE 'safe' END AS v, page_id % 10 / 10.0::DOUBLE AS s FROM pages),
h AS (SELECT *, c <> 'unavailable' AND (c IN ('malware', 'phishing') OR v = 'malicious' OR s >= 0.6::DOUBLE) AS high, v = 'potentially_unsafe' OR s >= 0.4::DOUBLE AS mixed FROM p)
SELECT page_id, CASE WHEN high THEN 'STOP' WHEN c = 'benign' AND mixed THEN '!' WHEN c = 'benign' THEN 'OK' ELSE '?' END AS badge, CASE WHEN c IN ('unavailable', 'malware') THEN c WHEN high THEN 'phishing' WHEN mixed THEN 'caution' ELSE c END AS state FROM h"""


def batch_scores(spark, sf):
    """Literal and page URLs through a fixed logistic score over two features; invalid rows stay."""
    model = lambda f: F.round(1 / (1 + F.exp(-(F.lit(-2.0) + f["digit_ratio"] * 10.0 + f["host_label_count"] * 0.25))), 6)
    return lookup.score_batch(all_urls(spark, sf), model, 0.2, 0.3).select("page_id", "status", "prediction", F.coalesce("validation_error", F.lit("")).alias("validation_error"))


SQL_BATCH = f"""{SQL_TRAIN_REJECT.rsplit("SELECT page_id", 1)[0].rstrip()},
v AS (SELECT *, scheme || '://' || hh || CASE WHEN port_text = '' OR TRY_CAST(port_text AS INT) = 0 OR (scheme = 'http' AND TRY_CAST(port_text AS INT) = 80) OR (scheme = 'https' AND TRY_CAST(port_text AS INT) = 443) THEN '' ELSE ':' || CAST(port_text AS INT) END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN fragment <> '' THEN '#' || fragment ELSE '' END AS v FROM e WHERE reason IS NULL),
p AS (SELECT page_id, round(1 / (1 + exp(-(-2.0::DOUBLE + round(length(regexp_replace(v, '[^0-9]', '', 'g')) / length(v)::DOUBLE, 6) * 10.0::DOUBLE + CASE WHEN is_ip THEN 0 ELSE len(string_split(hh, '.')) END * 0.25::DOUBLE))), 6) AS p FROM v)
SELECT e.page_id, CASE WHEN reason IS NULL THEN 'scored' ELSE 'invalid' END AS status, CASE WHEN p >= 0.3::DOUBLE THEN 'phishing' WHEN p >= 0.2::DOUBLE THEN 'review' WHEN p IS NOT NULL THEN 'not_flagged' END AS prediction, coalesce(reason, '') AS validation_error FROM e LEFT JOIN p USING (page_id)"""


def decision_outcomes(spark, sf):
    d = _scored(spark, sf).select(F.col("doc_id").cast("string").alias("sha256"), F.col("label").alias("label_id"), "score", "doc_id")
    return lookup.decisions(d.where("doc_id % 7 <> 0"), d.where("doc_id % 7 = 0"), 0.5).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


SQL_OUTCOMES = f"WITH {_S}, p AS (SELECT label, CASE WHEN doc_id % 7 <> 0 AND score >= 0.5::DOUBLE THEN 1 ELSE 0 END AS p FROM s) SELECT CASE WHEN p = 1 AND label = 1 THEN 'TP' WHEN p = 1 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome, count(*) AS n FROM p GROUP BY 1"


def split_summary(spark, sf):
    d = _scored(spark, sf).select(F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), F.col("label").alias("label_id"), F.col("lang").alias("group"))
    s = lookup.split_summary(d)
    return s.select("split", "rows", F.round("positives", 6).alias("positives"), "groups", F.round("share", 6).alias("share"))


SQL_SPLITS = f"WITH {_S}, d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, label, lang FROM s) SELECT split, count(*) AS rows, round(avg(label), 6) AS positives, count(DISTINCT lang) AS groups, round(count(*) / (SELECT count(*) FROM d)::DOUBLE, 6) AS share FROM d GROUP BY 1"


def group_sizes(spark, sf):
    return lookup.group_sizes(table(spark, sf, "pages").select(urls.parse(F.col("url"))["host"].alias("host")), "host")


SQL_GROUPS = f"WITH {parts_sql('pages', keep='page_id')}, g AS (SELECT host, count(*) AS n FROM h GROUP BY 1) SELECT count(*) AS groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_repeated, max(n) AS largest FROM g"


def shuffle_control(spark, sf):
    d = lookup.shuffled_labels(table(spark, sf, "labels"), "ctl", "doc_id", "quality")
    a = lookup.agreement(d, "quality", "shuffled")
    return a.select("n", F.round("agreement", 6).alias("agreement"))


SQL_CONTROL = "WITH a AS (SELECT quality, row_number() OVER (ORDER BY doc_id) AS n FROM labels), b AS (SELECT quality AS shuffled, row_number() OVER (ORDER BY sha256('ctl|' || doc_id), doc_id) AS n FROM labels) SELECT count(*) AS n, round(avg(CASE WHEN quality = shuffled THEN 1 ELSE 0 END), 6) AS agreement FROM a JOIN b USING (n)"

_ALL = {
    page_domains: SQL_PAGE_DOMAINS, client_lists: SQL_CLIENT, page_reasoning: SQL_REASONING, badges: SQL_BADGES, batch_scores: SQL_BATCH, decision_outcomes: SQL_OUTCOMES, split_summary: SQL_SPLITS, group_sizes: SQL_GROUPS, shuffle_control: SQL_CONTROL,
}
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: s for f, s in _ALL.items() if s}
