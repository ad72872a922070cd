"""Queries that write a table to a sink of the library and read it back by its source, with SQL over the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import parse
from ..sources import html_files, json_arrays, readers
from ..sources.shared import fresh
from ..sources.upserts import UpsertTable
from .common import parts_sql, table
from .tables import _seconds


def json_array_pages(spark, sf):
    """Pages as JSON arrays, read back by byte ranges."""
    path = fresh(spark, "arrays")
    json_arrays.write_json_arrays(table(spark, sf, "pages"), path)
    return readers.read_json_array(spark, path, "page_id bigint, url string, html string").select("page_id", "url", F.sha2("html", 256).alias("sha256"), F.length("html").alias("n_chars"))


SQL_ARRAYS = "SELECT page_id, url, sha256(html) AS sha256, CAST(length(html) AS INT) AS n_chars FROM pages"


def html_file_pages(spark, sf):
    """Pages of three labels, one of which has no folder, as HTML files, read back."""
    path = fresh(spark, "html")
    i = F.pmod("page_id", F.lit(3))
    label = F.when(i == 0, "phish").when(i == 1, "benign").otherwise("unknown")
    html_files.export_html(table(spark, sf, "pages").select(label.alias("label"), parse(F.col("url"))["host"].alias("host"), "html"), path)
    read = readers.read_html_folders(spark, path)
    return read.select("label", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("html", 256).alias("sha256"))


SQL_HTML = f"""WITH {parts_sql("pages", keep="page_id, html")},
n AS (SELECT CASE (page_id % 3 + 3) % 3 WHEN 0 THEN 'phishing' WHEN 1 THEN 'benign' END AS label, lower(left(regexp_replace(regexp_replace(coalesce(host, ''), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 100)) AS host, sha256(html) AS sha256 FROM h WHERE html <> '')
SELECT DISTINCT label, CASE WHEN host = '' THEN 'page' ELSE host END || '_' || left(sha256, 16) || '.html' AS name, sha256 FROM n WHERE label IS NOT NULL"""


def user_upserts(spark, sf):
    """Counters, first and last seen, and the last kind of event of every user after three upserts; a migration adds a column before the last one, and a rerun of the first step changes nothing."""
    t = UpsertTable.create(spark, fresh(spark, "upserts"), "user_id bigint, events bigint, first_seen bigint, last_seen bigint, kind string", "user_id", 8)
    e = _seconds(spark, sf).select("event_id", "user_id", "at", "event_type")
    plus = {"events": "coalesce(old.events, 0) + new.events", "first_seen": "least(old.first_seen, new.first_seen)", "last_seen": "greatest(old.last_seen, new.last_seen)"}
    for i in (0, 1, 0, 2):
        if i == 2:
            t.migrate({"001-errors": [("errors", "bigint", "0")]})
            plus["errors"] = "coalesce(old.errors, 0) + new.errors"
        b = e.where(F.pmod("event_id", F.lit(3)) == i).groupBy("user_id").agg(
            F.count(F.lit(1)).alias("events"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by("event_type", F.struct("at", "event_id")).alias("kind"), F.count_if(F.col("event_type") == "error").alias("errors"))
        t.upsert(b if i == 2 else b.drop("errors"), f"batch-{i}", combine=plus)
    return t.read()


SQL_UPSERTS = """WITH e AS (SELECT *, (event_id % 3 + 3) % 3 AS batch, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t FROM events)
SELECT user_id, count(*) AS events, min(t) AS first_seen, max(t) AS last_seen, arg_max(event_type, (batch, t, event_id)) AS kind, count(*) FILTER (batch = 2 AND event_type = 'error') AS errors FROM e GROUP BY 1"""

QUERIES = {f.__name__: f for f in (json_array_pages, html_file_pages, user_upserts)}
ORACLES = {"json_array_pages": SQL_ARRAYS, "html_file_pages": SQL_HTML, "user_upserts": SQL_UPSERTS}
