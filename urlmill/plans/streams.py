"""Queries that replay events and conversations as streams, in portions with a restart between them, with SQL over the whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import state
from ..sources.shared import replay
from ..streaming import expiry
from .common import table
from .tables import SQL_RATE_LIMIT, _seconds, _ttl_sql

_AT = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


def _hits(rows, key):  # noqa: ANN001, ANN202
    lookups, hits = F.count(F.lit(1)), F.count_if("hit")
    return rows.groupBy(key).agg(lookups.alias("lookups"), hits.alias("hits"), (lookups - hits).alias("loads"))


def _buckets(rows) -> int:  # noqa: ANN001
    """Buckets of keys for a replay: one for about 20,000 rows, so that calls follow the rows, not the keys, and no bucket grows with the table."""
    return max(16, rows.count() // 20_000)


def stream_ttl_cache(spark, sf):
    """Every event looks up its user; entries live for a day and then leave the state."""
    rows = _seconds(spark, sf).select("user_id", "at", F.lit(86_400).alias("ttl"))
    many = _buckets(rows)
    return _hits(replay(rows, "at", lambda s: expiry.ttl_cache(s, "user_id", buckets=many), tag="ttl"), "user_id")


def stream_dual_ttl_cache(spark, sf):
    """As above; what an error loads lives longer."""
    rows = _seconds(spark, sf).select("user_id", "at", F.when(F.col("event_type") == "error", 864_000).otherwise(90_000).alias("ttl"))
    many = _buckets(rows)
    return _hits(replay(rows, "at", lambda s: expiry.ttl_cache(s, "user_id", strict=False, buckets=many), tag="dual"), "user_id")


def stream_rate_limit(spark, sf):
    """Errors are failed attempts, purchases successes."""
    rows = _seconds(spark, sf).where("event_type in ('error', 'purchase')").select("user_id", "at", (F.col("event_type") == "purchase").alias("ok"))
    many = _buckets(rows)
    out = replay(rows, "at", lambda s: expiry.rate_limit(s, 5, 864_000, "user_id", buckets=many), tag="limit")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("outcome") == "refused").alias("refused"), F.count_if(F.col("outcome") == "failed").alias("failures"))


def stream_host_cache(spark, sf):
    """Views and errors are results, of which errors may not be kept; other events look up."""
    kind = F.when(F.col("event_type").isin("view", "error"), "result").otherwise("lookup")
    rows = _seconds(spark, sf).select(F.col("user_id").alias("host"), "at", kind.alias("kind"), (F.col("event_type") == "view").alias("keep"))
    many = _buckets(rows)
    out = replay(rows, "at", lambda s: expiry.host_cache(s, 172_800, buckets=many), tag="host")
    return out.groupBy("host").agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits"))


# Of equal times, lookups come first, then results that may not be kept.
SQL_HOST = f"""WITH e AS (SELECT user_id AS host, {_AT} AS t, event_type IN ('view', 'error') AS result, event_type = 'view' AS keep FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t, result, keep) AS n FROM e),
l AS (SELECT *, max(CASE WHEN result THEN n END) OVER (PARTITION BY host ORDER BY n) AS last FROM o)
SELECT l.host, count(*) AS lookups, CAST(count(*) FILTER (o.keep AND l.t - o.t < 172800) AS BIGINT) AS hits FROM l LEFT JOIN o ON o.host = l.host AND o.n = l.last WHERE NOT l.result GROUP BY 1"""


def _scans(spark, sf):  # noqa: ANN001, ANN202
    return _seconds(spark, sf).select(F.col("user_id").alias("scan_id"), "at", (F.col("event_type") == "purchase").alias("terminal"))


def stream_idle_gaps(spark, sf):
    """Gaps of an hour or more between a user's events, until a purchase or three days of silence."""
    rows = _scans(spark, sf)
    many = _buckets(rows)
    return replay(rows, "at", lambda s: expiry.idle_gaps(s, 3_600, 259_200, buckets=many), tag="gaps")


def idle_gaps(spark, sf):
    """The same from the table."""
    return state.idle_gaps(_scans(spark, sf), 3_600, 259_200)


SQL_GAPS = f"""WITH e AS (SELECT user_id AS scan_id, {_AT} AS t, event_type = 'purchase' AS last FROM events),
o AS (SELECT *, lag(t) OVER w AS f, lag(last) OVER w AS over FROM e WINDOW w AS (PARTITION BY scan_id ORDER BY t, last))
SELECT scan_id, f AS idle_from, t AS idle_to, (t - f) // 3600 AS keepalives FROM o WHERE NOT over AND t - f BETWEEN 3600 AND 259200"""


def _chunks(spark, sf):  # noqa: ANN001, ANN202
    """Conversations as streams of events, in chunks of 61 bytes: cut within characters and line ends. Two of three end with a frame `done`."""
    end = F.when(F.col("conv_id") % 2 == 0, "\r\n").otherwise("\n")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n", "\n")
    frame = F.concat(F.lit("event: "), F.coalesce("role", F.lit("")), F.lit("\ndata:"), F.regexp_replace(text, "\n", "\ndata:"), F.lit("\n\n"))
    turns = table(spark, sf, "conversations").where("conv_id is not null").select("conv_id", F.regexp_replace(frame, "\n", end).cast("binary").alias("f"), F.coalesce("turn", F.lit(-1)).alias("turn"), "text", "role")
    closing = turns.select("conv_id").distinct().where("conv_id % 3 > 0").select("conv_id", F.lit(b"event: done\ndata: 1\n\n").alias("f"), F.lit(1 << 60).alias("turn"), F.lit("").alias("text"), F.lit("").alias("role"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("f") / 61).cast("int")), lambda i: F.substring(F.col("f"), (i * 61 + 1).cast("int"), F.lit(61)))
    cut = turns.unionByName(closing).select("conv_id", "turn", "role", "text", F.posexplode(pieces).alias("piece", "chunk"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text", "piece"))
    numbered = cut.select(F.col("conv_id").alias("stream_id"), place.alias("seq"), "chunk")
    return numbered.withColumn("last", F.col("seq") == F.max("seq").over(Window.partitionBy("stream_id")))


def stream_event_frames(spark, sf):
    """Frames of conversations whose chunks arrive one a second, in portions."""
    return replay(_chunks(spark, sf).withColumn("at", F.col("seq")), "at", lambda s: expiry.frames(s, silent=86_400), tag="frames")


def event_frames_batch(spark, sf):
    """The same from the table."""
    return expiry.frames_batch(_chunks(spark, sf))


SQL_EVENT_FRAMES = """WITH c AS (SELECT conv_id, coalesce(turn, -1) AS turn, role, text, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS l FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, turn, role, text, trim(coalesce(role, '')) AS event, array_to_string(list_transform(l, lambda x: regexp_replace(x, '^\\s+', '')), chr(10)) AS data FROM c
  UNION ALL SELECT DISTINCT conv_id, 1::BIGINT << 60, '', '', 'done', '1' FROM c WHERE conv_id % 3 > 0),
n AS (SELECT conv_id AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) - 1 AS n, event, data FROM t WHERE data <> '')
SELECT stream_id, n, event, data, NULL::VARCHAR AS error FROM n UNION ALL SELECT stream_id, count(*), NULL, NULL, 'interrupted' FROM n WHERE stream_id % 3 = 0 GROUP BY 1"""

QUERIES = {f.__name__: f for f in (stream_ttl_cache, stream_dual_ttl_cache, stream_rate_limit, stream_host_cache, stream_idle_gaps, idle_gaps, stream_event_frames, event_frames_batch)}
ORACLES = {
    "stream_ttl_cache": _ttl_sql("86400", "<="), "stream_dual_ttl_cache": _ttl_sql("CASE WHEN event_type = 'error' THEN 864000 ELSE 90000 END", "<"), "stream_rate_limit": SQL_RATE_LIMIT, "stream_host_cache": SQL_HOST,
    "stream_idle_gaps": SQL_GAPS, "idle_gaps": SQL_GAPS, "stream_event_frames": SQL_EVENT_FRAMES, "event_frames_batch": SQL_EVENT_FRAMES,
}
