"""Time-bounded state in batch form: TTL caches, rate limits, progress. Each is a fold over one key's ordered rows.

Rows of a key are collected in order and folded by an expression; a key is a client, host or scan, whose history is short. Streams of unbounded keys go
through urlmill.streaming, which keeps only the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import as_of


def _ordered(df: DataFrame, key: str, at: str, *more: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), *more)))
    return df.groupBy(key).agg(rows.alias("rows"))


def ttl_cache(df: DataFrame, ttl: Column | int, key: str = "key", at: str = "at", strict: bool = True) -> DataFrame:
    """key, lookups, hits, loads of a read-through cache: a hit does not renew the entry.

    An entry written at w is alive at t while t - w <= ttl (strict) or t - w < ttl. Times are seconds; ttl may be a column of the row that is loaded.
    """
    d = _ordered(df.withColumn("_ttl", ttl if isinstance(ttl, Column) else F.lit(ttl)), key, at, "_ttl")
    start = F.struct(F.lit(None).cast("double").alias("w"), F.lit(0).cast("double").alias("ttl"), F.lit(0).cast("long").alias("hits"))

    def step(s: Column, x: Column) -> Column:
        age = x.at.cast("double") - s.w
        alive = s.w.isNotNull() & ((age <= s.ttl) if strict else (age < s.ttl))
        return F.struct(F.when(alive, s.w).otherwise(x.at.cast("double")).alias("w"), F.when(alive, s.ttl).otherwise(x._ttl.cast("double")).alias("ttl"), (s.hits + alive.cast("long")).alias("hits"))

    n = F.size("rows").cast("long")
    hits = F.aggregate("rows", start, step, lambda s: s.hits)
    return d.select(key, n.alias("lookups"), hits.alias("hits")).withColumn("loads", F.col("lookups") - F.col("hits"))


def cache_as_of(lookups: DataFrame, entries: DataFrame, key: str = "key", width: int = 3_600) -> DataFrame:
    """lookups (key, at and others) with the `payload` of the newest entry (key, fetched_at, expires_at, payload) that is valid then: fetched_at <= at < expires_at. See `asof.as_of`."""
    return as_of(lookups, entries, key, width)


def cache_two_level(lookups: DataFrame, shared: DataFrame, local: DataFrame, key: str = "key", width: int = 3_600) -> DataFrame:
    """lookups with `payload` and `level`: what the shared store holds then, else the local one, else null. Both as in cache_as_of."""
    both = as_of(as_of(lookups, shared, key, width, "_shared"), local, key, width, "_local")
    level = F.when(F.col("_shared").isNotNull(), "shared").when(F.col("_local").isNotNull(), "local")
    return both.select(*lookups.columns, F.coalesce("_shared", "_local").alias("payload"), level.alias("level"))


def written_through(entries: DataFrame, shared_enabled: Column, shared_ttl: int, local_ttl: int) -> tuple[DataFrame, DataFrame]:
    """(shared, local): entries (key, fetched_at, payload) as each store keeps them; the shared one only where it is enabled."""
    until = lambda ttl: F.col("fetched_at") + ttl
    return entries.where(shared_enabled).withColumn("expires_at", until(shared_ttl)), entries.withColumn("expires_at", until(local_ttl))


def alive(entries: DataFrame, at: int) -> DataFrame:
    """entries, alive: how many a store holds and how many of them are valid at a time."""
    valid = (F.col("fetched_at") <= at) & (F.lit(at) < F.col("expires_at"))
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if(valid).alias("alive"))


def failures_in_window(df: DataFrame, seconds: int, key: str, at: str) -> DataFrame:
    """Adds how many rows of the key lie within the last `seconds`, this one included."""
    w = Window.partitionBy(key).orderBy(F.col(at).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w))


def rate_limit(df: DataFrame, limit: int = 5, seconds: int = 900, key: str = "client", at: str = "at") -> DataFrame:
    """key, attempts, refused, failures: a refused attempt is not recorded, a success clears the record. Rows: key, at (seconds), ok."""
    d = _ordered(df, key, at, "ok")
    start = F.struct(F.array().cast("array<double>").alias("w"), F.lit(0).cast("long").alias("refused"), F.lit(0).cast("long").alias("failed"))

    def step(s: Column, x: Column) -> Column:
        t = x.at.cast("double")
        recent = F.filter(s.w, lambda o: t - o < seconds)
        full = F.size(recent) >= limit
        w = F.when(full, recent).when(x.ok, F.array().cast("array<double>")).otherwise(F.concat(recent, F.array(t)))
        return F.struct(w.alias("w"), (s.refused + full.cast("long")).alias("refused"), (s.failed + (~full & ~x.ok).cast("long")).alias("failed"))

    out = F.aggregate("rows", start, step)
    return d.select(key, F.size("rows").cast("long").alias("attempts"), out.alias("o")).select(key, "attempts", F.col("o.refused").alias("refused"), F.col("o.failed").alias("failures"))


def progress(df: DataFrame) -> DataFrame:
    """The latest status of each stage of a scan, in the order of their first events. Rows: scan_id, seq, stage, status."""
    g = df.groupBy("scan_id", "stage").agg(F.max_by("status", "seq").alias("status"), F.min("seq").alias("first_seq"))
    return g.withColumn("position", F.row_number().over(Window.partitionBy("scan_id").orderBy("first_seq")))


def idle_gaps(df: DataFrame, idle: int = 10, forget: int = 3_600, key: str = "scan_id") -> DataFrame:
    """(scan_id, idle_from, idle_to, keepalives): gaps of `idle` to `forget` seconds between an event that is not terminal and the scan's next one. Rows: scan_id, at (seconds), terminal."""
    w = Window.partitionBy(key).orderBy("at", "terminal")
    rows = df.select(key, F.lag("at").over(w).cast("long").alias("idle_from"), F.col("at").cast("long").alias("idle_to"), F.lag("terminal").over(w).alias("_over"))
    gap = F.col("idle_to") - F.col("idle_from")
    return rows.where(~F.col("_over") & gap.between(idle, forget)).select(key, "idle_from", "idle_to", F.floor(gap / idle).alias("keepalives"))


def newest(df: DataFrame, keep: int, at: str, *ties: str) -> DataFrame:
    """The newest rows of a bounded store."""
    return df.orderBy(F.desc(at), *ties).limit(keep)


def sse_frames(chunks: DataFrame, limit: int = 128_000) -> DataFrame:
    """Frames (stream_id, n, event, data) of server-sent events that arrive in chunks (stream_id, seq, text); `complete` tells whether the stream ended on a frame.

    A stream longer than limit characters is incomplete by definition.
    """
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c.text), "")
    s = chunks.groupBy("stream_id").agg(F.regexp_replace(whole, "\r\n?", "\n").alias("t")).withColumn("complete", F.col("t").endswith("\n\n") & (F.length("t") <= limit))
    frames = s.select("stream_id", "complete", F.posexplode(F.filter(F.split("t", "\n\n"), lambda f: f != "")).alias("n", "f"))
    lines = lambda name: F.array_join(F.transform(F.filter(F.split("f", "\n"), lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", "")), "\n")
    return frames.select("stream_id", "complete", "n", lines("event").alias("event"), lines("data").alias("data"))


def training_state(log: DataFrame) -> DataFrame:
    """Last phase, epoch, step, total, loss of a training log (run, line_no, line), and the share done."""
    part = lambda p, t: F.nullif(F.regexp_extract("line", p, 1), F.lit("")).cast(t)
    cols = {"phase": part(r"phase[=: ]+(\w+)", "string"), "epoch": part(r"epoch[=: ]+(\d+)", "int"), "step": part(r"step[=: ]+(\d+)", "long"), "total": part(r"step[=: ]+\d+/(\d+)", "long"), "loss": part(r"loss[=: ]+([0-9.]+)", "double")}
    d = log.select("run", "line_no", *[c.alias(k) for k, c in cols.items()])
    g = d.groupBy("run").agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("line_no"))).alias(k) for k in cols])
    return g.withColumn("done", F.when(F.col("total") > 0, F.col("step") / F.col("total")))


def remaining(state: DataFrame, epochs: str = "epochs", minutes: str = "epoch_minutes") -> DataFrame:
    """Adds eta_minutes to rows (epoch, step, total, finished and the two named): what is left at the pace of the running epoch; null if unknown or finished.

    The epochs before this one are done; step counts within it.
    """
    pace = F.col("step") / F.nullif(F.col(minutes), F.lit(0.0))
    left = (F.col(epochs) - F.col("epoch")) * F.col("total") - F.col("step")
    known = ~F.col("finished") & (F.col("step") > 0) & (F.col("total") > 0)
    return state.withColumn("eta_minutes", F.when(known, left / pace))


def epoch_scores(log: DataFrame) -> DataFrame:
    """(run, f1): the scores a log (run, line_no, line) names, in the order of its lines."""
    d = log.select("run", "line_no", F.nullif(F.regexp_extract("line", r"(?i)\bf1[=: ]+([0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double").alias("f1")).where("f1 is not null")
    return d.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "f1"))), lambda x: x.f1).alias("f1"))


def bounded_cache(df: DataFrame, ttl: int = 21_600, size: int = 200, client: str = "client") -> DataFrame:
    """client, lookups, hits, held of caches that hold at most `size` hosts. Rows: client, host, at (seconds), kind ('lookup' or 'result'), keep.

    As host_cache per host; a result that makes the cache too large removes the entries written first (of equals, the smallest host), an expired entry that is looked up is removed.
    """
    d = _ordered(df, client, "at", "kind", "host", "keep")
    entry = "array<struct<w: double, host: string>>"
    start = F.struct(F.array().cast(entry).alias("e"), F.lit(0).cast("long").alias("hits"))

    def step(s: Column, x: Column) -> Column:
        t, ask = x.at.cast("double"), x.kind == "lookup"
        alive_ = F.exists(s.e, lambda o: (o.host == x.host) & (t - o.w < ttl))
        others = F.filter(s.e, lambda o: o.host != x.host)
        grown = F.array_sort(F.concat(others, F.array(F.struct(t.alias("w"), x.host.alias("host"))))).cast(entry)
        kept = F.slice(grown, F.greatest(F.size(grown) - size, F.lit(0)) + 1, size)
        e = F.when(ask & alive_, s.e).when(ask, others).when(x.keep, kept).otherwise(others)
        return F.struct(e.cast(entry).alias("e"), (s.hits + (ask & alive_).cast("long")).alias("hits"))

    out = F.aggregate("rows", start, step)
    asked = F.size(F.filter("rows", lambda x: x.kind == "lookup")).cast("long")
    return d.select(client, asked.alias("lookups"), out.alias("o")).select(client, "lookups", F.col("o.hits").alias("hits"), F.size("o.e").cast("long").alias("held"))


def host_cache(df: DataFrame, ttl: int = 21_600, key: str = "host") -> DataFrame:
    """key, lookups, hits of a client cache. Rows: key, at (seconds), kind ('lookup' or 'result'), keep (whether a result may be kept).

    A result that may be kept replaces the entry, another one removes it; a lookup hits while the entry is younger than ttl and renews nothing.
    """
    d = _ordered(df, key, "at", "kind", "keep")
    start = F.struct(F.lit(None).cast("double").alias("w"), F.lit(0).cast("long").alias("hits"))

    def step(s: Column, x: Column) -> Column:
        t, ask = x.at.cast("double"), x.kind == "lookup"
        alive = s.w.isNotNull() & (t - s.w < ttl)
        w = F.when(ask, F.when(alive, s.w)).when(x.keep, t)
        return F.struct(w.alias("w"), (s.hits + (ask & alive).cast("long")).alias("hits"))

    return d.select(key, F.size(F.filter("rows", lambda x: x.kind == "lookup")).cast("long").alias("lookups"), F.aggregate("rows", start, step, lambda s: s.hits).alias("hits"))
