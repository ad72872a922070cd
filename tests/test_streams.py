"""Streams with expiring state against the batch folds, frame decoding at every cut, and the as-of join against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from urlmill.operators import state
from urlmill.operators.asof import as_of
from urlmill.sources.shared import replay
from urlmill.streaming import expiry


def test_expired_state_is_gone(spark):
    """Keys that fall silent leave the state when the watermark has passed their last second; others stay, and results are those of the batch."""
    rows = [(f"old{i}", float(i + 1), 100.0) for i in range(20)] + [("late", 90_000.0, 100.0), ("late", 90_100.0, 100.0), ("late", 90_101.0, 100.0), ("long", 5.0, 10.0**6)] + [("late", 170_000.0 + i, 100.0) for i in range(3)]
    d = spark.createDataFrame(rows, "key string, at double, ttl double")
    out = replay(d, "at", expiry.ttl_cache, parts=3)
    want = {r.key: (r.lookups, r.hits) for r in state.ttl_cache(d, F.col("ttl"), "key").collect()}
    got = out.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    assert {r.key: (r.n, r.hits) for r in got.collect()} == want
    held = spark.read.format("statestore").load(out._checkpoint).select("key.key").collect()
    assert sorted(r.key for r in held) == ["late", "long"]


def test_keys_share_buckets(spark):
    """Folds of many keys in one call give the rows of folds key by key, and what expires leaves the bucket."""
    rows = [(i, float(i + 1), 100.0) for i in range(20)] + [(77, 90_000.0, 100.0), (77, 90_100.0, 100.0), (77, 90_101.0, 100.0), (78, 5.0, 10.0**6), (None, 3.0, 10.0), (None, 4.0, 10.0)] + [(77, 170_000.0 + i, 100.0) for i in range(3)]
    d = spark.createDataFrame(rows, "key long, at double, ttl double")
    out = replay(d, "at", lambda s: expiry.ttl_cache(s, buckets=1), parts=3)
    want = replay(d, "at", expiry.ttl_cache, parts=3)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect())) and out.count() == len(rows)
    held = spark.read.format("statestore").load(out._checkpoint).select("value.*").collect()
    assert [sorted(x.groupState.names) for x in held] == [[77, 78]]

    r = random.Random(8)
    rows = [(r.randint(0, 30), t * 50, r.random() < 0.2, r.choice(["lookup", "result"])) for t in range(3000)]
    d = spark.createDataFrame(rows, "client long, at long, ok boolean, kind string")
    for fold in (
        lambda s, n: expiry.rate_limit(s, 3, 9_000, buckets=n),
        lambda s, n: expiry.host_cache(s.withColumnRenamed("client", "host").withColumnRenamed("ok", "keep"), 9_000, buckets=n),
        lambda s, n: expiry.idle_gaps(s.withColumnRenamed("client", "scan_id").withColumnRenamed("ok", "terminal"), 500, 9_000, buckets=n),
    ):
        got, each = (Counter(map(tuple, replay(d, "at", lambda s: fold(s, n)).collect())) for n in (4, None))
        assert got == each and got


def test_limits_over_restarts(spark):
    r = random.Random(4)
    rows = [(r.choice("abc"), float(t), r.random() < 0.1) for t in sorted(r.sample(range(40_000), 300))]
    d = spark.createDataFrame(rows, "client string, at double, ok boolean")
    out = replay(d, "at", expiry.rate_limit)
    got = out.groupBy("client").agg(F.count_if(F.col("outcome") == "refused").alias("refused"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    assert {x.client: (x.refused, x.failed) for x in got.collect()} == {x.client: (x.refused, x.failures) for x in state.rate_limit(d).collect()}


def test_idle_gaps(spark):
    rows = [("a", 1000, False), ("a", 1010, False), ("a", 1019, False), ("a", 1060, True), ("a", 1090, False), ("a", 10_000, False), ("b", 1005, False)]
    d = spark.createDataFrame(rows, "scan_id string, at long, terminal boolean")
    want = {("a", 1000, 1010, 1), ("a", 1019, 1060, 4)}
    assert {tuple(r) for r in state.idle_gaps(d).collect()} == want
    assert {tuple(r) for r in replay(d, "at", expiry.idle_gaps).collect()} == want


TEXT = "event: a\r\ndata: é1\ndata:  x\n\n: keepalive\n\nevent:progress\ndata: 漢字\r\n\r\ndata\n\n\ndata: lone\n\nevent: done\ndata: end\n\nevent: a\ndata: after\n\n".encode()
FRAMES = [(0, "a", "é1\nx", None), (1, "progress", "漢字", None), (2, None, "lone", None), (3, "done", "end", None)]


def fed(chunks, **caps):
    held, out = (b"", 0, 0, False), []
    for i, c in enumerate(chunks):
        held, found = expiry.next_frames(held, c, i == len(chunks) - 1, **caps)
        out += found
    return out


def test_frames_cut_anywhere():
    for a in range(len(TEXT) + 1):
        for b in range(a, len(TEXT) + 1, 7):
            assert fed([TEXT[:a], TEXT[a:b], TEXT[b:]]) == FRAMES
    assert fed([bytes([x]) for x in TEXT]) == FRAMES


def test_frames_over_the_caps_or_unfinished():
    one = b"event: a\ndata: " + b"x" * 50 + b"\n\n"
    assert fed([one, b"data: " + b"y" * 200, b"\n\n"], characters=128) == [(0, "a", "x" * 50, None), (1, None, None, "too large")]
    # The cap counts characters, not bytes.
    wide = b"data: " + "é".encode() * 100
    assert fed([wide, b"\n\nevent: done\ndata: 1\n\n"], characters=140) == [(0, None, "é" * 100, None), (1, "done", "1", None)]
    assert fed([one] * 10, size=300)[-1] == (4, None, None, "too large") and len(fed([one] * 10, size=300)) == 5
    assert fed([one, b"data: open"]) == [(0, "a", "x" * 50, None), (1, None, "open", None), (2, None, None, "interrupted")]
    assert fed([b""]) == [(0, None, None, "interrupted")] and fed([None, b"event: error\ndata: {}\n\n", one]) == [(0, "error", "{}", None)]


def test_frames_in_streams(spark):
    r, rows = random.Random(2), []
    for s in range(12):
        cuts = sorted(r.sample(range(len(TEXT)), 5))
        rows += [(s, i, TEXT[a:b], i == 5, 1000 + 10 * i) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(TEXT)]))]
    d = spark.createDataFrame(rows, "stream_id long, seq long, chunk binary, last boolean, at long")
    want = sorted((s, *map(repr, f)) for s in range(12) for f in FRAMES)
    for out in (replay(d, "at", expiry.frames, parts=3), expiry.frames_batch(d)):
        assert sorted((x[0], *map(repr, x[1:])) for x in map(tuple, out.collect())) == want


# ---- as-of join


def brute_as_of(lookups, entries):
    out = []
    for i, k, at in lookups:
        fit = [(f, e, p) for ek, f, e, p in entries if k is not None and at is not None and ek == k and f is not None and e is not None and f <= at < e]
        out.append((i, k, at, max(fit)[2] if fit else None))
    return sorted(out, key=lambda x: (x[0], str(x)))


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
def test_as_of(spark, width):
    r = random.Random(width)
    entries = [(r.choice(["a", "a", "a", "b", None]), f, f + r.choice([-1, 0, 3, 15, 15, 90, 400]), f"p{i:03}") for i, f in enumerate(r.choices(range(300), k=150))] + [("a", None, 5, "x"), ("b", 5, None, "y")]
    lookups = [(i, r.choice(["a", "a", "b", "c", None]), r.choice([*range(-20, 500), None])) for i in range(300)] + [(0, "a", 7)] * 3
    e = spark.createDataFrame(entries, "key string, fetched_at long, expires_at long, payload string")
    q = spark.createDataFrame(lookups, "id long, key string, at long")
    want = brute_as_of(lookups, entries)
    assert sorted(map(tuple, as_of(q, e, width=width).collect()), key=lambda x: (x[0], str(x))) == want


def test_two_levels_keep_null_lookups(spark):
    e = spark.createDataFrame([("a", 0, 100, 1)], "key string, fetched_at long, expires_at long, payload long")
    q = spark.createDataFrame([("a", 5), (None, 5), ("a", None), ("b", 5), ("a", 5)], "key string, at long")
    got = sorted(map(repr, map(tuple, state.cache_two_level(q, e.where("payload > 1"), e).collect())))
    assert got == sorted(map(repr, [("a", 5, 1, "local")] * 2 + [(None, 5, None, None), ("a", None, None, None), ("b", 5, None, None)]))


def test_as_of_does_not_multiply_rows(spark):
    """One key holds all rows: 3,000 lookups of 3,000 entries, in slices; nothing is joined."""
    n = spark.range(3000).select(F.lit("k").alias("key"), (F.col("id") * 60).alias("fetched_at"), (F.col("id") * 60 + 30).alias("expires_at"), F.col("id").alias("payload"))
    out = as_of(n.select("key", (F.col("fetched_at") + 29).alias("at")), n)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where(F.col("payload") == F.floor(F.col("at") / 60)).count() == 3000
