"""Small cases and properties of archive, state, corpus and evaluation operators, sources and streams."""

import random

import pytest
from pyspark.sql import functions as F

from urlmill.operators import archive, corpus, evaluation, intel, profile, state
from urlmill.sources import readers


def test_rate_limit(spark):
    """Refused attempts leave no trace, a success clears."""
    rows = [("a", t, False) for t in (0, 10, 20, 30, 40, 50, 899, 901)] + [("a", 2000, True), ("a", 2001, False)] + [("b", t, t == 3) for t in range(8)]
    d = spark.createDataFrame(rows, "client string, at long, ok boolean")
    got = {r.client: (r.attempts, r.refused, r.failures) for r in state.rate_limit(d).collect()}
    assert got == {"a": (10, 2, 7), "b": (8, 0, 7)}


def brute_limit(rows, limit, seconds):
    recent, refused = [], 0
    for t, ok in sorted(rows):
        recent = [x for x in recent if t - x < seconds]
        if len(recent) >= limit:
            refused += 1
        elif ok:
            recent = []
        else:
            recent.append(t)
    return refused


def test_rate_limit_random(spark):
    r = random.Random(4)
    data = {f"c{i}": [(r.randint(0, 3000), r.random() < 0.2) for _ in range(40)] for i in range(20)}
    d = spark.createDataFrame([(c, t, ok) for c, xs in data.items() for t, ok in xs], "client string, at long, ok boolean")
    assert {x.client: x.refused for x in state.rate_limit(d).collect()} == {c: brute_limit(xs, 5, 900) for c, xs in data.items()}


@pytest.mark.parametrize("strict,hits", [(True, 3), (False, 2)])
def test_ttl(spark, strict, hits):
    """A hit does not renew: 0 loads, 5 and 10 hit (10 only while <= counts), 11 loads, 15 hits."""
    d = spark.createDataFrame([("k", t) for t in (0, 5, 10, 11, 15)] if strict else [("k", t) for t in (0, 5, 10, 15)], "key string, at long")
    r = state.ttl_cache(d, 10, strict=strict).first()
    assert r.hits == hits and r.loads == r.lookups - hits


def test_cache_as_of(spark):
    e = spark.createDataFrame([("k", 0, 10, "a"), ("k", 5, 20, "b")], "key string, fetched_at long, expires_at long, payload string")
    q = spark.createDataFrame([("k", 1), ("k", 7), ("k", 20), ("z", 1)], "key string, at long")
    assert {(r.key, r.at): r.payload for r in state.cache_as_of(q, e).collect()} == {("k", 1): "a", ("k", 7): "b", ("k", 20): None, ("z", 1): None}


def test_frames(spark):
    d = spark.createDataFrame([("s", 1, "event: a\ndata: 1\n"), ("s", 2, "\nevent: b\ndata: x\ndata: y\n\n"), ("t", 1, "data: cut")], "stream_id string, seq long, text string")
    got = {(r.stream_id, r.n): (r.complete, r.event, r.data) for r in state.sse_frames(d).collect()}
    assert got == {("s", 0): (True, "a", "1"), ("s", 1): (True, "b", "x\ny"), ("t", 0): (False, "", "cut")}


def test_training_state(spark):
    d = spark.createDataFrame([("r", 1, "phase: train epoch 1 step 10/40 loss 0.9"), ("r", 2, "noise"), ("r", 3, "epoch 2 step 20/40 loss 0.5")], "run string, line_no long, line string")
    r = state.training_state(d).first()
    assert (r.phase, r.epoch, r.step, r.loss, r.done) == ("train", 2, 20, 0.5, 0.5)


def test_reusable(spark):
    rows = [('{"classification":"benign"}', None, None, None), ('{"classification":"unavailable"}', None, None, None), ("{bad", "benign", "safe", "page"), ('{"classification":"benign","page":{"status":"unavailable"}}', None, None, None),
            ('{"classification":"benign","page":{"status":"ok","final_url":"https://x.org/a.pdf"}}', None, None, None), (None, "phishing", "malicious", "page"), (None, "phishing", "unknown", "page"), (None, "benign", "safe", "error")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw_response_json string, last_classification string, last_verdict string, last_decision_stage string")
    assert [r[0] for r in d.orderBy("i").select(archive.reusable(d)).collect()] == [True, False, False, False, False, True, False, False]


def test_reviews(spark):
    sites = spark.createDataFrame([("u1", "h"), ("u2", "h"), ("u3", "g")], "url string, host string")
    log = spark.createDataFrame([(1, "u1", "h", "approve", "ann", 10), (2, "u2", "h", "reject", "ben", 20), (3, "u2", "h", "approve", "cat", 30), (4, "u3", "g", "approve", "ann", 40)], "seq int, url string, host string, decision string, reviewer string, at int")
    assert {r.url: r.approved_by for r in archive.apply_reviews(sites, log).collect()} == {"u1": None, "u2": "cat", "u3": "ann"}


def test_fold_counts(spark):
    r = random.Random(1)
    log = spark.createDataFrame([(r.randint(0, 4), f"s{i:03}", i, r.choice(archive.VERDICTS), r.random()) for i in range(200)], "site_id int, scan_ref string, scanned_at int, verdict string, score double")
    for row in archive.fold(log).collect():
        assert row.scan_count == row.malicious_count + row.safe_count + row.potentially_unsafe_count + row.unknown_count


def test_feed_host(spark):
    feed = spark.createDataFrame([(1, "https://x.org/a", "1", "m"), (2, "https://x.org/", "2", "m"), (3, "http://1.2.3.4/z", "3", "m")], "feed_seq long, url string, id string, threat string")
    urls = ["https://x.org/a", "https://x.org/a/b", "https://x.org/ab", "https://x.org/", "https://x.org/c", "http://1.2.3.4/other", "https://y.org/a"]
    scans = spark.createDataFrame(list(enumerate(urls)), "scan_id long, url string")
    assert [r.id for r in intel.match_host(scans, feed).orderBy("scan_id").collect()] == ["1", "1", None, "2", None, "3", None]


def test_threat_type(spark):
    d = spark.createDataFrame([("", ["a", "", "b"]), ("t", ["a"]), (None, [])], "t string, g array<string>")
    assert [r[0] for r in d.select(intel.threat_type(F.col("t"), F.col("g"))).collect()] == ["a,b", "t", None]


def page_rows(spark):
    rows = [("x" * 118, "benign", "https://BLOG.test.:443/"), ("y" * 30 + "<input TYPE='PASSWORD'>", "phish", "https://a.org"), (None, "benign", "u"), ("x", "benign", "u"), ("z" * 50, "unknown", "u"), ("a" * 300_000 + "1", "benign", "https://b.org"), ("a" * 300_000 + "2", "benign", "https://b.org")]
    return corpus.normalize_pages(spark.createDataFrame(rows, "html string, label string, url string"))


def test_normalize_pages(spark):
    got = page_rows(spark).collect()
    assert len(got) == 4
    first = next(r for r in got if r.html_len == 118)
    assert first.short and first.host == "blog.test" and first.label_id == 0
    assert [r.is_login for r in got if r.label_id == 1] == [True]
    long = [r for r in got if r.html_len > 300_000]
    assert long[0].html == long[1].html and long[0].sha256 != long[1].sha256


def test_coverage(spark):
    rows = [(f"u{i}", 0, False, False) for i in range(20)] + [(f"s{i}", 0, True, False) for i in range(5)] + [(f"l{i}", 0, False, True) for i in range(5)]
    d = spark.createDataFrame(rows, "sha256 string, label_id int, short boolean, is_login boolean")
    got = corpus.coverage(d, 10, [("short", 0.2), ("is_login", 0.2)], "s", "sha256", "label_id").collect()
    assert len(got) == 10 and sum(r.short for r in got) >= 2 and sum(r.is_login for r in got) >= 2


def test_split_groups(spark):
    d = spark.createDataFrame([(f"{h}-{i}", f"host:{h}", i % 2) for h in range(10) for i in range(2)], "sha256 string, group string, label_id int")
    train, val = corpus.split_groups(d, 3, "s", "group")
    assert {r.label_id: r["count"] for r in val.groupBy("label_id").count().collect()} == {0: 3, 1: 3}
    assert train.count() + val.count() == 20 and not train.select("group").intersect(val.select("group")).count()


def test_dedup(spark):
    d = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3), ("b", 0, 4), ("c", 1, 5)], "k string, l int, n int")
    assert {(r.k, r.n) for r in profile.dedup_last_no_conflict(d, "k", "n", "l").collect()} == {("b", 4), ("c", 5)}
    assert {(r.k, r.n) for r in profile.dedup_first(d, "k", "n").collect()} == {("a", 1), ("b", 3), ("c", 5)}
    assert [r.k for r in profile.label_conflicts(d, "k", "l").collect()] == ["a"]


@pytest.mark.parametrize("labels,scores,target,fpr,recall", [([0] * 5 + [1] * 3, [0.7, 0.6, 0.3, 0.2, 0.1, 0.9, 0.65, 0.4], target, fpr, recall) for target, fpr, recall in ((0.2, 0.2, 2 / 3), (0.39, 0.2, 2 / 3), (0.4, 0.4, 1.0), (0.0, 0.0, 1 / 3))] + [([0, 1], [0.5, 0.5], 0.4, 0.0, 0.0)])
def test_threshold(spark, labels, scores, target, fpr, recall):
    r = evaluation.threshold_at_fpr(spark.createDataFrame(list(zip(labels, scores)), "label int, score double"), target).first()
    assert (r.fpr, r.recall) == (fpr, recall)


def test_threshold_budget(spark):
    r = random.Random(9)
    for _ in range(5):
        rows = [(r.randint(0, 1), r.randint(0, 20) / 20) for _ in range(60)]
        target = r.random() * 0.3
        got = evaluation.threshold_at_fpr(spark.createDataFrame(rows, "label int, score double"), target).first()
        negatives = sum(1 - y for y, _ in rows)
        assert got.fp <= int(negatives * target + 1e-9)


def test_auc_against_pairs(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 1), r.randint(0, 9) / 10) for _ in range(80)]
    p, n = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    assert abs(evaluation.roc_auc(spark.createDataFrame(rows, "label int, score double")).first().auc - want) < 1e-9
    assert evaluation.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first().auc is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿URL,label\nhttps://x.org,1\n")
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), ["URL", "label"]).collect()[0].URL == "https://x.org"
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), ["TLD"])
    (tmp_path / "l.txt").write_text("# c\n\n a.org \nb.org\n")
    assert [r.value for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["a.org", "b.org"]
    for label in ("benign", "phish"):
        (tmp_path / "h" / label).mkdir(parents=True)
        (tmp_path / "h" / label / "p.html").write_text(f"<p>\n{label}</p>")
    assert {(r.label, r.html) for r in readers.read_html_folders(spark, str(tmp_path / "h")).collect()} == {("benign", "<p>\nbenign</p>"), ("phish", "<p>\nphish</p>")}
    (tmp_path / "j.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_json_array(spark, str(tmp_path / "j.json"), "a int").count() == 2
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("top.csv", "1,A.org\n2,b.org\n3,c.org\n")
    assert {r.domain for r in readers.read_popular(spark, buf.getvalue(), 2).collect()} == {"a.org", "b.org"}
    with pytest.raises(ValueError, match="fewer"):
        readers.read_popular(spark, buf.getvalue(), 2, least=5)
    built = []
    make = lambda: built.append(1) or spark.range(3)
    for config in ({"n": 1}, {"n": 1}, {"n": 2}):
        assert readers.cached_sample(spark, str(tmp_path / "c"), config, make).count() == 3 if (tmp_path / "c").mkdir(exist_ok=True) is None else False
    assert len(built) == 2
    readers.write_csv(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "out"), ["a", "b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a", "b"]


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    from urlmill.streaming import state as st

    spark.createDataFrame([("a", float(t), False) for t in (0, 10, 20, 30, 40, 50)] + [("a", 2000.0, True)], "client string, at double, ok boolean").coalesce(1).write.parquet(str(tmp_path / "e"))
    src = spark.readStream.schema("client string, at double, ok boolean").parquet(str(tmp_path / "e"))
    got = sorted((r.at, r.outcome) for r in run_stream(spark, st.rate_limit(src), "limits"))
    assert [o for _, o in got] == ["failed"] * 5 + ["refused", "ok"]
    hits = sorted((r.at, r.hit) for r in run_stream(spark, st.ttl_cache(src.withColumnRenamed("client", "key"), 15.0), "hits"))
    assert [h for _, h in hits] == [False, True, False, True, False, True, False]
    spark.createDataFrame([(1, "a", 1, "running"), (1, "a", 2, "complete"), (1, "b", 3, "running")], "scan_id int, stage string, seq int, status string").write.parquet(str(tmp_path / "p"))
    src = spark.readStream.schema("scan_id int, stage string, seq int, status string").parquet(str(tmp_path / "p"))
    assert {(r.stage, r.status) for r in run_stream(spark, st.progress(src), "progress", "complete")} == {("a", "complete"), ("b", "running")}


def test_places(spark):
    """Places through buckets against plain sorting, for whole numbers, text, nulls and random orders."""
    import hashlib

    from urlmill.operators import ranks

    r = random.Random(5)
    rows = [(r.choice([None, r.randint(-(10**12), 10**12), r.randint(0, 70_000)]), f"{r.choice('abcé')}{i}") for i in range(300)]
    d = spark.createDataFrame(rows, "k long, t string")
    got = ranks.with_place(d, "n", ranks.key_bucket(d, "k"), F.col("k"), F.col("t")).collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    assert [(x.k, x.t) for x in sorted(got, key=lambda x: x.n)] == want and sorted(x.n for x in got) == list(range(1, 301))
    got = ranks.with_hash_place(d, "n", "s", "t").collect()
    assert [x.t for x in sorted(got, key=lambda x: x.n)] == sorted((t for _, t in rows), key=lambda t: hashlib.sha256(f"s|{t}".encode()).hexdigest())


def test_text_buckets_spread_keys_that_start_alike(spark):
    from urlmill.operators import ranks

    r = random.Random(8)
    keys = [f"https://urlmill.test/{r.choice('abé漢')}{r.randint(0, 10**6)}" for _ in range(3000)] + [None, ""]
    d = spark.createDataFrame([(k,) for k in keys], "k string")
    got = d.select("k", ranks.key_bucket(d, "k").alias("b")).collect()
    held = sorted((x for x in got if x.k is not None), key=lambda x: x.k.encode())
    assert [x.b for x in held] == sorted(x.b for x in held) and len({x.b for x in held}) > 100
    n = ranks.with_place(d, "n", ranks.key_bucket(d, "k"), "k").collect()
    assert [x.k for x in sorted(n, key=lambda x: x.n)] == sorted(keys, key=lambda k: (k is not None, (k or "").encode()))


@pytest.mark.parametrize("rows", [0, 4, 10, 137])
def test_bins_of_equal_size(spark, rows):
    r = random.Random(rows)
    data = [(i, r.choice([0.0, 0.1, 0.1, 0.5, r.random()]), float(r.random() < 0.5)) for i in range(rows)]
    got = {x.bin: (x.n, round(x.mean_score, 9), round(x.positives, 9)) for x in evaluation.calibration(spark.createDataFrame(data, "id long, score double, label double"), "id").collect()}
    order, want, at = sorted(data, key=lambda x: (x[1], x[0])), {}, 0
    for b in range(10):
        part = order[at : at + rows // 10 + (b < rows % 10)]
        at += len(part)
        if part:
            want[b + 1] = (len(part), round(sum(x[1] for x in part) / len(part), 9), round(sum(x[2] for x in part) / len(part), 9))
    assert got == want


@pytest.mark.parametrize("width,run", [(1, 4), (3, 4), (7, 7), (5, 65_536)])
def test_rolling_means_over_runs(spark, width, run):
    vals = [random.Random(i).random() for i in range(60)]
    d = spark.createDataFrame([(i * 40_000, v) for i, v in enumerate(vals)], "t long, v double")
    got = {x.t // 40_000: x.rolling for x in profile.rolling_mean(d, "v", "t", width, run).collect()}
    assert len(got) == 60 and all(abs(got[i] - sum(vals[max(0, i - width + 1) : i + 1]) / len(vals[max(0, i - width + 1) : i + 1])) < 1e-9 for i in range(60))


def test_score_buckets_keep_order(spark):
    from urlmill.operators import ranks

    r = random.Random(6)
    scores = sorted([0.0, 1.0, 5e-324, 1e308, -1e308] + [r.choice([r.random(), -r.random() * 10**6, 1 - r.random() * 1e-9, r.randint(-9, 9) / 10]) for _ in range(3000)])
    d = spark.createDataFrame([(None,)] + [(s,) for s in scores] + [(float("nan"),)], "s double").select("s", ranks.score_bucket(F.col("s")).alias("b"))
    got = [x.b for x in d.collect()]
    assert got == sorted(got)
