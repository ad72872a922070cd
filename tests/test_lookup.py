"""Lookups, display texts, client lists, domains."""

import math

from pyspark.sql import functions as F

from urlmill.functions import display, domains
from urlmill.operators import lookup


def test_scan_by_id(spark):
    log = spark.createDataFrame([("a", '{"classification": "benign", "risk_score": 0.1}'), ("b", "{bad"), ("c", None)], "scan_ref string, raw_response_json string")
    assert lookup.scan_by_id(log, "a", "classification string, risk_score double").first().classification == "benign"
    assert not lookup.scan_by_id(log, "b", "classification string").count() and not lookup.scan_by_id(log, "z", "classification string").count()


def test_explanations(spark):
    r = spark.createDataFrame([("1", None), ("2", "1"), ("3", None)], "scan_id string, evidence_scan_id string")
    e = spark.createDataFrame([("1", "why")], "scan_id string, explanation string")
    assert {x.scan_id: x.explanation for x in lookup.with_explanation(r, e).collect()} == {"1": "why", "2": "why", "3": None}


def test_batch_keeps_invalid_rows(spark):
    rows = spark.createDataFrame([("",), ("not-a-url",), ("ftp://files.example/archive.zip",), ("https://",), (None,), ("https://example.org/1",)], "url string")
    got = lookup.score_batch(rows, lambda f: f["digit_ratio"] * 0 + 0.9, 0.5, 0.8).collect()
    assert len(got) == 6 and sum(r.status == "invalid" and r.probability is None for r in got) == 5
    assert [(r.probability, r.prediction) for r in got if r.status == "scored"] == [(0.9, "phishing")]


def test_ledger_and_audit(spark):
    d = spark.createDataFrame([("a", ("x", None)), ("b", (None, "bad"))], "sha256 string, r struct<value:string,error:string>")
    ok, bad = lookup.split_failures(d, "r", "sha256")
    assert [x.sha256 for x in ok.collect()] == ["a"] and [tuple(x) for x in bad.collect()] == [("b", "bad")]
    s = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.9)], "sha256 string, label_id int, score double")
    f = spark.createDataFrame([("c", 1), ("d", 0)], "sha256 string, label_id int")
    got = lookup.decisions(s, f, 0.5)
    assert {r.sha256: r.outcome for r in got.collect()} == {"a": "TN", "b": "TP", "c": "FN", "d": "TN"}
    assert not lookup.incomplete(got, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sha256 string")).count()
    assert {r.sha256 for r in lookup.incomplete(got, spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("e",)], "sha256 string")).collect()} == {"a", "d", "e"}


def test_checkpoint(spark):
    runs = spark.createDataFrame([("x", 0.8, 0.02, 0.3), ("y", 0.7, 0.01, 0.2), ("z", 0.8, 0.02, 0.2)], "run string, recall_at_fpr double, operating_fpr double, loss double")
    assert lookup.best_checkpoint(runs).first().run == "z"


def test_lists_and_domains(spark):
    d = spark.createDataFrame([("https://www.google.com/x",), ("https://evil.google.com/",), ("ftp://google.com",), ("http://localhost:8000/",), ("chrome://newtab",), ("",)], "u string")
    assert [tuple(r) for r in d.select(domains.is_trusted(F.col("u")), domains.is_ignored(F.col("u"), "https://scan.example")).collect()] == [(True, False), (False, False), (False, True), (False, True), (False, True), (False, True)]
    h = spark.createDataFrame([("login.example.co.uk",), ("someone.github.io",), ("8.8.8.8",)], "h string")
    assert [tuple(r) for r in h.select(domains.public_domain(F.col("h")), domains.group_domain(F.col("h"))).collect()] == [("example.co.uk", "example.co.uk"), ("github.io", "someone.github.io"), (None, "8.8.8.8")]


def test_display(spark):
    d = spark.createDataFrame([(True, True, True, False, False, "ok"), (True, True, True, True, False, "degraded"), (False, True, True, False, True, "degraded")], "a boolean, b boolean, c boolean, d boolean, e boolean, want string")
    assert all(r[0] == r[1] for r in d.select(display.health(*(F.col(x) for x in "abcde")), "want").collect())
    s = spark.createDataFrame([("skipped", None, ["Host is on the Tranco top-domain ranking"]), ("skipped", "x", []), ("ok", None, ["Host is on the well-known domain list"])], "p string, s string, g array<string>")
    assert [r[0] for r in s.select(display.infer_shortcut(F.col("p"), F.col("s"), F.col("g"))).collect()] == ["tranco", "x", None]
    f = spark.createDataFrame([("u", None)], "a string, b string").select(display.facts({"url": F.col("a"), "error": F.col("b")})).first()[0]
    assert f == '{"url":"u"}'


def test_summaries(spark):
    d = spark.createDataFrame([("a", 1, "g1"), ("a", 0, "g1"), ("b", 1, "g2")], "split string, label_id int, group string")
    got = {r.split: (r.rows, r.positives, r.groups, r.share) for r in lookup.split_summary(d).collect()}
    assert got["a"] == (2, 0.5, 1, 2 / 3) and math.isclose(got["b"][3], 1 / 3)
    assert tuple(lookup.group_sizes(d, "group").first()) == (2, 2, 2)
    assert lookup.overlap(d.where("split = 'a'"), d.where("split = 'b'"), "group") == 0
    assert lookup.column_groups(d, {"keys": ["split", "group"]}) == {"keys": ["split", "group"], "other": ["label_id"]}
