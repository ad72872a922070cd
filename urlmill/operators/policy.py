"""The decision cascade: one CASE over joined columns, first match wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import risk_level, verdict_for, with_http_penalty

SHORTCUT_CONFIDENCE, UNCORROBORATED_CONFIDENCE, MALICIOUS_FROM = 80, 50, 0.6


def decide(df: DataFrame) -> DataFrame:
    """Adds classification, confidence, risk_score, risk_level, decision_stage, error_code, verdict.

    Input: error (null if the URL passed the guards), archive_ok, rescan, inspect_page, approved, feed_ok, listed, prior (struct
    classification, confidence, score, verdict, reusable; or null), heuristic (struct), known (popular or well known), page_ok, page_score,
    password_inputs, scheme.
    """
    c = F.col
    h, r = c("heuristic"), c("heuristic.risk_score") / F.lit(100.0)
    page_bad = c("page_score") >= 0.6
    conf = F.rint(F.when(page_bad, c("page_score")).otherwise(1 - c("page_score")) * 100).cast("int")
    row = lambda cls, co, sc, stage, err=None: F.struct(F.lit(cls).alias("cls") if isinstance(cls, str) else cls.alias("cls"), co.cast("int").alias("conf"), sc.cast("double").alias("score"), F.lit(stage).alias("stage"), (F.lit(err) if not hasattr(err, "alias") else err).cast("string").alias("err"))
    zero, none = F.lit(0), F.lit(None)
    fresh = ~c("rescan") & ~c("inspect_page")
    cleared = c("approved") & c("feed_ok") & c("archive_ok")
    gate = (
        F.when(c("error").isNotNull(), row("unavailable", zero, none, "error", c("error")))
        .when(~c("archive_ok") & fresh, row("unavailable", zero, none, "error", "history_unavailable"))
        .when(cleared & ~c("listed"), row("benign", F.lit(100), F.lit(0.0), "approved"))
        .when(c("prior.reusable") & fresh & c("archive_ok") & ~(cleared & c("listed")), row(c("prior.classification"), c("prior.confidence"), c("prior.score"), "history"))
        .when(~c("feed_ok"), row("unavailable", zero, none, "error", "threat_intel_unavailable"))
        .when(c("listed"), row("malware", F.lit(97), F.lit(1.0), "urlhaus"))
        .when(~c("inspect_page") & (h["label"] == "benign") & (h["confidence"] > SHORTCUT_CONFIDENCE) & c("known"), row("benign", h["confidence"], r, "heuristic"))
        .when(~c("page_ok") | c("page_score").isNull(), row("unavailable", zero, none, "error", "page_unavailable"))
        .when(~page_bad & (h["label"] == "phishing"), row("phishing", h["confidence"], F.greatest(c("page_score"), r, F.lit(MALICIOUS_FROM)), "page"))
        .when(page_bad & (h["label"] == "benign") & (F.coalesce(c("password_inputs"), zero) == 0), row("benign", F.lit(UNCORROBORATED_CONFIDENCE), c("page_score"), "page"))
        .otherwise(row(F.when(page_bad, "phishing").otherwise("benign"), conf, c("page_score"), "page"))
    )
    g = df.withColumn("_g", gate)
    score = F.round(F.when(c("_g.stage") == "history", c("_g.score")).otherwise(with_http_penalty(c("_g.score"), c("scheme"))), 4)
    seen = F.when(c("_g.stage") == "page", c("page_score"))
    verdict = F.when(c("_g.stage") == "history", c("prior.verdict")).otherwise(verdict_for(c("_g.cls"), seen))
    out = g.withColumn("classification", c("_g.cls")).withColumn("confidence", c("_g.conf")).withColumn("risk_score", score).withColumn("decision_stage", c("_g.stage")).withColumn("error_code", c("_g.err"))
    return out.withColumn("risk_level", risk_level(c("risk_score"))).withColumn("verdict", verdict).drop("_g")


def navigation(df: DataFrame) -> DataFrame:
    """Adds action (open or block) of a browser navigation.

    Input: protected, main_frame, ignored, skipped_once, trusted, allowlisted, cached_high_risk (null without an entry), server_ok, server_high_risk.
    A cached entry that is not high-risk opens; otherwise the server decides, and if it fails a cached threat still blocks.
    """
    c = F.col
    pass_ = ~c("protected") | ~c("main_frame") | c("ignored") | c("skipped_once") | c("trusted") | c("allowlisted")
    bad = F.when(c("cached_high_risk").isNotNull() & ~c("cached_high_risk"), False).when(c("server_ok"), c("server_high_risk")).otherwise(F.coalesce(c("cached_high_risk"), F.lit(False)))
    return df.withColumn("action", F.when(pass_ | ~bad, "open").otherwise("block"))
